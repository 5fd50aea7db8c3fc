"""Token store, token counts and packing against the library and plain loops."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from redactum.llm import common, packing, token_counts, token_store, tokens
from tests.llm.fixtures import frame, prose, rows

WORD, BYTE = common.tokenizer_path("word_bpe_49k.json"), common.tokenizer_path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def encode(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "spaced")])
def test_pieces_give_the_ids_of_the_library(library, path, kind):
    rng = random.Random(1)
    alphabet = ["a", "The", " ", " ", ".", ",", "!", "'s", "\n", "  ", "É", "ß", "1", "2024", "don't", "<|endoftext|>", "<|STARTOFTEXT|>", "-", "(", "\t", "İ", "é́", " ", "ǅ", "…", ".,", " .", "naïve"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(4000)] + [r[1] or "" for r in rows()]
    table = tokens.PieceTable(path, {"word": tokens.word_cuts, "spaced": tokens.spaced_cuts}[kind])
    want = [e.ids for e in library[path].encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # with an empty and with a filled table
        assert [np.frombuffer(b, table.dtype).tolist() for b in table.encode(texts)] == want
    counts = tokens.PieceTable(path, table.cuts, counts_only=True)
    assert counts.count(texts) == [len(w) for w in want]


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "spaced")])
def test_latin_signs_beside_stops_and_commas(library, path, kind):
    signs = [c for c in map(chr, range(0xA1, 0x1C4)) if not c.isalpha()]
    texts = [t for c in signs for s in ".," for t in (f"mot{s}{c} il", f"mot{c}{s} il", f"a {c}{s}b", f"a{s}{c}b", f"{c} mot{s} il{s}b", f"{c}mot{s}")]
    table = tokens.PieceTable(path, {"word": tokens.word_cuts, "spaced": tokens.spaced_cuts}[kind])
    want = [encode(library, path, t) for t in texts]
    assert [np.frombuffer(b, table.dtype).tolist() for b in table.encode(texts)] == want
    counts = tokens.PieceTable(path, table.cuts, counts_only=True)
    assert counts.count(texts) == [len(w) for w in want]


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "spaced")])
def test_every_sign_and_script_beside_every_neighbour(library, path, kind):
    cuts = {"word": tokens.word_cuts, "spaced": tokens.spaced_cuts}[kind]
    special = [chr(c) for c in (*range(0x20, 0x180), *range(0x1C0, 0x250, 5), *range(0x370, 0x600, 9), *range(0x2000, 0x2070), *range(0x3000, 0x3010), 0x4E00, 0x1F600, 0xFB01, 0x300, 0x0, 0x85)]
    beside = [".", ",", "'", "'s", " ", "  ", "\n", "\t", "<|endoftext|>", "1", "a"]
    texts = [f"{x}{c}{y}b" for c in special for x in ("w", *beside) for y in beside]
    want = [e.ids for e in library[path].encode_batch(texts, add_special_tokens=False)]
    table, counts = tokens.PieceTable(path, cuts), tokens.PieceTable(path, cuts, counts_only=True)
    assert [np.frombuffer(b, table.dtype).tolist() for b in table.encode(texts)] == want
    assert counts.count(texts) == [len(w) for w in want]


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "spaced")])
def test_no_text_is_counted_whole(library, path, kind, monkeypatch):
    texts = ["It’s fine — “so” they say…", "привет, мир", "日本語のテキスト", "x<|endoftext|>y <|startoftext|>", "plain words. Here, too", "\U0001f600" * 5 + " e\u0301\u0301", "naïve  \n\n  a"] * 2
    counter = tokens.PieceTable(path, {"word": tokens.word_cuts, "spaced": tokens.spaced_cuts}[kind], counts_only=True)
    given, own = [], counter.whole
    monkeypatch.setattr(counter, "whole", lambda some: given.extend(some) or own(some))
    assert counter.count(texts) == [len(encode(library, path, t)) for t in texts]
    assert not set(given) & set(texts)


def test_slices_are_bounded_in_bytes():
    import pyarrow as pa

    column = pa.array(["a" * 10, None, "é" * 10, "", "b" * 50, "c"])
    got = list(tokens.slices(column, 25))
    assert [(a, b) for a, b, _ in got] == [(0, 2), (2, 4), (4, 5), (5, 6)] and got[0][2] == ["a" * 10, ""]
    assert next(tokens.slices(column, 25, nulls=True))[2] == ["a" * 10, None] and list(tokens.slices(column.slice(0, 0))) == []


def test_equal_rows_are_shared_among_shards(spark, tmp_path):
    docs = spark.range(300).select((F.col("id") * 0).alias("doc_id"), F.lit("the same words").alias("text"))
    manifest = token_store.write_store(docs, f"file://{tmp_path}/hot", WORD, partitions=6)
    assert manifest.select("shard").distinct().count() >= 4
    assert sorted(r.start for r in token_store.read_store(spark, f"file://{tmp_path}/hot").collect()) == list(range(0, 1200, 4))
    assert len(token_store.lookup(spark, f"file://{tmp_path}/hot", [0])[0]) == 300


def test_table_limit_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_LIMIT", 5)
    table = tokens.PieceTable(WORD, tokens.word_cuts)
    for t in (prose("en", 50) for _ in range(5)):
        assert np.frombuffer(table.encode([t])[0], table.dtype).tolist() == encode(library, WORD, t)


@pytest.mark.parametrize(("path", "kind"), [(WORD, "word"), (BYTE, "spaced")])
def test_long_pieces_leave_the_table(library, path, kind):
    cuts = {"word": tokens.word_cuts, "spaced": tokens.spaced_cuts}[kind]
    table, counter = tokens.PieceTable(path, cuts), tokens.PieceTable(path, cuts, counts_only=True)
    for n in (70, 80, 70, 70, 90):  # the same long piece again, and with signs
        texts = ["a " + "z" * 70 + "!! word", "b " + "q" * n + ", c", "x" * 200 + " " + "z" * 70]
        want = [e.ids for e in library[path].encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, table.dtype).tolist() for b in table.encode(texts)] == want
        assert counter.count(texts) == [len(w) for w in want]
    table.encode(["short"])
    assert max(map(len, table.table)) <= tokens.PIECE_LIMIT


def test_counts(spark, library):
    got = token_counts.count_tokens(frame(spark), WORD, limit=100).collect()
    want = Counter((r[0], len((r[1] or "").encode()), n := len(encode(library, WORD, r[1])), n > 100) for r in rows())
    assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(frame(spark, []), WORD).count() == 0


def test_store_round_trip(spark, library, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(frame(spark), path, WORD, partitions=3)
    got = token_store.read_store(spark, path, with_ids=True).collect()
    assert len(got) == len(rows())
    want = Counter((r[0], tuple(encode(library, WORD, r[1]) + [1])) for r in rows())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert all(r.ids_crc32 == crc(r.ids) and r.n_tokens == len(r.ids) for r in got)
    found = token_store.lookup(spark, path, [3, None, 12345, 8])
    assert found[12345] == [] and len(found[8]) == 3 and len(found[None]) == 2
    assert [x.tolist() for x in found[3]] == [encode(library, WORD, "a") + [1]]


def test_store_of_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    token_store.write_store(frame(spark, []), path, WORD)
    assert token_store.read_store(spark, path).count() == 0


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = list(range(0, 200_000, 7)) + [None]
    index = token_store.Index.from_bytes(token_store.Index.build(keys, np.ones(len(keys), np.int64), 2).to_bytes())
    slots = index.mph.slots(token_store.key_hash(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert [f for f, _ in index.find(keys)] == list(range(len(keys)))
    assert sum(n for _, n in index.find(list(range(1, 70_000, 7)))) == 0
    assert len(index.mph.sizes) < token_store.MAX_LEVELS


def test_packing(spark, library):
    capacity = 64
    got = [r.asDict() for r in packing.pack(frame(spark), BYTE, capacity=capacity, with_ids=True).collect()]
    want = Counter()
    for r in rows():
        ids = encode(library, BYTE, r[1]) + [0]
        first = (len(ids) - 1) % capacity + 1
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            b = first if k == 0 else a + capacity
            want[(r[0], k, a, b - a, crc(ids[a:b]), tuple(ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // capacity) + 2
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def test_fullest_combination_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        room = rng.randrange(0, 80)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        chosen = packing.fullest(counts, room)
        assert all(0 < m <= counts[n] for n, m in chosen)
        assert sum(n * m for n, m in chosen) == max(s for s in sums if s <= room)


def test_plan_places_every_piece_once():
    histogram = {7: 100, 5: 3, 64: 4, 1: 50, 33: 21}
    steps = packing.plan(histogram, 64)
    place = packing.Placement(steps)
    seen = {(b, o + d) for n, c in histogram.items() for i in range(c) for b, o in [place.place(n, i)] for d in range(n)}
    assert len(seen) == sum(n * c for n, c in histogram.items()) and max(o for _, o in seen) < 64


def test_small_parts_pack_alike(spark):
    from redactum.llm import packing

    rows = [(i, None if i == 7 else " ".join(f"w{(i * j) % 97}x" for j in range(i % 50))) for i in range(400)] + [(3, "w1x long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    path = common.tokenizer_path("byte_bpe_50k.json")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(packing.pack(docs, path, batch_rows=16, batch_bytes=500, held=5)) == key(packing.pack(docs, path))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_new_table_takes_the_place_of_what_is_held():
    from redactum.llm import secrets, tokens

    secrets._encoding(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    first = tokens.encoder(common.tokenizer_path("byte_bpe_50k.json"), "spaced")
    assert not secrets._ENCODINGS
    assert tokens.encoder(common.tokenizer_path("byte_bpe_50k.json"), "spaced") is first
    secrets._encoding(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    tokens.release(secrets._ENCODINGS)
    assert secrets._ENCODINGS and not tokens._TABLES
