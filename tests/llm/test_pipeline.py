"""Each stage of the pipeline against a plain version on its own input."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from redactum.llm import common, language_id, secrets
from tests.llm.fixtures import frame, rows
from tests.llm.test_near_duplicates import fingerprint, roots
from tests.llm.test_scans import PASSAGE, base, contamination


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def plain_spans(text):
    """Known spans by the contract's patterns, added ones from a plain reading: strings of 16 signs or more, or what
    known spans leave of them, of at most 2 characters a token that are no digests, numbers or words."""
    known = [(a, k, b) for a, k, b in base(text)]
    out = [(a, b) for a, _, b in known]
    encoding = secrets._encoding(common.tokenizer_path("byte_bpe_50k.tiktoken"))
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        free = [i for i in range(*m.span()) if not any(a <= i < b for a, _, b in known)]
        runs = [list(g) for _, g in itertools.groupby(free, key=lambda i: i - free.index(i))]
        for run in runs:
            a, b = run[0], run[-1] + 1
            behind = [k for s, k, _ in known if s == b and b < m.end()]
            if b < m.end() and b - a < 16 and not (behind and behind[0] > 0 and text[b - 1] != "="):
                continue
            s = text[a:b]
            if len(s) <= 2 * len(encoding.encode_ordinary(s)) and not secrets.public_string(s, encoding):
                out.append((a, b))
    return out


def check_packing(before, pieces):
    library = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for r in before:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        first = (len(ids) - 1) % 2048 + 1
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            b = first if k == 0 else a + 2048
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in pieces) == want
    bins = defaultdict(list)
    for x in pieces:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_stages(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p

    items = [(1, PASSAGE), (2, "no such words in any text of this table at all, truly none of them")]
    unique = list({r[0]: r for r in rows() if r[0] is not None}.values())
    frame(spark, unique).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "packing"]
    kept = docs
    for name, stage in p.STAGES:
        before = [tuple(r) for r in kept.collect()]
        out = common.materialize(stage(spark, kept, str(tmp_path)), name)
        after = [tuple(r) for r in out.collect()]
        if name != "packing":
            assert out.columns == docs.columns
        if name == "language_id":
            langs, net = language_id.train(kept)
            said = [language_id._predict(langs, net, [r[1] or ""]) for r in before]
            want = [r for r, ((lang,), (score,)) in zip(before, said, strict=True) if lang != "und" and score >= 0.5]
            assert len(want) < len(before)
            monkeypatch.setattr(p, "LANGUAGES", ["fr"])
            french = stage(spark, kept, str(tmp_path)).collect()
            monkeypatch.undo()
            assert Counter(map(tuple, french)) == Counter(r for r, ((lang,), (score,)) in zip(before, said, strict=True) if lang == "fr" and score >= 0.5) and french
        elif name == "near_duplicates":
            fp = {r[0]: fingerprint(r[1], 3) for r in before}
            root = roots(fp.values())
            first = {}
            for d in sorted(fp):
                first.setdefault(root[fp[d]], d)
            want = [r for r in before if r[0] in first.values()]
        elif name == "decontamination":
            want = [r for r in before if not contamination(r[1], items)[-1]]
            assert len(want) < len(before)
        elif name == "secrets":
            want = []
            for r in before:
                spans = plain_spans(r[1])
                text = r[1]
                for a, b in reversed(merged(spans)):
                    text = text[:a] + "[SECRET]" + text[b:]
                want.append((r[0], text, *r[2:4], len(text), *r[5:]))
        else:
            check_packing(before, [r.asDict() for r in out.collect()])
            continue
        assert Counter(after) == Counter(want)
        kept = out
    assert p.run(spark, str(tmp_path)).count() == len(after)
