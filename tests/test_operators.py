"""Golden values and invariants of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators import components, frontier, lattice, patterns, profiles, probes, qa, rewrite, segment, spans, stats
from redactum.sources import readers
from redactum.streaming import incremental


def column(spark, f, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values[0])))
    rows = spark.createDataFrame([(*v, i) for i, v in enumerate(values)], schema + ", i int")
    return [r.x for r in rows.select("i", f(*[F.col(f"c{i}") for i in range(len(values[0]))]).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "levels"),
    [
        ("April 9, 2013", ["April 2013", "the early 2010s", "the 2010s"]), ("52", ["fifty-something"]), ("July", ["the summer"]), ("sixty one years old", ["sixty-something"]),
        ("Last winter", ["some time ago"]), ("1987", ["the late 1980s", "the 1980s"]), ("15", ["teenaged"]), ("110", None), ("banana", None), ("some week", ["at some point"]), (None, None), ("", None),
    ],
)
def test_bucket_date(spark, text, levels):
    assert column(spark, lattice.bucket_date, (text,)) == [levels]


@pytest.mark.parametrize(
    ("text", "level"),
    [
        ("three hundred thousand dollars", "between 150,000 and 600,000 dollars"), ("70k", "between 35,000 and 140,000"), ("$6.5 million", "between 3.25 and 13 million dollars"),
        ("$4 billion", "between 2 and 8 billion dollars"), ("6.5M", "between 3,250,000 and 13,000,000"), ("60 milligrams", "between 30 and 120 milligrams"), ("nothing", None),
    ],
)
def test_bucket_quantity(spark, text, level):
    assert column(spark, lattice.bucket_quantity, (text,)) == [[level] if level else None]


@pytest.mark.parametrize(
    ("fill", "kind", "original", "count"),
    [
        ("Ghent", "LOC", "ghent", 1.0), ("a place", "LOC", "Ghent", 1e9), ("fifty-something", "DATETIME", "52", 10.0), ("between 20 and 80 milligrams", "QUANTITY", "40 milligrams", 7.0),
        ("xyzzy blorp", "MISC", "Oslo", 1.0), ("the 2020s", "DATETIME", "March 3, 2021", 3652.0), ("teenaged", "age", "14", 7.0), ("the spring", "DATETIME", "yesterday", 1.0),
    ],
)
def test_anonymity_count(spark, fill, kind, original, count):
    assert column(spark, lambda a, b, c: lattice.anonymity_count(a, b, c, F.lit(None).cast("double")), (fill, kind, original)) == [pytest.approx(count)]


def test_number_words(spark):
    got = column(spark, T.words_to_number, ("two hundred thousand",), ("twenty-one",), ("a hundred and five",), ("one million two thousand",), ("three apples",), ("",), (None,))
    assert got == [200000.0, 21.0, 105.0, 1002000.0, None, None, None]


def test_plural_folds_differ(spark):
    words = [("illness",), ("studies",), ("bus",), ("gas",), ("levels",)]
    assert column(spark, T.strip_plural, *words) == ["illne", "studie", "bu", "ga", "level"]
    assert column(spark, T.singular_token, *words) == ["illness", "study", "bus", "gas", "level"]


def test_dose(spark):
    assert column(spark, T.strip_dose, ("codeine one point five milligrams",), ("ibuprofen 400 milligrams daily",), ("zinc oxide",)) == ["codeine", "ibuprofen", "zinc oxide"]


def test_articles_and_case(spark):
    assert column(spark, T.fix_articles, ("a apple and an pear",)) == ["an apple and a pear"]
    assert column(spark, T.case_adjust, ("a town", "He left. "), ("A town", "in "), ("a town", "")) == ["A town", "a town", "A town"]


SPAN = "doc_id long, start int, end int, surface string, type string, score double, source string"


def resolved(spark, rows):
    return sorted((r.start, r.end, r.type) for r in spans.resolve(spark.createDataFrame(rows, SPAN)).collect())


def test_resolution(spark):
    assert resolved(spark, [(1, 0, 10, "a", "ORG", 0.5, "model"), (1, 2, 6, "b", "ORG", 0.9, "model")]) == [(0, 10, "ORG")]
    assert resolved(spark, [(1, 0, 10, "a", "ORG", 0.5, "model"), (1, 2, 6, "b", "LOC", 0.8, "model")]) == [(2, 6, "LOC")]
    assert resolved(spark, [(1, 0, 10, "a", "ORG", 0.85, "model"), (1, 2, 6, "b", "CODE", 0.4, "pattern")]) == [(2, 6, "CODE")]
    assert resolved(spark, [(1, 0, 3, "a", "ORG", 0.5, "model"), (1, 3, 6, "b", "LOC", 0.5, "model")]) == [(0, 3, "ORG"), (3, 6, "LOC")]


def greedy(rows):
    def over(a, b):
        return a[1] < b[2] and b[1] < a[2]

    one, out = [], []
    for s in sorted(rows, key=lambda s: (-(s[2] - s[1]), -s[5], s[1], s[2], s[4], s[3], s[6])):
        if not any(k[4] == s[4] and over(k, s) for k in one):
            one.append(s)
    for s in sorted(one, key=lambda s: (-(max(s[5], 0.9) if s[6] == "pattern" else s[5]), -(s[2] - s[1]), s[1], s[2], s[4], s[3], s[6])):
        if not any(over(k, s) for k in out):
            out.append(s)
    return sorted(out)


def test_resolution_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for doc in range(40):
        for i in range(rng.randrange(12)):
            a = rng.randrange(60)
            rows.append((doc, a, a + rng.randrange(1, 15), f"s{i}", rng.choice(["ORG", "LOC", "CODE"]), rng.choice([0.3, 0.5, 0.95]), rng.choice(["model", "pattern"])))
    got = sorted(tuple(r) for r in spans.resolve(spark.createDataFrame(rows, SPAN)).collect())
    want = sorted(s for d in range(40) for s in greedy([r for r in rows if r[0] == d]))
    assert got == want


def test_chains(spark):
    def chain(*surfaces):
        rows = [(1, i * 20, i * 20 + 5, s, "PERSON", 0.9, "model") for i, s in enumerate(surfaces)]
        return [r.chain for r in sorted(spans.chains(spark.createDataFrame(rows, SPAN)).collect(), key=lambda r: r.start)]

    assert chain("Anna Smith", "John Smith") == [0, 1]
    assert chain("Anna Smith", "Anna Maria Smith") == [0, 0]
    assert chain("Anna Smith", "Anna") == [0, 0]
    assert chain("Anna Smith", "John Smith", "Smith") == [0, 1, 1]


def test_offsets_are_code_points(spark):
    docs = spark.createDataFrame([(1, "\U0001f600 mail a@b.io, c@d.org"), (2, "none"), (3, None), (4, "x@y.zz")], "doc_id long, text string")
    found = patterns.matches(docs, patterns.PATTERNS["email"][1])
    assert sorted((r.doc_id, r.start, r.end, r.surface) for r in found.collect()) == [(1, 7, 13, "a@b.io"), (1, 15, 22, "c@d.org"), (4, 0, 6, "x@y.zz")]
    assert spans.broken_offsets(docs, found).isEmpty()


def test_splice_and_restore(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob. Ann left."), (2, "nobody"), (3, None)], "doc_id long, text string")
    s = spark.createDataFrame([(1, 0, 3, "Ann", "<PERSON_1>"), (1, 8, 11, "Bob", "<PERSON_12>"), (1, 13, 16, "Ann", "<PERSON_1>")], "doc_id long, start int, end int, surface string, replacement string")
    red = rewrite.splice(docs, s)
    assert [r.redacted for r in red.orderBy("doc_id").collect()] == ["<PERSON_1> met <PERSON_12>. <PERSON_1> left.", "nobody", None]
    assert [r.restored for r in rewrite.restored(red, s).orderBy("doc_id").collect()] == ["Ann met Bob. Ann left.", "nobody", None]


def test_bare_placeholders_and_whole_words():
    import pandas as pd

    pairs = [{"replacement": "<PERSON_1>", "surface": "Ann"}, {"replacement": "<PERSON_12>", "surface": "Bob"}, {"replacement": "a town", "surface": "Oslo"}]
    got = rewrite.restore(pd.Series(["PERSON_12 and <PERSON_1> of A Town, not a townhouse"]), pd.Series([pairs]))
    assert got[0] == "Bob and Ann of Oslo, not a townhouse"


def test_substitution_is_injective(spark):
    rows = [(1, i * 10, i * 10 + 4, s, t, -1, ["a city", "a place"], [0.3, 0.2]) for i, (s, t) in enumerate([("Oslo", "LOC"), ("Bergen", "LOC"), ("Oslo", "LOC"), ("Rome", "LOC")])]
    out = rewrite.substitute(spark.createDataFrame(rows, "doc_id long, start int, end int, surface string, type string, chain int, lattice array<string>, risks array<double>")).collect()
    per = {}
    for r in out:
        per.setdefault(r.replacement, set()).add(r.surface)
    assert all(len(s) == 1 for s in per.values()) and sorted(per) == ["<LOC_1>", "a city", "a place"]


def test_noise(spark):
    got = column(spark, profiles.is_noise, ("Ace Wrap", "drug"), ("MS", "health-condition"), ("lower back", "health condition"), ("ct", "drug"), ("knee", "PERSON"), ("alpha tocopherol", "drug"), ("12 34", "drug"), ("aspirin", "drug"))
    assert got == [True, False, True, True, False, False, True, False]


def test_information(spark):
    same = spark.range(100).selectExpr("id % 4 AS x", "id % 4 AS y")
    assert abs(probes.plugin_mutual_information(same, "x", "y").first().mi - 2.0) < 0.1
    none = spark.range(100).selectExpr("id % 4 AS x", "1 AS y")
    assert abs(probes.plugin_mutual_information(none, "x", "y").first().mi) < 0.1


def test_recovery(spark):
    raw = [[0.0, 0.0], [0.1, 0.0], [1.0, 1.0], [0.2, 0.0]]
    v = spark.createDataFrame([(i, r, [r[0] + 0.08, r[1]]) for i, r in enumerate(raw)], "id long, raw array<double>, moved array<double>")
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, x: s + x)
    got = probes.nearest_recovery(v, square, (1, 2, 4)).first()
    assert got.recovery_4 == 1.0 and got.recovery_1 <= got.recovery_2 <= got.recovery_4


@pytest.mark.parametrize(("answer", "gold", "score"), [("10 mg", "40 milligrams", 0.0), ("AT&T Corporation", "AT&T", 1.0), ("CHF", "Congestive Heart Failure", 1.0), ("Dr. Kumar", "doctor kumar", 1.0), ("", "x", 0.0), ("", "", 1.0), ("red car", "red bus", 0.5)])
def test_fact_score(spark, answer, gold, score):
    assert column(spark, qa.fact_score, (answer, gold)) == [pytest.approx(score)]


def test_isotonic_pooling(spark):
    rows = spark.createDataFrame([("a", i, v, w) for i, (v, w) in enumerate([(1.0, 1.0), (5.0, 1.0), (2.0, 3.0), (2.0, 1.0), (9.0, 1.0)])], "k string, pos int, value double, weight double")
    assert [r.pooled for r in profiles.pooled_counts(rows, "k").orderBy("pos").collect()] == [1.0, 2.6, 2.6, 2.6, 9.0]


def test_frontier_is_order_independent(spark):
    rng = random.Random(3)
    pts = [("d", float(rng.randrange(9)), float(rng.randrange(9)), f"v{i:02d}") for i in range(40)]
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(pts)
        sky = frontier.skyline(frontier.merge_ties(spark.createDataFrame(pts, "doc string, u double, p double, vector string").repartition(3)))
        results.append(sorted(tuple(r) for r in frontier.upper_hull(sky).collect()))
    assert results[0] == results[1] == results[2] and results[0]


def test_leave_one_out(spark):
    got = {r.value: r.advantage for r in frontier.leave_one_out(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 3.0)], "doc string, value double")).collect()}
    assert got == {1.0: -3.0, 2.0: -1.5, 6.0: 4.5, 3.0: None}


def test_exact_bootstrap():
    means = stats.exact_bootstrap([1.0, 2.0, 3.0])
    assert len(means) == 27 and means[0] == 1.0 and means[-1] == 3.0


def test_chunks_cover_the_text():
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "another ", "end. ", "line\n", "x" * 30]) for _ in range(800))
    parts = segment.windows(text, 200, 50)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b - a <= 200 for a, b in parts) and all(c <= b and c > a for (a, b), (c, _) in zip(parts, parts[1:]))
    assert segment.windows("", 200, 50) == []


def test_components(spark):
    got = {r.node: r.root for r in components.labelled(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60)], "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 60: 50}


def test_ancestors_end_on_cycles(spark):
    got = lattice.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"), 4).collect()
    assert len(got) == 9


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","text":"x"}\n\n{"id":"2","text":"y"}\n')
    (tmp_path / "b.jsonl").write_text('{"id":"3","text":"z"}\n')
    rows = readers.load_tasks(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).orderBy("position").collect()
    assert [r.id for r in rows] == ["1", "3", "2"]
    (tmp_path / "t.obo").write_text('format: 1\n[Term]\nid: D:1\nname: one\nsynonym: "uno" EXACT []\nis_a: D:0 ! root\n\n[Term]\nid: D:2\nname: two\n')
    terms = {r.id: r for r in readers.stanzas(spark, str(tmp_path / "t.obo")).collect()}
    assert terms["D:1"].name == "one" and terms["D:1"].synonyms == ["uno"] and terms["D:1"].parents == ["D:0"] and terms["D:2"].parents == []
    (tmp_path / "p.json").write_text('{"profiles":{"drug":{"aspirin":{"aliases":["asa"],"levels":["nsaid"],"count":3}}}}')
    assert [tuple(r) for r in readers.read_profiles(spark, str(tmp_path / "p.json")).collect()] == [("drug", "aspirin", ["asa"], ["nsaid"], 3.0)]
    lines = spark.createDataFrame([("00001 0016070 1 Bypass  Bypass Cerebral",), ("00002 001 0 Header  Bypass",)], "value string")
    assert [tuple(r) for r in readers.order_lines(lines).collect()] == [("0016070", "Bypass Cerebral")]
    readers.write_jsonl(spark.createDataFrame([(1, "a")], "b int, a string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":"a","b":1}'


def test_streams_end_where_batches_do(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    stream = incremental.event_stream(spark, folder)
    once = incremental.drain(incremental.deduplicated(stream, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "c1"))
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert once.count() == events.select("event_id").distinct().count()
    seen = []
    q = incremental.compacted(incremental.event_stream(spark, folder), str(tmp_path / "c2"), lambda df, epoch: seen.append(df.count()))
    q.awaitTermination()
    assert sum(seen) == events.count()
    q = incremental.retry_counts(incremental.event_stream(spark, folder)).writeStream.format("memory").queryName("retries").outputMode("update").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.user_id: r.n for r in events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n")).collect()}
    assert {r.user_id: r.failures for r in spark.table("retries").collect()} == want


def test_anchor_walks_never_share_a_fill(spark):
    from redactum.operators import environment

    rows = [("d", i, fills) for i, fills in enumerate([["a", "b", "c"], ["A", "b"], ["a"], None, []])]
    got = environment.anchor_walks(spark.createDataFrame(rows, "doc string, position int, fills array<string>")).collect()
    walks = {}
    for r in sorted(got, key=lambda r: r.position):
        walks.setdefault(r.walk, []).append(r.fill)
    assert walks["finest"] == ["a", "b", None, None, None] and walks["coarsest"] == ["c", "b", "a", None, None]
    assert all(len({f.lower() for f in w if f}) == len([f for f in w if f]) for w in walks.values())


def test_fuzzy_matches(spark):
    left = spark.createDataFrame([(1, "acute renal failure"), (2, "blue river"), (3, "x")], "id int, surface string")
    right = spark.createDataFrame([("a", "renal failure"), ("b", "acute renal failures"), ("c", "green river bank"), ("d", "y")], "row string, surface string")
    got = {(r.id, r.row): round(r.score, 2) for r in profiles.fuzzy_matches(left, right, ratio=0.9).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.97}


def test_bootstrap_interval(spark):
    low, high = qa.bootstrap_interval(spark.range(200).selectExpr("id", "cast(id as double) v").select("id", "v"), "v", "id", samples=200).first()
    assert 80 < low < 99.5 < high < 120
    assert tuple(qa.bootstrap_interval(spark.range(0).selectExpr("id", "cast(id as double) v"), "v", "id", samples=10).first()) == (0.0, 0.0)


def test_weighted_quantiles_and_menu(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (4.0, 2.0)], "lam double, weight double")
    assert {r.q: r.value for r in frontier.weighted_quantiles(rows, [0.25, 0.5, 0.9]).collect()} == {0.25: 1.0, 0.5: 2.0, 0.9: 4.0}
    assert [r.snapped for r in frontier.snap(rows, [1.0, 3.0, 9.0]).orderBy("lam").collect()] == [1.0, 3.0, 3.0]


def test_models_see_distinct_misses_only(spark):
    from redactum.operators import models

    requests = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id int, prompt string")
    cache = requests.where("id = 3").select(models.identity("prompt").alias("identity"), F.lit(99).cast("long").alias("answer"))
    out, new = models.answers(requests, ["prompt"], models.word_count, "long", cache)
    assert {r.id: r.answer for r in out.collect()} == {1: 2, 2: 2, 3: 99, 4: 0} and new.count() == 2


def test_containment():
    import pandas as pd

    from redactum.operators import curation

    assert curation.containment(pd.Series(["Oslo", "ann smith", "zzz"]), pd.Series(["in OSLO now", "smith ann b", "abc"])).round(2).tolist() == [1.0, 1.0, 0.0]


def test_containment_in_long_texts():
    import random

    import pandas as pd

    from redactum.operators import curation

    rng = random.Random(4)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(900))
    assert len(text) > 4000
    leak = text[:3000] + " bartholomew quickfoxx " + text[3000:]
    score = curation.containment(pd.Series(["Bartholomew Quickfox", "bartholomaw quickfoxx"]), pd.Series([leak, leak]))
    assert score[0] == 1.0 and 0.9 < score[1] < 1.0
    plain = lambda a, b: max(curation.ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))
    for a in ("tenor sal", "zzz", "o", text[700:720][::-1], leak[2990:3010]):
        assert curation.partial_ratio(a, leak) == curation.partial_ratio(leak, a) == plain(a, leak)
    assert curation.partial_ratio("", leak) == 1.0


def test_literal_starts(spark):
    from redactum.operators import curation

    assert column(spark, curation.literal_starts, ("a.b a.b xa.b", "a.b"), ("none", "x"), ("aaa", "aa"), ("abc", "")) == [[0, 4, 9], [], [0], []]
