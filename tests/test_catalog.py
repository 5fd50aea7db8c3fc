"""The catalogue's operators on small hostile tables and against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from redactum.operators import compiler, components, curation, models, patterns, probes, producer, profiles, relations, reports, running
from redactum.sources import readers


def test_demographic_leaves(spark):
    cases = {
        "Kurdish": "ethnicity", " Transgender ": "sexual-orientation", "Woman": "gender", "widows": "marital-status", "my niece": "family-role", "Aged 71": "age",
        "an arthritis patient": "health-condition", "Jewish": "religion", "two Kenyan nationals": "nationality", "physicians": "profession", "botanist": "profession", "teal": "demographic-other", "": "demographic-other",
    }
    rows = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r.s: r.x for r in rows.select("s", relations.demographic_leaf(F.col("s")).alias("x")).collect()} == cases
    assert rows.select(relations.demographic_leaf(F.lit(None).cast("string")).alias("x")).first().x == "demographic-other"


def test_hedges_count_between_the_arguments(spark):
    text = "We may stop. Start drug A, maybe, for pain B; perhaps more."
    a, m, b = text.index("drug A"), text.index("maybe"), text.index("pain B")
    rows = spark.createDataFrame(
        [
            (1, text, [(a, a + 6), (b, b + 6)], "prescribed_with"), (2, text, [(a, a + 6), (b, b + 6)], "tests_for"), (3, text, [(a, a + 6), (m, m)], "prescribed_with"), (4, text, [(b, b + 6), (a, a + 6)], None),
            (5, text, [], "prescribed_with"), (6, None, [(0, 4)], "prescribed_with"), (7, "if and when", [(0, 11)], "x"), (8, "if they agree", [(0, 13)], "x"),
        ],
        "i int, text string, spans array<struct<start:int,end:int>>, relation string",
    )
    got = {r.i: r.x for r in rows.select("i", compiler.hedged_window(F.col("text"), F.col("spans"), F.col("relation")).alias("x")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True}


def test_junk_pairs(spark):
    def pair(text, x, y, relation="prescribed_with", same=True):
        a, b = text.index(x), text.index(y)
        return text, (a, a + len(x)), (b, b + len(y)), relation, same

    rows = [
        (*pair("edema and some erythema", "edema", "erythema", "causes_or_explains"), "cooccurrence_connector"), (*pair("edema from the erythema", "edema", "erythema", "causes_or_explains"), None),
        (*pair("gout, asthma", "asthma", "gout"), "coordination_sibling"), (*pair("gout, asthma", "gout", "asthma", same=False), None),
        (*pair("She denies gout. It is asthma", "gout", "asthma"), "negation_scope"), (*pair("Denies pain. Has gout for asthma", "gout", "asthma"), None),
        (*pair("no evidence of a tear. denies gout by asthma", "gout", "asthma"), "negation_scope"),
    ]
    kind = "struct<start:int,end:int>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, text string, a {kind}, b {kind}, relation string, same boolean, want string")
    for r in df.withColumn("got", compiler.junk_pair(F.col("text"), F.col("a"), F.col("b"), F.col("relation"), F.col("same"))).collect():
        assert r.got == r.want, r


def test_promoted_literals_and_free_levels(spark):
    literals = spark.createDataFrame([(1, "the big red house"), (1, "a tree"), (2, "red house"), (2, None)], "doc int, literal string")
    o = [(1, 9, "house red", True, "a home"), (1, 4, "red", False, "x"), (1, 5, "big", True, None), (1, 12, "big", True, "size"), (2, 1, "green house", True, "x")]
    got = compiler.promoted_literals(literals, spark.createDataFrame(o, "doc int, occurrence int, surface string, controlled boolean, level string"), key="doc").collect()
    assert {(r.doc, r.literal): r.occurrence for r in got} == {(1, "the big red house"): 9, (1, "a tree"): None, (2, "red house"): None}
    plans = spark.createDataFrame([(1, 0, "a Paris suburb"), (1, 1, "a suburb"), (2, 0, "Rome"), (3, 0, "x y"), (3, 1, "x")], "doc int, at int, level string")
    taken = spark.createDataFrame([(1, "paris"), (3, "X"), (3, None), (3, "")], "doc int, term string")
    assert {r.doc: r.level for r in compiler.first_free_level(plans, taken, key="doc", at="at", level="level").collect()} == {1: "a suburb", 2: "Rome", 3: "x y"}


def test_calibration_points(spark):
    t = spark.createDataFrame([(1, "v", s, d, "a") for s in ("x", "y") for d in (1, 2)] + [(1, "w", "x", 3, "a"), (2, "v", "x", 1, "a")], "doc int, vector string, source string, decision int, action string")
    r = spark.createDataFrame([(1, "v", "c", 0.5), (1, "v", "e", 1.0), (1, "w", "c", 1.0)], "doc int, vector string, component string, score double")
    g = spark.createDataFrame([(1, "a", 0.2), (2, "a", 0.4)], "decision int, action string, count_score double")
    w = spark.createDataFrame([(1, "c", 3.0), (1, "e", 1.0)], "doc int, component string, weight double")
    (p,) = compiler.calibration_pool(t, r, g, w).collect()
    assert (p.doc, p.vector, p.sources) == (1, "v", 2) and p.utility == pytest.approx(0.625) and p.count_score == pytest.approx(0.3)


def test_model_replies(spark):
    replies = ['{"candidates":[{"level":" a "},{"level":""},{"level":"b","count":5,"source_family":"book"}]}', '{"candidate_levels":["x","  ","y"]}', "nonsense", None, "[1]", '{"candidates":[]}']
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    out = producer.parse_candidates(rows, "reply", "i").withColumnRenamed("count", "n").collect()
    got = sorted(((r.i, r.position, r.level, r.n, r.source_family, r.selector) for r in out), key=str)
    assert got == [(0, 0, "a", None, "model-proposed", None), (0, 2, "b", 5.0, "book", None), (1, 0, "x", None, "model-proposed", "candidate_levels"), (1, 2, "y", None, "model-proposed", "candidate_levels")]


def test_generic_levels_and_filler(spark):
    rows = spark.createDataFrame([(1, " Science  Occupation", ["drug code", "agent"]), (2, "steel worker", ["drug"]), (3, "a very big steel worker", ["drug", "aspirin"]), (4, "nurse", ["drug", "!"]), (5, None, None)], "i int, level string, aliases array<string>")
    got = {r.i: (r.g, r.f) for r in rows.select("i", producer.generic_profession(F.col("level")).alias("g"), producer.filler_aliases(F.col("aliases")).alias("f")).collect()}
    assert got[1] == (True, True) and got[2] == (True, False) and got[3] == (False, False) and got[4] == (False, False)


def test_context_packets(spark):
    rows = [(1, 3, "c"), (1, 1, "a"), (1, 2, "a"), (1, 4, "ddddd"), (2, 1, None), (2, 2, "x")]
    got = {r.k: (r.contexts, r.packet) for r in producer.context_packets(spark.createDataFrame(rows, "k int, at int, c string"), "k", "at", "c", most=2, chars=3).collect()}
    assert got[1] == (2, "1: a\n2: c") and got[2][1].endswith("x")


def test_places(spark):
    rows = spark.createDataFrame([("Ghent", "Flanders", "Belgium"), ("Namur", None, "Belgium"), ("belgium", "Belgium", "Europe"), (None, "A", "B")], "city string, region string, country string")
    got = {r.city: r.x for r in rows.select("city", producer.place_levels(rows, "a city in", "city", "region", "country").alias("x")).collect()}
    assert got["Ghent"] == ["a city in Flanders", "a city in Belgium"] and got["Namur"] == ["a city in Belgium"] and got["belgium"] == ["a city in Europe"]
    counts = producer.place_counts(rows, "region", "country")
    fills = spark.createDataFrame([(1, "A city in Belgium"), (2, "a city in flanders"), (3, "a town in Belgium"), (4, None), (5, "a city in Mars")], "i int, fill string")
    assert {r.i: r["count"] for r in producer.fill_count(fills, counts, "fill", "a city in", ["country", "region"]).collect()} == {1: 2, 2: 1, 3: None, 4: None, 5: None}


def test_reports_on_empty_and_single_rows(spark):
    empty = spark.createDataFrame([], "k int, v double, s string")
    assert reports.rank_agreement(empty, "k", "v", "v").count() == 0 and reports.shares(empty, "k", "v").count() == 0
    assert reports.missing(empty, empty, ["k"]).count() == 0 and reports.distinct_menus(empty, "k", "s", "s").count() == 0
    one = spark.createDataFrame([(1, 2.0, "A"), (None, 1.0, "b")], "k int, v double, s string")
    assert reports.missing(one, one.where("k IS NULL"), ["k"]).collect()[0].k == 1
    assert [r.s for r in reports.last_mention(spark.createDataFrame([(1, 1, "Ab"), (1, 5, "aB"), (1, 2, "c")], "k int, at int, s string"), ["k"], "s", "at").orderBy("at").collect()] == ["c", "aB"]
    assert {(r.k, r.share) for r in reports.shares(one.fillna({"k": 2}), "k", "v").collect()} == {(1, 2 / 3), (2, 1 / 3)}


def test_offsets(spark):
    rows = spark.createDataFrame([("né à Gand", 5, 9, "Gand"), ("né à Gand", 6, 9, "Gand"), ("x", 0, 5, "x"), (None, 0, 1, "x")], "t string, a int, b int, s string")
    assert [r.a for r in reports.offset_checked(rows, "t", "a", "b", "s").collect()] == [5, 0]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending, monkeypatch):
    monkeypatch.setattr(running, "RANGES", 7)
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.0, 2.5, rng.random() * 100, -3.0]), rng.randrange(5)) for i in range(300)]
    got = {r.i: r.before_n for r in running.running(spark.createDataFrame(rows, "i int, x double, n int"), "x", "n", descending=descending).collect()}
    key = lambda x: (x is not None, x or 0)
    before = (lambda a, b: key(a) < key(b)) if not descending else (lambda a, b: key(a)[0] and (not key(b)[0] or a > b))
    assert got == {i: sum(n for _, y, n in rows if before(y, x)) for i, x, _ in rows}


def test_positions_and_seeded_order(spark):
    import hashlib

    rows = spark.range(500).withColumnRenamed("id", "k")
    got = {r.k: r.position for r in readers.seeded_order(rows, F.col("k") < 5, "k", seed="s").collect()}
    tail = sorted(range(5, 500), key=lambda k: hashlib.sha256(f"s|{k}".encode()).hexdigest())
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [*range(5), *tail]
    parts = [spark.range(n).select((F.col("id") * m).alias("k"), F.lit(n).alias("n")) for n, m in ((4, 3), (1, 1), (6, 2))]
    rounds = [(r.n, r.k) for r in readers.interleave(parts, "k").orderBy("position").collect()]
    assert rounds == [(4, 0), (1, 0), (6, 0), (4, 3), (6, 2), (4, 6), (6, 4), (4, 9), (6, 6), (6, 8), (6, 10)]


def test_products(spark):
    rows = spark.createDataFrame([(1, ["Aspro", "acetyl acid", "X2"]), (2, ["ASPRO", None]), (3, ["a b c d e"]), (4, None)], "p int, names array<string>")
    got = {r.name: (r.products, r.aliases) for r in readers.product_rows(rows, "p").collect()}
    assert got == {"aspro": (2, ["acetyl acid"]), "acetyl acid": (1, ["aspro"])}


def test_term_levels(spark):
    terms = spark.createDataFrame([("a", "A", ["b", "c"]), ("b", "B", ["r"]), ("c", "C", ["s"]), ("x", "X", ["y"]), ("r", "R", [])], "id string, name string, parents array<string>")
    got = {r.id: r.levels for r in readers.term_levels(terms, {"r": "family r", "s": "family s", "b": "family b"}).collect()}
    assert got == {"a": ["family b", "family r", "family s"], "b": ["family r"], "c": ["family s"]}


def test_detection_reads_the_texts_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = patterns.detect(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Window" not in plan
    odd = spark.createDataFrame([(1, "a@b.co\u0301 x é a@b.com, 1.2.3.4"), (2, None), (3, ""), (4, "none")], "doc_id int, text string")
    got = {(r.doc_id, r.recognizer, r.start, r.end) for r in patterns.detect(odd, {k: patterns.PATTERNS[k] for k in ("email", "ipv4")}).collect()}
    assert got == {(1, "email", 0, 6), (1, "email", 12, 19), (1, "ipv4", 21, 28)}


def test_occurrences_of_any_surface(spark):
    docs = spark.createDataFrame([(1, r"in C:\Etc and C:\Etc, (a+b) \Q"), (2, None)], "doc_id int, text string")
    needles = spark.createDataFrame([(1, r"C:\Etc"), (1, "(a+b)"), (1, "\\Q"), (1, ""), (1, None), (2, "x")], "doc_id int, surface string")
    got = sorted((r.surface, r.start) for r in patterns.occurrences(docs, needles).collect())
    assert got == [("(a+b)", 22), (r"C:\Etc", 3), (r"C:\Etc", 14), ("\\Q", 28)]


def test_nearest_by_words_against_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, rng.sample(vocabulary[: rng.choice([6, 40])], rng.randrange(0, 6)) + ["the"] * rng.randrange(2)) for i in range(80)]
    for least in (0.3, 0.5):
        want = {}
        for i, a in rows:
            near = [(-len(set(a) & set(b)) / len(set(a) | set(b)), j) for j, b in rows if j != i and set(a) | set(b)]
            want[i] = sorted((s, j) for s, j in near if -s > least)[:3]
        got = defaultdict(list)
        for r in profiles.nearest_by_words(spark.createDataFrame(rows, "k int, w array<string>"), "k", "w", least=least).collect():
            got[r.k].append((-r.jaccard, r.other))
        assert {k: [(round(s, 9), j) for s, j in sorted(v)] for k, v in got.items()} == {k: [(round(s, 9), j) for s, j in v] for k, v in want.items() if v}


def test_diversity_against_strings(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abc") for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 5, 30, 200])]
    got = {r.doc_id: r.diversity for r in probes.diversity(spark.createDataFrame(rows, "doc_id int, w array<string>")).collect()}
    for i, w in rows:
        want = 1.0
        for n in (2, 3, 4):
            grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
            want *= len(set(grams)) / len(grams) if grams else 0.0
        assert got[i] == pytest.approx(want)


def test_containment_recall_against_single_scores(spark):
    rows = [(1, "red box", "it says RED BOX"), (1, "red box", "box"), (2, "hot pipe", "a hot pip here"), (2, "hot pipe", None), (3, None, "x"), (3, "blue tree", "green house")]
    got = {r.k: r.recall for r in curation.containment_recall(spark.createDataFrame(rows, "k int, surface string, text string"), ["k"]).collect()}
    want = defaultdict(list)
    import pandas as pd

    for k, s, t in rows:
        want[k].append(curation.containment(pd.Series([s or ""]), pd.Series([t or ""]))[0] >= 0.85)
    assert got == {k: sum(v) / len(v) for k, v in want.items()} and got[1] >= 0.5


def test_components_of_long_chains_and_lines(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, None), (None, 7)]
    got = {r.node: r.root for r in components.labelled(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges if None not in e for x in e}
    for _ in root:
        for a, b in (e for e in edges if None not in e):
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_what_is_done_with_answers(spark):
    rows = spark.createDataFrame([("q", "aaa"), ("q", "b"), ("q", "cc"), ("q", "cc"), (None, "x")], "q string, p string")
    assert [(r.q, r.p, r.rank) for r in models.top_passages(rows, "q", "p", models.length_score, 2).orderBy("q", "rank").collect()] == [(None, "x", 1), ("q", "aaa", 1), ("q", "cc", 2)]
    pairs = spark.createDataFrame([("a b", "a"), ("a", "a b"), ("a", "a"), ("a", "c"), (None, "a")], "a string, b string")
    got = {(r.a, r.b): r.relation for r in models.pair_relations(pairs, "a", "b", models.shared_words, 0.999).collect()}
    assert got == {("a b", "a"): "narrower", ("a", "a b"): "broader", ("a", "a"): "equal", ("a", "c"): "none", (None, "a"): "none"}
    effects = spark.createDataFrame([(1, "aa", True), (1, "bbbb", False), (2, "aa", False)], "d int, v string, base boolean")
    assert {(r.d, r.v): r.effect for r in models.counterfactual_effects(effects, "d", "v", F.col("base"), models.length_score).collect()} == {(1, "aa"): 0.0, (1, "bbbb"): 2.0, (2, "aa"): None}
