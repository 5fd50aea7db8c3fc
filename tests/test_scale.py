"""Operators whose plans or costs once did not hold on larger tables; results against brute force."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F


def test_alternatives_reach_no_driver(spark):
    """Sizes estimated before an explode are too low, so a side of the join must not be broadcast by them."""
    from redactum.operators import environment

    rng, modes = random.Random(5), ["keep", "placeholder", "level", "level", "level", "level"]
    actions = [(d, f"{d % 3}{i % rng.choice([5, 6])}", rng.choice(modes), i) for d in range(60) for i in range(rng.randrange(7))]
    selected = [(d, f"{d % 3}{rng.randrange(6)}") for d in range(60) for _ in range(rng.choice([1, 1, 2]))] + [(None, "00"), (1, None)]
    want = []
    for d, s in selected:
        rows = [a for a in actions if a[0] == d]
        levels = [a for a in rows if a[2] == "level"]
        at = lambda a: levels.index(a)  # noqa: B023, E731
        for c in (a for a in rows if a[1] == s):
            for a in rows:
                near = a[2] != "level" or (abs(at(a) - at(c)) == 1 if c[2] == "level" else at(a) == (0 if c[2] == "keep" else len(levels) - 1))
                if a[1] != s and near:
                    want.append((d, a[1]))
    a = spark.createDataFrame(actions, "decision int, action string, mode string, index int")
    got = environment.structural_alternatives(a, spark.createDataFrame(selected, "decision int, action string"))
    assert want and sorted(map(tuple, got.collect())) == sorted(want)

    ids = spark.range(10_000).withColumnRenamed("id", "decision")
    many = ids.select("decision", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("index")).select("decision", F.col("index").cast("string").alias("action"), F.lit("level").alias("mode"), "index")
    out = environment.structural_alternatives(many, ids.select("decision", F.lit("2").alias("action")))
    assert out.count() == 20_000
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_windows_need_few_ratios(spark, monkeypatch):
    """The best windows of all, of equal scores the shorter and earlier, without a ratio for each."""
    from redactum.operators import curation

    monkeypatch.setattr(curation, "ratio", lambda a, b: SequenceMatcher(None, a, b).ratio())
    rng, rows = random.Random(6), [("", []), ("x", ["x"]), ("a  b", ["", "a", "", "B"]), (None, ["a"]), ("a", None), ("a b", ["A", None, "b"])]
    rows += [("".join(rng.choices("aAbcé- ", k=rng.randrange(16))), ["".join(rng.choices("abcÉ", k=rng.randrange(5))) for _ in range(rng.randrange(12))]) for _ in range(60)]
    want = []
    for p, words in rows:
        if p is None or words is None:
            want.append(None)
            continue
        n, every = len(p.split(" ")), []
        for k in range(max(1, n - 2), min(n + 4, len(words)) + 1):
            for at in range(len(words) - k + 1):
                window = " ".join(w for w in words[at : at + k] if w is not None)
                every.append((-curation.contained(p.lower(), window.lower()), k, at + 1, window))
        want.append([(w, -s, k, at) for s, k, at, w in sorted(every)[:12]])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, p string, w array<string>")
    got = df.select("id", curation.best_windows(F.col("p"), F.col("w")).alias("best")).orderBy("id").collect()
    assert [None if r.best is None else list(map(tuple, r.best)) for r in got] == want

    monkeypatch.undo()
    calls = []
    monkeypatch.setattr(curation, "ratio", lambda a, b: calls.append(1) or curation.short_ratio(a, b))
    curation.windows_of("green bolt", tuple("we saw one Brand#7 and a green bolt there".split()), 2, 4, 12)
    assert len(calls) < 100


def test_ratio_is_difflibs():
    from redactum.operators import curation

    rng = random.Random(7)
    for n in [60] * 2000 + [260] * 100:
        a, b = ("".join(rng.choices("abcd é", k=rng.randrange(n))) for _ in range(2))
        assert curation.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
        short, long = sorted((a, b), key=len)
        if short and n == 60:
            assert curation.partial_ratio(a, b) == max(curation.ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def test_candidate_windows_are_dealt_out(spark):
    """Many ratios come from a small file: it is not scored in the one task that reads it, nor twice."""
    from redactum.plans.registry import QUERIES

    plan = QUERIES["I8_candidate_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scoring = [line for line in plan.split("\n") if "EvalPython" in line]
    assert len(scoring) == 1 and "Exchange" in plan.split(scoring[0])[1]
