"""Plug-in models: embedders, entailment judges, readers and generators as Arrow functions behind one interface.

A model sees each distinct input once; answers that a cache table already holds are joined, only misses are computed.
The stand-ins here are deterministic word statistics for tests; their scores say nothing about a trained model.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators.profiles import cosine

Batch = Callable[..., pd.Series]


def identity(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def answers(requests: DataFrame, inputs: list[str], model: Batch, kind: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests with `answer`, new cache rows): distinct inputs by identity, cache lookup, the model on misses only.

    cache (identity, answer); where it holds one identity twice with different answers the smaller is taken.
    """
    keyed = requests.withColumn("identity", identity(*inputs))
    once = keyed.select("identity", *inputs).dropDuplicates(["identity"])
    known = None if cache is None else cache.groupBy("identity").agg(F.min("answer").alias("answer"))
    missing = once if known is None else once.join(known.select("identity"), "identity", "left_anti")
    new = missing.select("identity", F.pandas_udf(model, kind)(*inputs).alias("answer"))
    every = new if known is None else known.unionByName(new)
    return keyed.join(every, "identity", "left").drop("identity"), new


def word_vector(text: Column, size: int = 32) -> Column:
    """Stand-in embedder: counts of words by hash."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))
    at = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))


def entailment(premise: Column, hypothesis: Column) -> Column:
    """Stand-in judge: share of the hypothesis' words that the premise has."""
    h = T.tokens(hypothesis)
    return F.when(F.size(h) == 0, 0.0).otherwise(F.size(F.array_intersect(h, T.tokens(premise))) / F.size(h))


def gate(score: Column, threshold: float = 0.6) -> Column:
    return F.coalesce(score >= threshold, F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    return cosine(word_vector(a), word_vector(b))


def match_entries(spans: DataFrame, exact: DataFrame, candidates: DataFrame, threshold: float = 0.6) -> DataFrame:
    """spans (id, surface), exact (surface, canonical), candidates (id, canonical, rank, certificate). An exact entry, else the
    first candidate in rank whose certificate passes; reason tells which, or `abstain`."""
    e = exact.select(F.col("surface").alias("_s"), F.col("canonical").alias("_e"))
    first = candidates.where(F.col("certificate") >= threshold).groupBy("id").agg(F.min_by("canonical", F.struct("rank", "canonical")).alias("_c"))
    j = spans.join(e, T.normalized(spans["surface"]) == e["_s"], "left").join(first, "id", "left")
    return j.select("id", F.coalesce("_e", "_c").alias("canonical"), F.when(F.col("_e").isNotNull(), "exact").when(F.col("_c").isNotNull(), "certified").otherwise("abstain").alias("reason"))


def reidentification_risk(candidates: DataFrame) -> DataFrame:
    """candidates (key, candidate, logp, original). (key, risk): softmax share of the original among it and the distractors;
    1 without distractors."""
    w = Window.partitionBy("key")
    e = F.exp(F.col("logp") - F.max("logp").over(w))
    rows = candidates.withColumn("_e", e)
    return rows.groupBy("key").agg(F.when(F.count("*") < 2, 1.0).otherwise(F.sum(F.when(F.col("original"), F.col("_e")).otherwise(0.0)) / F.sum("_e")).alias("risk"))


def mean_states(states: DataFrame) -> DataFrame:
    """states (doc, offset, vector) of overlapping windows: the mean vector of each offset."""
    rows = states.select("doc", "offset", F.posexplode("vector").alias("d", "x")).groupBy("doc", "offset", "d").agg(F.avg("x").alias("x"))
    return rows.groupBy("doc", "offset").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda y: y.x).alias("vector"))


def readable_level(levels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """levels (key, pos, score). (key, pos): the coarsest level that is still readable."""
    return levels.where(F.col("score") >= threshold).groupBy("key").agg(F.max("pos").alias("pos"))


def word_count(text: pd.Series) -> pd.Series:
    """Stand-in judge, reader or generator: the words of its prompt."""
    return text.fillna("").str.split().str.len().astype("int64")


# what is done with a model's answers
def top_passages(rows: DataFrame, question: str, passage: str, model: Batch, k: int) -> DataFrame:
    """(question, passage, score, rank): the k most relevant different passages of each question, ties by passage."""
    pairs = rows.select(question, passage).distinct()
    scored, _ = answers(pairs, [question, passage], model, "double")
    r = F.row_number().over(Window.partitionBy(question).orderBy(F.desc("answer"), passage))
    return scored.withColumn("rank", r).where(F.col("rank") <= k).select(question, passage, F.col("answer").alias("score"), "rank")


def mean_similarity(rows: DataFrame, by: list[str], a: str, b: str, model: Batch, *, scale: float = 1.0) -> DataFrame:
    """(by..., similarity): mean score of the pairs, each cut to 0..1 after scaling; null where either side is null."""
    scored, _ = answers(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b], model, "double")
    cut = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("answer") / scale))
    return rows.select(*by).distinct().join(scored.groupBy(*by).agg(F.avg(cut).alias("similarity")), by, "left")


def recovery(rows: DataFrame, by: list[str], original: str, prompt: str, model: Batch) -> DataFrame:
    """(by..., n, recovered): share of redacted spans for which the model's guess from the masked prompt is the original
    in canonical form; a null guess recovers nothing."""
    guessed, _ = answers(rows, [prompt], model, "string")
    same = F.coalesce(T.canonical(F.col("answer")) == T.canonical(F.col(original)), F.lit(False))
    return guessed.groupBy(*by).agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("recovered"))


def utility_ratio(rows: DataFrame, by: list[str], plain: str, private: str, model: Batch) -> DataFrame:
    """(by..., utility, control): mean score of the private answers, and how it stands to that of the plain ones."""
    both = rows.select(*by, F.explode(F.array(F.struct(F.lit("plain").alias("arm"), F.col(plain).alias("t")), F.struct(F.lit("private").alias("arm"), F.col(private).alias("t")))).alias("x")).select(*by, "x.arm", "x.t")
    scored, _ = answers(both, ["t"], model, "double")
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("answer")))
    return scored.groupBy(*by).agg(mean("private").alias("utility"), F.try_divide(mean("private"), mean("plain")).alias("control"))


def verdicts(rows: DataFrame, inputs: list[str], model: Batch, accept: float, review: float) -> DataFrame:
    """rows with verdict: accepted or review by the score's thresholds, else rejected; failed without a score."""
    scored, _ = answers(rows, inputs, model, "double")
    v = F.when(F.col("answer").isNull(), "failed").when(F.col("answer") >= accept, "accepted").when(F.col("answer") >= review, "review").otherwise("rejected")
    return scored.withColumn("verdict", v).drop("answer")


def pair_relations(rows: DataFrame, a: str, b: str, model: Batch, least: float) -> DataFrame:
    """rows with relation: 'equal' where the two entail each other, 'narrower' where only the first entails the second,
    'broader' the other way, else 'none'. Each direction of each distinct pair is asked once."""
    pairs = rows.select(a, b).distinct()
    asked = pairs.select(F.col(a).alias("premise"), F.col(b).alias("hypothesis")).unionByName(pairs.select(F.col(b).alias("premise"), F.col(a).alias("hypothesis"))).distinct()
    scored, _ = answers(asked, ["premise", "hypothesis"], model, "double")
    holds = scored.select(F.col("premise").alias("_p"), F.col("hypothesis").alias("_h"), gate(F.col("answer"), least).alias("_ok"))
    side = lambda df, x, y, name: df.join(holds.withColumnRenamed("_ok", name), df[x].eqNullSafe(F.col("_p")) & df[y].eqNullSafe(F.col("_h"))).drop("_p", "_h")
    both = side(side(pairs, a, b, "_f"), b, a, "_g")
    relation = F.when(F.col("_f") & F.col("_g"), "equal").when(F.col("_f"), "narrower").when(F.col("_g"), "broader").otherwise("none")
    known = both.select(F.col(a).alias("_a"), F.col(b).alias("_b"), relation.alias("relation"))
    return rows.join(known, rows[a].eqNullSafe(known["_a"]) & rows[b].eqNullSafe(known["_b"])).drop("_a", "_b")


def proposed_levels(rows: DataFrame, key: str, prompt: str, model: Batch, known: Column | None = None) -> DataFrame:
    """(key, position, level): levels that a teacher's JSON replies propose, without placeholders and, where `known` is
    true, without those that are there already; each level once for a key, at its first place."""
    from redactum.operators import producer

    replies, _ = answers(rows, [prompt], model, "string")
    found = producer.parse_candidates(replies, "answer", *rows.columns).where(~F.col("level").rlike(producer.PLACEHOLDER))
    if known is not None:
        found = found.where(~known)
    return found.groupBy(key, F.lower("level").alias("level")).agg(F.min("position").alias("position")).select(key, "position", "level")


def read_answers(rows: DataFrame, question: str, context: str, accepted: str, model: Batch) -> DataFrame:
    """rows with score: how well the reader's answer to the question in its context states an accepted value. Equal
    (question, context) pairs are read once; an answer that is missing scores 0."""
    from redactum.operators import qa

    read, _ = answers(rows, [question, context], model, "string")
    return read.withColumn("score", qa.answer_score(F.coalesce("answer", F.lit("")), F.col(accepted))).drop("answer")


def counterfactual_effects(rows: DataFrame, doc: str, vector: str, base: Column, model: Batch) -> DataFrame:
    """rows with effect: the result of a vector minus that of its document's base vector (the smallest marked one). A
    vector is measured once for all documents that share it; without a base the effect is null."""
    measured, _ = answers(rows, [vector], model, "double")
    origin = measured.where(base).groupBy(F.col(doc).alias("_d")).agg(F.min_by("answer", vector).alias("_b"))
    return measured.join(origin, measured[doc].eqNullSafe(F.col("_d")), "left").withColumn("effect", F.col("answer") - F.col("_b")).drop("_d", "_b", "answer")


# stand-ins for tests and demonstrations
def length_score(*texts: pd.Series) -> pd.Series:
    """Letters of all inputs together."""
    return sum(t.fillna("").str.len() for t in texts).astype("float64")


def shared_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the second text's words that the first one has."""
    return pd.Series([len(set(y) & set(x)) / len(set(y)) if y else 0.0 for x, y in zip(a.fillna("").str.lower().str.split(), b.fillna("").str.lower().str.split(), strict=True)])


def last_word(*texts: pd.Series) -> pd.Series:
    """The last word of the last input, as a guess or an answer."""
    return texts[-1].fillna("").str.split(" ").str[-1]


def words_as_levels(prompt: pd.Series) -> pd.Series:
    """A teacher's reply that proposes every word of its prompt."""
    import json

    return pd.Series([json.dumps({"candidate_levels": p.split(" ")}) for p in prompt.fillna("")])
