"""Queries over plug-in models with their deterministic stand-ins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators import models as M
from redactum.operators import patterns, producer, reports, spans
from redactum.plans.base import query
from redactum.plans.span_queries import with_resolved

_ENT = "CASE WHEN len(h) = 0 THEN 0.0 ELSE len(list_intersect(h, p)) / len(h) END"
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"


def shout_length(text: pd.Series) -> pd.Series:
    """Stand-in generator: the length of its input in capitals."""
    return text.fillna("").str.upper().str.len().astype("int64")


@query("P29_staged_scoring", "SELECT l_orderkey, l_linenumber, len(p_name) AS answer FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(read, spark):
    """Requests are deduplicated, looked up, computed where missing and joined back."""
    r = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")
    cache = read("part").where("p_size < 9").select("p_name").distinct().select(M.identity("p_name").alias("identity"), F.length("p_name").cast("long").alias("answer"))
    out, _ = M.answers(r, ["p_name"], shout_length, "long", cache)
    return out.select("l_orderkey", "l_linenumber", "answer")


@query("F9_entailment_gate", f"SELECT p_partkey, {_ENT} >= 0.6 AS entailed FROM (SELECT p_partkey, {_WORDS.format('p_name')} AS h, {_WORDS.format(chr(39) + 'a small red thing' + chr(39) + ' || ' + chr(39) + ' or ring' + chr(39))} AS p FROM part)")
def _(read, spark):
    return read("part").select("p_partkey", M.gate(M.entailment(F.lit("a small red thing or ring"), F.col("p_name"))).alias("entailed"))


@query("I3_word_vectors", "SELECT p_partkey, 32 AS size, CAST(len(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS DOUBLE) AS total FROM part")
def _(read, spark):
    v = M.word_vector(F.col("p_name"))
    return read("part").select("p_partkey", F.size(v).alias("size"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("M10_utility", "SELECT p_partkey, 1.0 AS same FROM part")
def _(read, spark):
    """Cosine of a text with itself in other words' order."""
    turned = F.concat_ws(" ", F.reverse(F.split("p_name", " ")))
    return read("part").select("p_partkey", F.round(M.similarity(F.col("p_name"), turned), 6).alias("same"))


@query("H5_match_entries", "SELECT p_partkey AS id, CASE WHEN p_size < 15 THEN p_name WHEN p_size < 30 THEN p_type END AS canonical, CASE WHEN p_size < 15 THEN 'exact' WHEN p_size < 30 THEN 'certified' ELSE 'abstain' END AS reason FROM part")
def _(read, spark):
    p = read("part")
    s = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 15, F.upper("p_name")).otherwise("no such").alias("surface"))
    exact = p.select(F.lower("p_name").alias("surface"), F.col("p_name").alias("canonical")).distinct()
    c = p.where("p_size >= 15").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("wrong").alias("canonical"), F.lit(0.1).alias("certificate")), F.struct(F.lit(2).alias("rank"), F.col("p_type").alias("canonical"), F.when(F.col("p_size") < 30, 0.9).otherwise(0.2).alias("certificate")))).alias("x")).select("id", "x.*")
    return M.match_entries(s, exact, c)


@query("K9_reidentification_risk", "SELECT l_orderkey AS key, CASE WHEN count(*) < 2 THEN 1.0 ELSE sum(CASE WHEN l_linenumber = 1 THEN exp(l_quantity / 10 - m) ELSE 0 END) / sum(exp(l_quantity / 10 - m)) END AS risk FROM (SELECT *, max(l_quantity / 10) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1")
def _(read, spark):
    c = read("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("candidate"), (F.col("l_quantity") / 10).alias("logp"), (F.col("l_linenumber") == 1).alias("original"))
    return M.reidentification_risk(c)


@query("C16_mean_states", "SELECT label AS doc, vec_id % 7 AS \"offset\", avg(CAST(embedding[1] AS DOUBLE)) AS first, avg(CAST(embedding[64] AS DOUBLE)) AS last FROM embeddings GROUP BY 1, 2")
def _(read, spark):
    s = M.mean_states(read("embeddings").select(F.col("label").alias("doc"), (F.col("vec_id") % 7).alias("offset"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")))
    return s.select("doc", "offset", F.col("vector")[0].alias("first"), F.col("vector")[63].alias("last"))


@query("O27_readable_level", "SELECT l_orderkey AS key, max(l_linenumber) AS pos FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1")
def _(read, spark):
    return M.readable_level(read("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("pos"), (F.col("l_discount") * 10).alias("score")), 0.5)


@query("D2_detector_union", with_resolved("SELECT doc_id, start, \"end\", type FROM r"))
def _(read, spark):
    """Pattern spans united with a model's spans (a stand-in that repeats the license pattern with a lower score)."""
    docs = read("documents")
    found = patterns.detect(docs)
    model = found.where("recognizer = 'license'").withColumns({"score": F.lit(0.4), "source": F.lit("model")})
    return spans.resolve(found.unionByName(model)).select("doc_id", "start", "end", "type")


@query("D6_first_wins", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def _(read, spark):
    """The first of equal surfaces of a document, without regard to case, stays as it is written."""
    c = read("customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    return reports.first_mention(c, ["c_nationkey"], "c_mktsegment", "c_custkey")


@query("M13_corpus_metric", "SELECT lang, CASE WHEN count(*) >= 110 THEN avg(n_chars) END AS metric FROM documents GROUP BY lang")
def _(read, spark):
    """A corpus metric is null below its least number of rows."""
    return reports.metric_with_support(read("documents"), "lang", F.avg("n_chars"), 110)


@query("I10_fill_proximity", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS proximity FROM part")
def _(read, spark):
    other = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.lit(""))
    return read("part").select("p_partkey", F.round(M.similarity(other, F.col("p_name")), 6).alias("proximity"))


@query("S10_window_budget", "SELECT source, count(*) AS kept, quantile_disc(n, 0.99) AS quantile FROM (SELECT source, len(regexp_extract_all(lower(text), '[a-z]+')) AS n FROM documents) WHERE n <= 800 GROUP BY source")
def _(read, spark):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).cast("long")
    return reports.within_budget(read("documents").select("source", n.alias("n")), "source", "n", 800).withColumn("quantile", F.col("quantile").cast("long"))


@query("R9_context_packets", "SELECT conv_id, count(*) AS contexts, string_agg(r || ': ' || c, chr(10) ORDER BY r) AS packet FROM (SELECT conv_id, c, row_number() OVER (PARTITION BY conv_id ORDER BY a, c) AS r FROM (SELECT conv_id, text[:40] AS c, min(turn) AS a FROM conversations GROUP BY 1, 2)) WHERE r <= 4 GROUP BY conv_id")
def _(read, spark):
    """The first four different contexts of each conversation in one prompt."""
    return producer.context_packets(read("conversations"), "conv_id", "turn", "text", most=4, chars=40)


@query("O32_task_list", "SELECT doc_id, unnest(['summary', 'answer']) AS task, unnest(['Summarize: ' || source, 'Answer about ' || source || '.']) AS prompt FROM documents")
def _(read, spark):
    return reports.tasks(read("documents"), "doc_id", {"summary": "Summarize: {doc}", "answer": "Answer about {doc}."}, F.col("source"))


@query("B2_canonical_attackers", "SELECT item_id, trim(regexp_replace(replace(lower(text), '-year-old', ' years old'), '[^a-z0-9_<>]+', ' ', 'g')) AS canon FROM benchmark")
def _(read, spark):
    return read("benchmark").select("item_id", T.canonical(F.col("text")).alias("canon"))
