"""Queries over menus, frontiers, credit and statistics. A document is an order, its points are the order's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactum.operators import frontier as P
from redactum.operators import reports
from redactum.operators import stats as Q
from redactum.plans.base import query

POINTS = "SELECT l_orderkey AS doc, CAST(l_quantity AS DOUBLE) AS u, round(l_discount * 100) AS p, l_linenumber AS vector, l_returnflag AS source FROM lineitem"
TIES = f"SELECT doc, u, p, count(*) AS multiplicity, min(vector) AS vector FROM ({POINTS}) GROUP BY doc, u, p"
SKY = f"SELECT * FROM ({TIES}) a WHERE NOT EXISTS (SELECT 1 FROM ({TIES}) b WHERE b.doc = a.doc AND b.u >= a.u AND b.p >= a.p AND (b.u > a.u OR b.p > a.p))"
HULL = f"""WITH sky AS ({SKY}) SELECT doc, u, p, vector FROM sky b WHERE NOT EXISTS (SELECT 1 FROM sky a JOIN sky c ON a.doc = c.doc WHERE a.doc = b.doc AND a.u < b.u AND b.u < c.u
 AND (b.p - a.p) / (b.u - a.u) <= (c.p - b.p) / (c.u - b.u) + 1e-12)"""
SWITCH = f"""SELECT doc, lam, weight FROM (SELECT doc, (lead(u) OVER w - u) / (p - lead(p) OVER w) AS lam, 1.0 / (count(*) OVER (PARTITION BY doc) - 1) AS weight, count(*) OVER (PARTITION BY doc) AS n FROM ({HULL}) WINDOW w AS (PARTITION BY doc ORDER BY u)) WHERE n >= 3 AND lam IS NOT NULL"""


def _points(read):
    return read("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").cast("double").alias("u"), F.round(F.col("l_discount") * 100).alias("p"), F.col("l_linenumber").alias("vector"), F.col("l_returnflag").alias("source"))


def _sky(read):
    return P.skyline(P.merge_ties(_points(read)))


def _menu(read):
    return read("customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("decision"), F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 40).cast("string")).alias("fill"))


MENU = "SELECT c_nationkey AS doc, c_custkey AS decision, c_mktsegment || ' ' || (c_custkey % 40) AS fill FROM customer"


@query("P5_legal_actions", f"WITH m AS ({MENU}) SELECT doc, decision, fill FROM m WHERE NOT EXISTS (SELECT 1 FROM m c WHERE c.decision % 3 = 0 AND c.doc = m.doc AND lower(c.fill) = lower(m.fill) AND c.decision <> m.decision)")
def _(read, spark):
    return P.legal_actions(_menu(read), _menu(read).where("decision % 3 = 0"))


@query("P6_fill_collisions", f"SELECT doc, lower(fill) AS fill, count(DISTINCT decision) AS decisions FROM ({MENU}) GROUP BY doc, lower(fill) HAVING count(DISTINCT decision) > 1")
def _(read, spark):
    return P.fill_collisions(_menu(read))


@query("P9_merge_vectors", f"SELECT doc, vector, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, count(DISTINCT u) > 1 AS conflict FROM (SELECT doc, vector % 3 AS vector, source, u FROM ({POINTS})) GROUP BY doc, vector")
def _(read, spark):
    m = P.merge_vectors(_points(read).withColumn("vector", F.col("vector") % 3))
    return m.withColumn("sources", F.array_join("sources", "|"))


@query("P10_merge_ties", TIES)
def _(read, spark):
    return P.merge_ties(_points(read))


@query("P11_skyline", SKY)
def _(read, spark):
    return _sky(read)


@query("P12_upper_hull", HULL)
def _(read, spark):
    return P.upper_hull(_sky(read)).select("doc", "u", "p", "vector")


@query("P13_switch_points", SWITCH)
def _(read, spark):
    return P.switch_points(P.upper_hull(_sky(read)))


@query("P14_weighted_quantiles", f"""WITH s AS (SELECT lam, sum(weight) AS w FROM ({SWITCH}) GROUP BY lam), r AS (SELECT lam, sum(w) OVER (ORDER BY lam) AS c, sum(w) OVER () AS t FROM s)
SELECT q, (SELECT min(lam) FROM r WHERE c >= q * t - 1e-12) AS value FROM (VALUES (0.1), (0.5), (0.9)) v(q)""")
def _(read, spark):
    return P.weighted_quantiles(P.switch_points(P.upper_hull(_sky(read))), [0.1, 0.5, 0.9])


@query("P15_snap_to_observed", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(ln(l_quantity / 2.0)) <= abs(ln(l_quantity / 9.0)) AND abs(ln(l_quantity / 2.0)) <= abs(ln(l_quantity / 31.0)) THEN 2.0 WHEN abs(ln(l_quantity / 9.0)) <= abs(ln(l_quantity / 31.0)) THEN 9.0 ELSE 31.0 END AS snapped FROM lineitem")
def _(read, spark):
    return P.snap(read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), [2.0, 9.0, 31.0], "l_quantity").drop("l_quantity")


@query("P16_lambda_winner", f"SELECT doc, min(vector) AS vector FROM (SELECT *, u + 1.5 * p AS s, max(u + 1.5 * p) OVER (PARTITION BY doc) AS b FROM ({POINTS})) WHERE s >= b - 1e-9 GROUP BY doc")
def _(read, spark):
    return P.winners(_points(read), 1.5)


@query("P18_exact_winner", """
SELECT doc, vector, utility, p FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY utility DESC, p DESC, vector) AS r FROM (
 SELECT l_suppkey AS doc, l_returnflag AS vector, CAST(sum(CAST(l_discount AS DECIMAL(18,6)) * CAST(l_quantity AS DECIMAL(18,6))) AS DOUBLE) AS utility, max(l_tax) AS p FROM lineitem GROUP BY ALL)) WHERE r = 1""")
def _(read, spark):
    rows = read("lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("vector"), F.col("l_discount").alias("weight"), F.col("l_quantity").alias("score"), F.col("l_tax").alias("p"))
    return P.exact_winner(rows).withColumn("utility", F.col("utility").cast("double"))


@query("P19_hamming", "SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) = 'PROMO' THEN 0 ELSE 1 END + CASE WHEN split_part(p_type, ' ', 2) = 'PLATED' THEN 0 ELSE 1 END + CASE WHEN split_part(p_type, ' ', 3) = 'TIN' THEN 0 ELSE 1 END AS d FROM part")
def _(read, spark):
    words = F.array(*[F.split_part("p_type", F.lit(" "), F.lit(i)) for i in (1, 2, 3)])
    return read("part").select("p_partkey", P.hamming(words, F.array(F.lit("PROMO"), F.lit("PLATED"), F.lit("TIN"))).alias("d"))


@query("P24_document_utility", "SELECT user_id, sum(abs(value) * (event_id % 7)) FILTER (WHERE event_type <> 'error') / sum(abs(value)) FILTER (WHERE event_type <> 'error') AS utility FROM events GROUP BY user_id")
def _(read, spark):
    a = read("events").select("user_id", F.abs("value").alias("weight"), (F.col("event_id") % 7).alias("score"), F.when(F.col("event_type") == "error", "monitoring").otherwise("policy").alias("status"))
    return P.weighted_utility(a, ["user_id"])


@query("P25_leave_one_out", "SELECT o_orderkey, o_totalprice - (sum(o_totalprice) OVER w - o_totalprice) / nullif(count(*) OVER w - 1, 0) AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def _(read, spark):
    return P.leave_one_out(read("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice").select("o_orderkey", "advantage")


@query("P27_delta_utility", "WITH r AS (SELECT l_orderkey AS doc, l_suppkey % 4 AS decision, l_extendedprice AS w, l_tax - l_discount AS d, sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS t FROM lineitem) SELECT doc, decision, sum(w * d) / sum(w) AS own, sum(w * d) / max(t) AS share FROM r GROUP BY doc, decision")
def _(read, spark):
    rows = read("lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 4).alias("decision"), F.col("l_extendedprice").alias("weight"), F.col("l_discount").alias("before"), F.col("l_tax").alias("after"))
    return P.delta_utility(rows)


@query("P30_work_slots", "SELECT event_id, dense_rank() OVER (ORDER BY sha256(event_type || chr(1) || user_id)) - 1 AS slot FROM events")
def _(read, spark):
    return P.work_slots(read("events").select("event_id", "event_type", "user_id"), ["event_type", "user_id"]).select("event_id", F.col("slot").cast("long"))


@query("P31_latin_cycle", "SELECT e.c_custkey, e.epoch, ['keep', 'placeholder', 'city', 'region'][(c_nationkey + epoch) % 4 + 1] AS action FROM (SELECT c_custkey, c_nationkey, unnest(range(0, 5)) AS epoch FROM customer) e")
def _(read, spark):
    menu = F.array(*map(F.lit, ("keep", "placeholder", "city", "region")))
    rows = read("customer").select("c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("epoch"))
    return rows.select("c_custkey", F.col("epoch").cast("long").alias("epoch"), P.latin_cycle(menu, F.col("c_nationkey"), F.col("epoch")).alias("action"))


@query("P31_exposure_report", "SELECT event_type, user_id % 10 AS bucket, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, user_id % 10), (event_type), (user_id % 10), ())")
def _(read, spark):
    read("events").selectExpr("event_type", "user_id % 10 AS bucket").createOrReplaceTempView("redactum_exposure")
    return spark.sql("SELECT event_type, bucket, count(*) AS n FROM redactum_exposure GROUP BY GROUPING SETS ((event_type, bucket), (event_type), (bucket), ())")


@query("P32_tie_labels", "SELECT l_suppkey AS pair, count(DISTINCT CASE WHEN l_tax = 0 THEN l_linenumber END) AS contexts FROM lineitem GROUP BY 1 HAVING max(abs(l_tax)) <= 1 AND count(DISTINCT CASE WHEN l_tax = 0 THEN l_linenumber END) >= 3")
def _(read, spark):
    return P.tie_labels(read("lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_linenumber").alias("context"), F.col("l_tax").alias("delta")), bound=1)


@query("P33_scaled_rollouts", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 9 <= 0 THEN 2 WHEN l_discount * 9 >= 1 THEN 32 ELSE greatest(2, least(32, CAST(ceil(ln(0.05) / ln(l_discount * 9)) AS INTEGER))) END AS n FROM lineitem")
def _(read, spark):
    return read("lineitem").select("l_orderkey", "l_linenumber", P.scaled_rollouts(F.col("l_discount") * 9).alias("n"))


@query("P34_responsiveness", "SELECT user_id, avg(CASE WHEN event_type IS DISTINCT FROM p THEN 1.0 ELSE 0 END) AS share FROM (SELECT user_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n > 1 GROUP BY user_id")
def _(read, spark):
    return P.responsiveness(read("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("P39_wildcard_spread", """
WITH v AS (SELECT l_suppkey AS doc, [l_returnflag, l_linestatus, CAST(l_linenumber % 3 AS VARCHAR)] AS v, avg(l_quantity) AS value FROM lineitem GROUP BY ALL),
r AS (SELECT doc, position, value, array_to_string([CASE WHEN i = position THEN '*' ELSE v[i] END for i in [1, 2, 3]], ',') AS rest FROM (SELECT *, unnest([1, 2, 3]) AS position FROM v))
SELECT doc, position, rest, count(*) AS n, max(value) - min(value) AS spread FROM r GROUP BY ALL HAVING count(*) > 1""")
def _(read, spark):
    v = read("lineitem").select(F.col("l_suppkey").alias("doc"), F.array("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("vector"), "l_quantity")
    return P.wildcard_spread(v.groupBy("doc", "vector").agg(F.avg("l_quantity").alias("value")), 3)


@query("P41_hash_fold", "SELECT doc_id, list_sum(list_transform(string_split(sha256('split' || chr(0) || doc_id), ''), lambda d: strpos('0123456789abcdef', d) - 1)) % 5 = 0 AS development FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", (P.hash_fold(F.col("doc_id")) == 0).alias("development"))


@query("Q1_stratified_split", "SELECT doc_id, CASE WHEN r / n < 0.7 THEN 'train' WHEN r / n < 0.85 THEN 'dev' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('0|' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def _(read, spark):
    return Q.stratified_split(read("documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "part")


@query("Q19_folds", "SELECT doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY sha256('0|' || doc_id), doc_id) - 1) % 4 AS INTEGER) AS fold FROM documents")
def _(read, spark):
    return Q.folds(read("documents").select("doc_id", "lang"), "doc_id", "lang", 4).select("doc_id", "fold")


@query("Q2_spearman", """
WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS x, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2 AS y FROM lineitem)
SELECT l_suppkey, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS rho FROM r GROUP BY l_suppkey""")
def _(read, spark):
    return Q.spearman(read("lineitem").select("l_suppkey", "l_quantity", "l_discount"), "l_suppkey", "l_quantity", "l_discount")


@query("Q4_mean_baseline", """
WITH s AS (SELECT p_type, avg(p_retailprice) AS m, greatest(stddev_pop(p_retailprice), 1e-6) AS d FROM part WHERE p_size < 10 GROUP BY p_type), g AS (SELECT avg(p_retailprice) AS m, greatest(stddev_pop(p_retailprice), 1e-6) AS d FROM part WHERE p_size < 10)
SELECT p_partkey, coalesce(s.m, g.m) AS mean, coalesce(s.d, g.d) AS std FROM part CROSS JOIN g LEFT JOIN s ON part.p_type = s.p_type WHERE p_size >= 10""")
def _(read, spark):
    p = read("part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return Q.mean_baseline(p.where("p_size < 10"), p.where("p_size >= 10"), "p_type", "p_retailprice").select("p_partkey", "mean", "std")


@query("Q7_quantile", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.9) AS q FROM lineitem GROUP BY l_returnflag")
def _(read, spark):
    return read("lineitem").groupBy("l_returnflag").agg(Q.quantile("l_extendedprice", 0.9).alias("q"))


@query("Q8_exact_bootstrap", """
WITH d AS (SELECT o_orderstatus, avg(o_totalprice) / 1000 AS d FROM orders GROUP BY o_orderstatus), m AS (SELECT (a.d + b.d + c.d) / 3 AS m FROM d a, d b, d c)
SELECT min(m) AS low, quantile_cont(m, 0.5) AS median, max(m) AS high, count(*) AS n FROM m WHERE (SELECT count(*) FROM d) = 3""")
def _(read, spark):
    """Paired differences of three seeds (here: mean price by order status), all 27 resamples."""
    d = read("orders").groupBy("o_orderstatus").agg((F.avg("o_totalprice") / 1000).alias("d")).select("d")
    means = d.withColumnRenamed("d", "a").crossJoin(d.withColumnRenamed("d", "b")).crossJoin(d.withColumnRenamed("d", "c")).select(((F.col("a") + F.col("b") + F.col("c")) / 3).alias("m"))
    return means.agg(F.min("m").alias("low"), Q.quantile("m", 0.5).alias("median"), F.max("m").alias("high"), F.count("*").alias("n"))


@query("Q10_distribution", "SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean, count(*) FILTER (WHERE value > 0) AS positive, count(*) FILTER (WHERE value = 0) AS zero, count(*) FILTER (WHERE value < 0) AS negative FROM events GROUP BY event_type")
def _(read, spark):
    return Q.distribution(read("events"), ["event_type"], "value")


@query("Q12_flat_share", "WITH r AS (SELECT l_orderkey, l_quantity AS c, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS p FROM lineitem) SELECT l_orderkey, avg(CASE WHEN p IS NOT NULL THEN CASE WHEN p = c THEN 1.0 ELSE 0 END END) AS flat, avg(CASE WHEN c < 1 THEN 1.0 ELSE 0 END) AS clipped FROM r GROUP BY l_orderkey")
def _(read, spark):
    return Q.flat_share(read("lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity", "l_quantity")


@query("Q14_missing_requests", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.value > 50 AND c.user_id = e.user_id AND c.event_type = e.event_type)")
def _(read, spark):
    e = read("events")
    return reports.missing(e, e.where("value > 50"), ["user_id", "event_type"]).select("event_id")


@query("Q15_paired_refresh", "SELECT a.l_orderkey, avg(b.l_quantity - a.l_quantity) AS difference FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linenumber % 2 = 1 GROUP BY a.l_orderkey")
def _(read, spark):
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = rows.where("l_linenumber % 2 = 0").withColumn("l_linenumber", F.col("l_linenumber") - 1)
    return reports.paired_difference(rows.where("l_linenumber % 2 = 1"), fresh, ["l_orderkey", "l_linenumber"], "l_quantity", ["l_orderkey"])


@query("Q18_choose_threshold", """
WITH s AS (SELECT n_chars AS score, quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT DISTINCT score FROM s),
r AS (SELECT c.score, sum(label) AS tp, count(*) AS taken, (SELECT sum(label) FROM s) AS t FROM c JOIN s ON s.score >= c.score GROUP BY c.score)
SELECT min(score) FILTER (WHERE tp / taken >= 0.85 AND tp / t >= 0.3) AS threshold FROM r""")
def _(read, spark):
    rows = read("documents").select("doc_id", F.col("n_chars").alias("score")).join(read("labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return Q.choose_threshold(rows, 0.85, 0.3)


@query("P26_provisional_credit", """
WITH r AS (SELECT user_id AS doc, event_type AS decision, abs(value) AS w, value AS v FROM events), t AS (SELECT doc, sum(w * v) / nullif(sum(w), 0) AS whole FROM r GROUP BY doc)
SELECT r.doc, decision, coalesce(sum(w * v) FILTER (WHERE decision <> 'error') / nullif(sum(w) FILTER (WHERE decision <> 'error'), 0), max(whole)) AS credit FROM r JOIN t ON r.doc = t.doc GROUP BY r.doc, decision""")
def _(read, spark):
    """Linked decisions take the mean of their own assertions, the others the document's."""
    r = read("events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("decision"), F.abs("value").alias("weight"), F.col("value").alias("score"), (F.col("event_type") != "error").alias("linked"))
    return P.provisional_credit(r)