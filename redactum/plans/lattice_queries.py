"""Queries over hierarchies, counts, profile tables and their gates.

Profiles come from parts (type: manufacturer word, canonical: name), hierarchies from region > nation > customer.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators import lattice as G
from redactum.operators import producer
from redactum.operators import profiles as H
from redactum.plans.base import query

EDGES = "SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region"
ANCESTORS = f"WITH RECURSIVE e AS ({EDGES}), a AS (SELECT child AS node, parent AS ancestor, 1 AS hops FROM e UNION ALL SELECT a.node, e.parent, hops + 1 FROM a JOIN e ON a.ancestor = e.child WHERE hops < 4)"


def _edges(read):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = read("nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    c = read("customer").select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent"))
    return n.unionByName(c).unionByName(read("region").select(key("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))


@query("G1_bucket_date", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%B') || ' ' || y || '|the ' || part || ' ' || d || 's|the ' || d || 's' WHEN 1 THEN 'the ' || part || ' ' || d || 's|the ' || d || 's'
 ELSE 'the ' || ['winter','winter','spring','spring','spring','summer','summer','summer','autumn','autumn','autumn','winter'][month(o_orderdate)] END AS levels
FROM (SELECT *, year(o_orderdate) AS y, year(o_orderdate) // 10 * 10 AS d, CASE WHEN year(o_orderdate) % 10 < 4 THEN 'early' WHEN year(o_orderdate) % 10 < 7 THEN 'mid' ELSE 'late' END AS part FROM orders)""")
def _(read, spark):
    t = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "MMMM"))
    return read("orders").select("o_orderkey", F.array_join(G.bucket_date(t), "|").alias("levels"))


@query("G2_bucket_quantity", "SELECT l_orderkey, l_linenumber, 'between ' || format('{:,}', q * 500) || ' and ' || format('{:,}', q * 2000) || ' dollars' AS level FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)")
def _(read, spark):
    q = F.col("l_quantity").cast("long")
    return read("lineitem").select("l_orderkey", "l_linenumber", G.bucket_quantity(F.concat(F.lit("$"), q.cast("string"), F.lit("k")))[0].alias("level"))


@query("G3_containment_chain", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'a customer in ' || r_name ELSE 'a customer in ' || n_name || '|a customer in ' || r_name END AS levels FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(read, spark):
    """Units above a place, narrowest first; a unit named like the place (every fifth here) is none of its levels."""
    j = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = j.withColumn("place", F.when(F.col("c_custkey") % 5 == 0, F.lower("n_name")).otherwise(F.col("c_name")))
    return j.select("c_custkey", F.array_join(producer.place_levels(j, "a customer in", "place", "n_name", "r_name"), "|").alias("levels"))


@query("G7_with_placeholder", "SELECT p_partkey, p_type || '|<PART>' AS levels FROM part")
def _(read, spark):
    return read("part").select("p_partkey", F.array_join(G.with_placeholder(F.array("p_type"), F.lit("part")), "|").alias("levels"))


@query("F7_filtered_levels", "SELECT p_partkey, 'number 7' AS levels FROM part")
def _(read, spark):
    """Levels that hold the surface, repeat, or only name a type go; 'number 7' stays."""
    surface = F.split_part("p_name", F.lit(" "), F.lit(2))
    levels = F.array(F.col("p_name"), F.lit("number 7"), F.lit("a person"), F.lit("Number 7"))
    return read("part").select("p_partkey", F.array_join(G.filtered_levels(levels, surface, G.TYPE_LABELS), "|").alias("levels"))


@query("G11_entailment", "SELECT p_partkey, unnest([1, 2, 3]) AS pos, unnest([p_type || '>' || p_type || '/' || p_brand || '/part', p_brand || '>' || p_brand || '/part', 'part>part']) AS entails FROM part")
def _(read, spark):
    e = G.entailed(F.array("p_type", "p_brand", F.lit("part")))
    return read("part").select("p_partkey", F.posexplode(e).alias("i", "x")).select("p_partkey", (F.col("i") + 1).alias("pos"), F.concat("x.level", F.lit(">"), F.array_join("x.entails", "/")).alias("entails"))


@query("G12_ancestors", ANCESTORS + " SELECT node, ancestor, CAST(min(hops) AS INTEGER) AS hops FROM a GROUP BY ALL")
def _(read, spark):
    return G.ancestors(_edges(read))


@query("H11_descendants", ANCESTORS + " SELECT ancestor AS node, count(DISTINCT node) AS descendants FROM a GROUP BY ancestor")
def _(read, spark):
    return G.descendants(_edges(read))


@query("J5_leaf_counts", ANCESTORS + " SELECT ancestor AS node, count(DISTINCT node) AS leaves FROM a WHERE node NOT IN (SELECT parent FROM e) GROUP BY ancestor")
def _(read, spark):
    return G.leaf_counts(_edges(read))


@query("J1_geo_counts", "SELECT 'n_name' AS grain, lower(n_name) AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 UNION ALL SELECT 'r_name', lower(r_name), count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 2 UNION ALL SELECT 'nations', lower(r_name), count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 2")
def _(read, spark):
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return producer.place_counts(customers, "n_name", "r_name").unionByName(producer.place_counts(places.withColumnRenamed("r_name", "nations"), "nations"))


@query("J2_place_count", "WITH c AS (SELECT lower(n_name) AS n, lower(r_name) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN (SELECT nullif(count(*), 0) FROM c WHERE c.r = lower(r_name)) WHEN 1 THEN (SELECT nullif(count(*), 0) FROM c WHERE c.n = lower(n_name)) END AS count FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(read, spark):
    """'a customer in X' resolves to the region, else the nation; other fills have no count."""
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = producer.place_counts(read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")), "n_name", "r_name")
    s = read("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.col("s_suppkey") % 3
    fill = F.when(kind == 0, F.concat(F.lit("A customer in "), F.upper("r_name"))).when(kind == 1, F.concat(F.lit(" a customer in "), "n_name")).otherwise(F.concat(F.lit("a place in "), "n_name"))
    return producer.fill_count(s.select("s_suppkey", fill.alias("fill")), counts, "fill", "a customer in", ["r_name", "n_name"]).select("s_suppkey", "count")


@query("J3_date_count", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 3652.0 ELSE 30.0 END AS count FROM orders")
def _(read, spark):
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    levels = G.bucket_date(day)
    return read("orders").select("o_orderkey", G.date_count(F.when(F.col("o_orderkey") % 2 == 0, levels[2]).otherwise(levels[0]), day).alias("count"))


@query("J4_quantity_count", "SELECT l_orderkey, l_linenumber, greatest((q * 2 - q * 0.5) / CASE WHEN q % 100 = 0 THEN 100 WHEN q % 10 = 0 THEN 10 ELSE 1 END + 1, 1.0) AS count FROM (SELECT *, CAST(l_quantity AS BIGINT) * 2 + 20 AS q FROM lineitem)")
def _(read, spark):
    q = (F.col("l_quantity").cast("long") * 2 + 20).cast("string")
    return read("lineitem").select("l_orderkey", "l_linenumber", G.quantity_count(G.bucket_quantity(q)[0], q).alias("count"))


@query("J6_anonymity_count", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1e9 WHEN 2 THEN 10.0 ELSE 1.0 END AS count FROM lineitem")
def _(read, spark):
    """The original, a type label, a decade of age, something unreadable."""
    age = F.lit("34")
    fill = F.element_at(F.array(age, F.lit("A place"), F.lit("thirty-something"), F.lit("xyzzy blorp")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return read("lineitem").select("l_orderkey", "l_linenumber", G.anonymity_count(fill, F.lit("age"), age, F.lit(None).cast("double")).alias("count"))


LEVELS = "SELECT c_custkey AS item, unnest([1, 2]) AS pos, unnest([nn, rn]) AS count FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS nn, count(*) OVER (PARTITION BY n_regionkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _levels(read):
    c = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = c.groupBy("c_nationkey").agg(F.count("*").alias("nn"))
    r = c.groupBy("n_regionkey").agg(F.count("*").alias("rn"))
    rows = c.join(n, "c_nationkey").join(r, "n_regionkey")
    return rows.select(F.col("c_custkey").alias("item"), F.posexplode(F.array("nn", "rn")).alias("p", "count")).select("item", (F.col("p") + 1).alias("pos"), "count")


@query("J7_level_counts", LEVELS)
def _(read, spark):
    return _levels(read)


@query("J8_profile_scores", f"WITH a AS (SELECT item, pos, count, CASE WHEN item % 5 = 0 AND pos = 1 THEN 'keep' WHEN item % 5 = 1 AND pos = 2 THEN 'placeholder' ELSE 'level' END AS mode FROM ({LEVELS})) SELECT item, pos, CASE mode WHEN 'keep' THEN 0.0 WHEN 'placeholder' THEN 1.0 ELSE CASE WHEN max(ln(count)) OVER w = 0 THEN 1.0 ELSE ln(count) / max(ln(count)) OVER w END END AS score FROM a WINDOW w AS (PARTITION BY item % 7, item)")
def _(read, spark):
    mode = F.when((F.col("item") % 5 == 0) & (F.col("pos") == 1), "keep").when((F.col("item") % 5 == 1) & (F.col("pos") == 2), "placeholder").otherwise("level")
    a = _levels(read).withColumns({"mode": mode, "doc": F.col("item") % 7, "decision": F.col("item"), "action": F.col("pos")})
    return G.profile_scores(a).select("item", "pos", "score")


@query("J9_document_score", f"WITH s AS (SELECT item % 7 AS doc, CASE WHEN max(ln(count)) OVER (PARTITION BY item) = 0 THEN 1.0 ELSE ln(count) / max(ln(count)) OVER (PARTITION BY item) END AS score FROM ({LEVELS})) SELECT doc, avg(score) AS score FROM s GROUP BY doc")
def _(read, spark):
    a = _levels(read).withColumns({"mode": F.lit("level"), "doc": F.col("item") % 7, "decision": F.col("item"), "action": F.col("pos")})
    return G.profile_scores(a).groupBy("doc").agg(F.avg("score").alias("score"))


@query("J11_minimum_action", f"SELECT item, pos FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY count, pos) AS r FROM ({LEVELS})) WHERE r = 1")
def _(read, spark):
    return _levels(read).groupBy("item").agg(F.min(F.struct("count", "pos")).alias("x")).select("item", "x.pos")


@query("J12_normalized", "SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE greatest(0.0, least(1.0, l_quantity / max(l_quantity) OVER w)) END AS normal FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def _(read, spark):
    return G.normalized(read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "normal")


CHAIN = "SELECT l_suppkey AS item, l_linenumber AS pos, avg(CAST(l_quantity AS INTEGER)) AS count FROM lineitem GROUP BY 1, 2"


def _chain(read):
    return read("lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("pos")).agg(F.avg(F.col("l_quantity").cast("int")).alias("count"))


@query("F23_monotone_violations", f"SELECT item, pos FROM (SELECT item, pos, count, lag(count) OVER (PARTITION BY item ORDER BY pos) AS b FROM ({CHAIN})) WHERE count < b")
def _(read, spark):
    return G.monotone_violations(_chain(read), ["item"]).select("item", "pos")


@query("F25_ladder_defects", f"SELECT item, CASE WHEN n < 2 THEN 'short' WHEN bad THEN 'invalid' WHEN down THEN 'not_monotone' WHEN lo = hi THEN 'no_expansion' END AS defect FROM (SELECT item, count(*) AS n, bool_or(count < 1) AS bad, coalesce(bool_or(count < b), false) AS down, min(count) AS lo, max(count) AS hi FROM (SELECT item, count, lag(count) OVER (PARTITION BY item ORDER BY pos) AS b FROM ({CHAIN})) GROUP BY item) WHERE n < 2 OR bad OR down OR lo = hi")
def _(read, spark):
    return G.ladder_defects(_chain(read), ["item"])


@query("F1_noise_spans", """
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN true WHEN p_size % 6 = 1 THEN false WHEN p_size % 6 = 2 THEN true WHEN p_size % 6 = 3 THEN true WHEN p_size % 6 = 4 THEN false ELSE false END AS noise FROM part""")
def _(read, spark):
    surface = F.element_at(F.array(F.lit("Ace Wrap"), F.lit("MS"), F.lit("lower back"), F.lit("x"), F.col("p_type"), F.lit("knee")), (F.col("p_size") % 6 + 1).cast("int"))
    kind = F.when(F.col("p_size") % 6 == 5, "PERSON").otherwise("health_condition")
    return read("part").select("p_partkey", H.is_noise(surface, kind).alias("noise"))


@query("F5_gate_chain", f"""
WITH c AS (SELECT item, pos, 'level ' || pos AS level, count FROM ({CHAIN})),
o AS (SELECT *, CASE WHEN level = 'level 3' THEN 'same' WHEN level = 'level 4' THEN 'generic' WHEN count < 1 THEN 'count' END AS own FROM c),
k AS (SELECT *, count(CASE WHEN own IS NULL THEN count END) OVER w AS n, min(CASE WHEN own IS NULL THEN count END) OVER w AS lo, max(CASE WHEN own IS NULL THEN count END) OVER w AS hi FROM o WINDOW w AS (PARTITION BY item))
SELECT item, pos, coalesce(own, CASE WHEN n < 2 THEN 'levels' WHEN lo = hi THEN 'flat' WHEN hi < 27 THEN 'narrow' END, 'accepted') AS reason FROM k""")
def _(read, spark):
    c = _chain(read).withColumns({"level": F.concat(F.lit("level "), F.col("pos").cast("string")), "surface": F.lit("Level 3")})
    return H.gate_chain(c, floor=27.0, generic=["level 4"]).select("item", "pos", F.coalesce("reason", F.lit("accepted")).alias("reason"))


PROFILES = "SELECT p_brand AS type, p_name AS canonical, p_type AS alias, CAST(p_size AS DOUBLE) AS count, p_partkey FROM part"


def _profiles(read):
    return read("part").groupBy(F.col("p_brand").alias("type"), F.col("p_name").alias("canonical")).agg(F.collect_set("p_type").alias("aliases"), F.max(F.col("p_size").cast("double")).alias("count"))


@query("H1_surface_index", f"SELECT type, lower(s) AS surface, min(canonical) AS canonical FROM (SELECT type, canonical, canonical AS s FROM ({PROFILES}) UNION SELECT type, canonical, alias FROM ({PROFILES})) GROUP BY 1, 2")
def _(read, spark):
    return H.surface_index(_profiles(read))


@query("H2_lookup", f"WITH i AS (SELECT type, lower(s) AS surface, min(canonical) AS canonical FROM (SELECT type, canonical, canonical AS s FROM ({PROFILES}) UNION SELECT type, canonical, alias FROM ({PROFILES})) GROUP BY 1, 2) SELECT p_partkey, i.canonical FROM part LEFT JOIN i ON i.type = p_brand AND i.surface = lower(p_type)")
def _(read, spark):
    s = read("part").select("p_partkey", F.col("p_brand").alias("type"), F.concat(F.upper("p_type"), F.lit("s")).alias("surface"))
    return H.lookup(s, H.surface_index(_profiles(read))).select("p_partkey", "canonical")


@query("H1_level_counts", "SELECT p_brand AS type, lower(p_type) AS level, coalesce(max(CASE WHEN p_size % 2 = 0 THEN p_size END), max(p_size)) AS count FROM part GROUP BY 1, 2")
def _(read, spark):
    rows = read("part").select(F.col("p_brand").alias("type"), F.col("p_type").alias("level"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("explicit"), F.col("p_size").alias("legacy"))
    return H.level_counts(rows)


@query("H14_unambiguous", "SELECT name, min(p_brand) AS p_brand FROM (SELECT p_name || ' ' || p_size || p_type AS name, p_brand FROM part) GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def _(read, spark):
    return H.unambiguous(read("part").select(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), "p_type").alias("name"), "p_brand"), "name", "p_brand")


@query("H9_best_label", "SELECT p_name AS surface, p_brand AS type, p_retailprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_brand) AS r FROM part) WHERE r = 1")
def _(read, spark):
    return H.best_label(read("part").select(F.col("p_name").alias("surface"), F.col("p_brand").alias("type"), F.col("p_retailprice").alias("score")))


@query("H10_majority_tag", "SELECT p_name, p_brand, n FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_brand) AS r FROM (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1")
def _(read, spark):
    return H.majority(read("part"), "p_name", "p_brand")


@query("H12_prefix_members", "SELECT prefix, count(DISTINCT code) AS members FROM (SELECT CAST(o_orderkey AS VARCHAR) AS code, unnest([CAST(o_orderkey AS VARCHAR)[:1], CAST(o_orderkey AS VARCHAR)[:3], CAST(o_orderkey AS VARCHAR)[:4]]) AS prefix FROM orders) GROUP BY prefix")
def _(read, spark):
    return H.prefix_members(read("orders").select(F.col("o_orderkey").cast("string").alias("code")), "code", (1, 3, 4))


@query("H17_missing_profiles", "SELECT DISTINCT p_name || ' ' || p_size AS p_name FROM part WHERE lower(p_name || ' ' || p_size) NOT IN (SELECT lower(p_name) || ' ' || p_size FROM part WHERE p_type = 'SMALL')")
def _(read, spark):
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("p_name")
    known = read("part").where("p_type = 'SMALL'").select(F.upper(F.concat(F.lit(" "), "p_name", F.lit("  "), F.col("p_size").cast("string"))).alias("p_name"))
    return producer.without_profile(read("part").select(name), known, "p_name")


_SIDE = "SELECT p_brand AS type, p_type AS canonical, list_sort(list(DISTINCT p_name)) AS aliases, max(p_size) AS count FROM part WHERE p_size {} GROUP BY 1, 2"


@query("H18_merge_profiles", f"SELECT coalesce(a.type, b.type) AS type, coalesce(a.canonical, b.canonical) AS canonical, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.aliases, []), coalesce(b.aliases, [])))), ';') AS aliases, greatest(a.count, b.count) AS count, CASE WHEN a.count IS NULL THEN 'incoming' WHEN b.count IS NULL THEN 'existing' ELSE 'both' END AS origin FROM ({_SIDE.format('< 30')}) a FULL JOIN ({_SIDE.format('> 20')}) b ON a.type = b.type AND a.canonical = b.canonical")
def _(read, spark):
    side = lambda rows: rows.groupBy(F.col("p_brand").alias("type"), F.col("p_type").alias("canonical")).agg(F.collect_set("p_name").alias("aliases"), F.max("p_size").alias("count"))
    p = read("part")
    return H.merge_profiles(side(p.where("p_size < 30")), side(p.where("p_size > 20"))).withColumn("aliases", F.array_join("aliases", ";"))


@query("H20_merge_rows", "SELECT p_brand AS type, p_type AS surface, array_to_string(list_sort(list(DISTINCT p_name)), ';') AS aliases, max(p_size) AS count FROM part GROUP BY 1, 2")
def _(read, spark):
    rows = read("part").select(F.col("p_brand").alias("type"), F.col("p_type").alias("surface"), F.col("p_name").alias("alias"), F.col("p_size").alias("count"))
    return H.merge_rows(rows).withColumn("aliases", F.array_join("aliases", ";"))


@query("R19_duplicate_claims", f"SELECT type, lower(s) AS surface, count(DISTINCT canonical) AS claims FROM (SELECT type, canonical, canonical AS s FROM ({PROFILES}) UNION SELECT type, canonical, alias FROM ({PROFILES})) GROUP BY 1, 2 HAVING count(DISTINCT canonical) > 1")
def _(read, spark):
    return H.duplicate_claims(_profiles(read))


COSINE = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x))) + 1e-8)"
VECTORS = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"


@query("I1_retrieve", f"""
WITH v AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM ({VECTORS})),
s AS (SELECT a.vec_id AS query, b.vec_id AS row, b.label AS canonical, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS score FROM v a, v b WHERE a.vec_id % 50 = 0)
SELECT query, canonical, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row) AS r FROM s WHERE score >= 0.2) WHERE r <= 5 GROUP BY query, canonical""")
def _(read, spark):
    v = read("embeddings").select("vec_id", "label", H.unit(F.col("embedding")).alias("v"))
    return H.retrieve(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "v"), v.select(F.col("vec_id").alias("row"), F.col("label").alias("canonical"), "v"), floor=0.2)


@query("I2_cosine_neighbours", f"SELECT a.vec_id, {COSINE} AS cos FROM ({VECTORS}) a JOIN ({VECTORS}) b ON b.vec_id = a.vec_id + 1")
def _(read, spark):
    v = read("embeddings").select("vec_id", "embedding")
    o = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(o, "vec_id").select("vec_id", H.cosine(F.col("embedding"), F.col("other")).alias("cos"))


@query("I12_nearest_words", """
WITH w AS (SELECT DISTINCT p_name AS k, unnest(string_split(lower(p_name), ' ')) AS w FROM part), n AS (SELECT k, count(*) AS n FROM w GROUP BY k),
s AS (SELECT a.k, b.k AS other, count(*) AS s FROM w a JOIN w b ON a.w = b.w AND a.k <> b.k GROUP BY ALL),
j AS (SELECT s.k, other, s / (x.n + y.n - s) AS jaccard FROM s JOIN n x ON x.k = s.k JOIN n y ON y.k = s.other)
SELECT k, other, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY jaccard DESC, other) AS r FROM j WHERE jaccard > 0.3) WHERE r <= 3""")
def _(read, spark):
    rows = read("part").select(F.col("p_name").alias("k")).distinct().withColumn("w", F.array_distinct(F.split(F.lower("k"), " ")))
    return H.nearest_by_words(rows, "k", "w")


@query("H8_fuzzy_matches")
def _(read, spark):
    p = read("part").select("p_name").distinct()
    return H.fuzzy_matches(p.select(F.col("p_name").alias("id"), F.col("p_name").alias("surface")), p.select(F.col("p_name").alias("row"), F.concat("p_name", F.lit("s")).alias("surface")), ratio=0.9)


@query("R13_depth_ranks", "SELECT level, avg(pos / greatest(1, n - 1)) AS rank FROM (SELECT unnest(l) AS level, unnest(range(0, len(l))) AS pos, len(l) AS n FROM (SELECT string_split(p_name, ' ') AS l FROM part)) GROUP BY level")
def _(read, spark):
    return H.depth_ranks(read("part").select(F.split("p_name", " ").alias("levels")))


@query("R14_pooled_counts", f"""
WITH c AS (SELECT item, pos, count AS v FROM ({CHAIN})), p AS (SELECT item, pos FROM c)
SELECT item, pos, round_even(greatest_lower, 2) AS pooled FROM (SELECT p.item, p.pos, (SELECT max(m) FROM (SELECT a.pos AS lo, min(m) AS m FROM (SELECT x.pos, y.pos AS hi, (SELECT avg(v) FROM c z WHERE z.item = x.item AND z.pos BETWEEN x.pos AND y.pos) AS m FROM c x JOIN c y ON x.item = y.item AND x.pos <= y.pos WHERE x.item = p.item AND x.pos <= p.pos AND y.pos >= p.pos) a GROUP BY a.pos)) AS greatest_lower FROM p)""")
def _(read, spark):
    return H.pooled_counts(_chain(read).select("item", "pos", F.col("count").alias("value"), F.lit(1.0).alias("weight")), "item")


@query("R12_canonicalize", "SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'Brand one' ELSE p_brand END AS level FROM part")
def _(read, spark):
    variants = read("part").select(F.col("p_brand").alias("variant")).distinct().where(F.col("variant").endswith("1")).withColumn("level", F.lit("Brand one"))
    return H.canonicalize(read("part").select("p_partkey", F.col("p_brand").alias("level")), variants)


@query("A4_append_unique", "SELECT count(*) AS n, min(event_id) AS first FROM (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id < 100) GROUP BY user_id)")
def _(read, spark):
    e = read("events").select("event_id", F.col("user_id").alias("item_id"))
    first = e.where("event_id % 2 = 1").groupBy("item_id").agg(F.min("event_id").alias("event_id"))
    return H.append_unique(e.where("event_id < 100"), first, "item_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("S2_event_audit", "SELECT event_type AS code, CASE WHEN value > 50 THEN 'review' ELSE 'keep' END AS action, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT l_returnflag, 'line', count(*) FROM lineitem GROUP BY ALL")
def _(read, spark):
    a = read("events").select(F.col("event_type").alias("code"), F.when(F.col("value") > 50, "review").otherwise("keep").alias("action"))
    return H.events_report([a, read("lineitem").select(F.col("l_returnflag").alias("code"), F.lit("line").alias("action"))])


@query("S1_ladder_jumps", f"SELECT item, pos, log10(count / b) AS jump FROM (SELECT item, pos, count, lag(count) OVER (PARTITION BY item ORDER BY pos) AS b FROM ({LEVELS})) WHERE b IS NOT NULL")
def _(read, spark):
    w = Window.partitionBy("item").orderBy("pos")
    return _levels(read).withColumn("b", F.lag("count").over(w)).where("b IS NOT NULL").select("item", "pos", F.log10(F.col("count") / F.col("b")).alias("jump"))


@query("B23_entity_key", "SELECT p_partkey, lower(coalesce(CASE WHEN p_size < 20 THEN p_type END, p_name)) AS key FROM part")
def _(read, spark):
    entry = F.when(F.col("p_size") < 20, F.col("p_type"))
    return read("part").select("p_partkey", T.canonical(F.coalesce(entry, "p_name")).alias("key"))
