"""Queries over the rest of the catalogue: gates, sources, relations, ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators import compiler, curation, frontier, lattice, producer, profiles, qa, reports, rewrite, segment
from redactum.plans.base import query
from redactum.plans.frontier_queries import SWITCH, _sky
from redactum.plans.span_queries import _spans, with_spans
from redactum.sources import readers

_CH = "SELECT l_suppkey AS item, l_linenumber AS pos, avg(CAST(l_quantity AS INTEGER)) AS count FROM lineitem GROUP BY 1, 2"


def _level_counts(read):
    return read("lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("pos")).agg(F.avg(F.col("l_quantity").cast("int")).alias("count"))


@query("A21_alias_rows", "SELECT 'place' AS type, r_name AS canonical, n_name AS alias FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(read, spark):
    """A curated table (here of 25 rows, the nation table's fixed size) as rows."""
    j = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    table: dict[str, list[str]] = {}
    for r in j.select("r_name", "n_name").collect():
        table.setdefault(r.r_name, []).append(r.n_name)
    return readers.alias_rows("place", table, spark)


@query("A29_store_conflicts", "SELECT user_id, count(DISTINCT event_type) AS results FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def _(read, spark):
    """A result store may hold one result for each identity; conflicts are errors."""
    return reports.conflicts(read("events"), ["user_id"], "event_type")


@query("A3_lines_of_json", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line, n_name AS read_back FROM nation""")
def _(read, spark):
    """Rows as JSON lines with sorted keys, and read back."""
    lines = readers.json_lines(read("nation"), "n_nationkey")
    return readers.from_json_lines(lines, "n_name string, n_nationkey int, n_regionkey int").select("n_nationkey", "line", F.col("n_name").alias("read_back"))


@query("A9_profile_rows", "SELECT p_brand AS type, p_name AS canonical, count(DISTINCT p_type) AS aliases FROM part GROUP BY 1, 2")
def _(read, spark):
    """An artifact of nested maps as rows."""
    row = F.struct(F.array_sort(F.collect_set("p_type")).alias("aliases"), F.array().cast("array<string>").alias("levels"), F.lit(None).cast("double").alias("count"))
    inner = read("part").groupBy("p_brand", "p_name").agg(row.alias("r"))
    nested = inner.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_name", "r"))).alias("entries"))
    return readers.profile_rows(nested.select(F.create_map("p_brand", "entries").alias("profiles"))).select("type", "canonical", F.size("aliases").cast("long").alias("aliases"))


@query("A11_place_levels", "SELECT surface, 'a customer in ' || n_name || '|a customer in ' || r_name AS levels FROM (SELECT lower(c_mktsegment) || ' ' || c_custkey % 97 AS surface, n_name, r_name, row_number() OVER (PARTITION BY lower(c_mktsegment) || ' ' || c_custkey % 97 ORDER BY c_acctbal DESC, n_name DESC, r_name DESC) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE r = 1")
def _(read, spark):
    """A gazetteer: the most populous place of each surface, with its levels."""
    j = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 97).cast("string"))
    g = readers.gazetteer(j.select(name.alias("name"), name.alias("ascii_name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("population")))
    return g.select("surface", F.array_join(producer.place_levels(g, "a customer in", "surface", "country", "region"), "|").alias("levels"))


@query("A13_product_names", "WITH n AS (SELECT p_partkey, lower(unnest([p_name, p_brand, p_type || ' ' || p_name])) AS name FROM part), ok AS (SELECT DISTINCT p_partkey, name FROM n WHERE NOT regexp_matches(name, '[0-9]') AND len(string_split(name, ' ')) <= 4) SELECT a.name, count(DISTINCT a.p_partkey) AS products, count(DISTINCT CASE WHEN b.name <> a.name THEN b.name END) AS aliases FROM ok a JOIN ok b ON a.p_partkey = b.p_partkey GROUP BY a.name")
def _(read, spark):
    names = F.array("p_name", "p_brand", F.concat_ws(" ", "p_type", "p_name"))
    return readers.product_rows(read("part").select("p_partkey", names.alias("names")), "p_partkey").select("name", "products", F.size("aliases").cast("long").alias("aliases"))


@query("A17_order_lines", "SELECT lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code, p_name AS description FROM part WHERE p_size % 2 = 0")
def _(read, spark):
    code = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    line = F.concat(F.lit("00001 "), code, F.when(F.col("p_size") % 2 == 0, " 1 ").otherwise(" 0 "), F.lit("Short words  "), F.col("p_name"))
    return readers.order_lines(read("part").select(line.alias("value")))


@query("B8_singular_phrases", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name || ' ' || p_type || 's boxes glass bodies is ' || p_brand || 's'), ' '), lambda w: CASE WHEN len(w) > 4 AND w LIKE '%ies' THEN w[:len(w) - 3] || 'y' WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:len(w) - 1] ELSE w END), ' ') AS phrase FROM part")
def _(read, spark):
    phrase = F.lower(F.concat("p_name", F.lit(" "), "p_type", F.lit("s boxes glass bodies is "), "p_brand", F.lit("s")))
    return read("part").select("p_partkey", T.singular_words(phrase).alias("phrase"))


@query("B29_filled_templates", "SELECT p_partkey, 'Describe ' || p_name || ' of ' || p_brand || ' briefly.' AS prompt FROM part")
def _(read, spark):
    return read("part").select("p_partkey", producer.filled(F.lit("Describe {name} of {brand} briefly."), name=F.col("p_name"), brand=F.col("p_brand")).alias("prompt"))


def _sql_list(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


@query("B36_generic_levels", f"""WITH w AS (SELECT {_sql_list(producer.GENERIC_PROFESSIONS)} AS g, {_sql_list(producer.FILLER_WORDS)} AS f),
l AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || ' Worker' WHEN 1 THEN upper(g[p_partkey % len(g) + 1]) WHEN 2 THEN p_type || '  professional' ELSE p_name END AS level, [f[p_partkey % len(f) + 1] || ' ' || f[p_size % len(f) + 1], CASE WHEN p_size % 3 = 0 THEN p_name ELSE f[(p_partkey + 7) % len(f) + 1] END] AS aliases, g, f FROM part, w)
SELECT p_partkey, list_contains(g, t) OR (len(string_split(t, ' ')) <= 3 AND (t LIKE '% worker' OR t LIKE '% occupation' OR t LIKE '% professional')) AS generic,
       len(list_filter(aliases, lambda a: len(list_filter(regexp_extract_all(lower(a), '[a-z0-9]+'), lambda x: NOT list_contains(f, x))) > 0)) = 0 AS filler
FROM (SELECT *, regexp_replace(trim(lower(level)), ' +', ' ', 'g') AS t FROM l)""")
def _(read, spark):
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    size, key, filler = F.col("p_size"), F.col("p_partkey"), producer.FILLER_WORDS
    level = F.when(size % 4 == 0, F.concat("p_name", F.lit(" Worker"))).when(size % 4 == 1, F.upper(pick(producer.GENERIC_PROFESSIONS, key))).when(size % 4 == 2, F.concat("p_type", F.lit("  professional"))).otherwise(F.col("p_name"))
    aliases = F.array(F.concat_ws(" ", pick(filler, key), pick(filler, size)), F.when(size % 3 == 0, F.col("p_name")).otherwise(pick(filler, key + 7)))
    return read("part").select("p_partkey", producer.generic_profession(level).alias("generic"), producer.filler_aliases(aliases).alias("filler"))


@query("F2_stop_words", "SELECT p_partkey, CASE p_brand[-1:] WHEN '1' THEN list_contains(['small', 'red'], w) WHEN '2' THEN list_contains(['hot', 'blue', 'large'], w) ELSE false END AS stop FROM (SELECT *, lower(split_part(p_name, ' ', 1)) AS w FROM part)")
def _(read, spark):
    """Each detector profile has a stop list of its own; an unknown profile has none."""
    w = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return read("part").select("p_partkey", profiles.stop_word(w, F.right("p_brand", F.lit(1)), {"1": ["small", "red"], "2": ["hot", "blue", "large"]}).alias("stop"))


@query("F8_type_names", f"SELECT p_partkey, list_contains({_sql_list(lattice.TYPE_LABELS)}, lower(trim(phrase))) AS names_a_type FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ' A ' || split_part(p_name, ' ', 2) WHEN 1 THEN upper({_sql_list(lattice.TYPE_LABELS + ['a box', 'a part'])}[p_partkey % {len(lattice.TYPE_LABELS) + 2} + 1]) ELSE p_type END AS phrase FROM part)")
def _(read, spark):
    some = F.array(*map(F.lit, [*lattice.TYPE_LABELS, "a box", "a part"]))
    phrase = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" A "), F.split_part("p_name", F.lit(" "), F.lit(2)))).when(F.col("p_size") % 3 == 1, F.upper(F.element_at(some, (F.col("p_partkey") % F.size(some) + 1).cast("int")))).otherwise(F.col("p_type"))
    return read("part").select("p_partkey", lattice.is_type_name(phrase).alias("names_a_type"))


@query("F6_grounded", "SELECT event_id, event_type = 'view' OR coalesce(json_extract_string(props, '$.k'), '') LIKE '1%' AS proposed, event_type <> 'click' AND coalesce(trim(json_extract_string(props, '$.k')), '') <> '' AND value > 10 AS evidence FROM events")
def _(read, spark):
    e = read("events").select("event_id", "value", "event_type", F.get_json_object("props", "$.k").alias("k"))
    source, status = F.when(F.col("event_type") == "view", "model-proposed"), F.when(F.col("k").startswith("1"), "model-proposed").otherwise("certified")
    count_evidence = F.when(F.col("event_type") != "click", "read").otherwise(" ")
    return e.select("event_id", producer.model_proposed(source, status).alias("proposed"), producer.model_evidence(count_evidence, F.col("k"), F.when(F.col("value") > 10, F.col("value"))).alias("evidence"))


@query("F12_admissible_counts", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 3 >= 1 AND l_shipdate IS NOT NULL AND CASE l_returnflag WHEN 'A' THEN l_linestatus = 'F' WHEN 'R' THEN l_tax > 0.02 AND l_discount > 0.03 WHEN 'N' THEN l_linestatus = 'F' OR l_suppkey % 2 = 0 ELSE false END THEN l_quantity - 3 END AS count FROM lineitem")
def _(read, spark):
    """Counts with the evidence that their status asks for."""
    status = producer.looked_up(F.col("l_returnflag"), {"A": "certifying", "R": "model-proposed", "N": "proposal-universe"})
    members, universe = F.when(F.col("l_linestatus") == "F", "ref").otherwise(""), F.when(F.col("l_suppkey") % 2 == 0, "u")
    count = producer.admissible_count(F.col("l_quantity") - 3, status, F.col("l_shipdate").cast("string"), members, F.when(F.col("l_tax") > 0.02, "s"), F.when(F.col("l_discount") > 0.03, "e"), universe)
    return read("lineitem").select("l_orderkey", "l_linenumber", count.alias("count"))


@query("F14_legal_signatures", "SELECT l_orderkey, l_linenumber, (l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'R' AND l_linestatus = 'O') AS legal FROM lineitem")
def _(read, spark):
    signatures = spark.createDataFrame([("A", "F"), ("R", "O"), ("A", "F")], "l_returnflag string, l_linestatus string")
    return compiler.legal(read("lineitem"), signatures, ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "legal")


@query("F15_grounded_arguments", with_spans("SELECT s.doc_id, start, instr(text, surface) > 0 AND len(surface) > 8 AS grounded FROM s JOIN documents d ON d.doc_id = s.doc_id"))
def _(read, spark):
    s = _spans(read).join(read("documents").select("doc_id", "text"), "doc_id")
    return s.select("doc_id", "start", ((F.instr("text", F.col("surface")) > 0) & (F.length("surface") > 8)).alias("grounded"))


@query("F24_proposed_violations", f"SELECT item, pos, unnest(list_filter([CASE WHEN count < 24.5 OR count IS NULL THEN 'count' END, CASE WHEN pos % 5 = 0 THEN 'placeholder' END, CASE WHEN pos = 3 OR pos % 5 = 0 THEN 'casing' END, CASE WHEN item % 7 = 0 THEN 'grounding' END], lambda x: x IS NOT NULL)) AS rule FROM ({_CH})")
def _(read, spark):
    """Every rule that a proposed level breaks."""
    c = _level_counts(read).withColumn("level", F.when(F.col("pos") % 5 == 0, "<X_1>").when(F.col("pos") == 3, "Upper Level").otherwise("level"))
    rules = producer.proposed_rules(F.col("level"), F.when(F.col("count") >= 24.5, F.col("count")), F.when(F.col("item") % 7 == 0, " ").otherwise("book"))
    return producer.level_violations(c, rules).select("item", "pos", "rule")


@query("F26_ladder_issues", f"SELECT item, CASE WHEN count = b THEN 'flat' WHEN count < b THEN 'narrows' ELSE 'jumps' END AS issue, count(*) AS n FROM (SELECT item, count, lag(count) OVER (PARTITION BY item ORDER BY pos) AS b FROM ({_CH})) WHERE count <= b OR count > 1.05 * b GROUP BY 1, 2")
def _(read, spark):
    return producer.ladder_issues(_level_counts(read), "item", "pos", "count", jump=1.05)


@query("F21_failure_reasons", "SELECT l_suppkey, array_to_string(list_filter([CASE WHEN avg(l_quantity) > 25.5 THEN 'large' END, CASE WHEN count(DISTINCT l_returnflag) < 3 THEN 'support' END, CASE WHEN max(l_discount) > 0.09 THEN 'threshold' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem GROUP BY 1")
def _(read, spark):
    tests = {"threshold": F.max("l_discount") > 0.09, "support": F.count_distinct("l_returnflag") < 3, "large": F.avg("l_quantity") > 25.5}
    return reports.failure_reasons(read("lineitem"), ["l_suppkey"], tests).withColumn("reasons", F.array_join("reasons", ","))


@query("G13_code_prefix_levels", "SELECT o_orderkey, CASE len(c) WHEN 1 THEN c[:1] ELSE CASE WHEN len(c) > 3 THEN c[:1] || '|' || c[:2] || '|' || c[:4] ELSE c[:1] || '|' || c[:2] END END AS levels FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS c FROM orders)")
def _(read, spark):
    return read("orders").select("o_orderkey", F.array_join(producer.code_levels(F.col("o_orderkey").cast("string"), (1, 2, 4)), "|").alias("levels"))


@query("G15_informative_levels", "SELECT p_partkey, array_to_string(list_filter([p_type, p_name, p_brand], lambda x: NOT list_contains(['small', 'large', 'brand#13', 'red box'], lower(x))), '|') AS levels FROM part")
def _(read, spark):
    return read("part").select("p_partkey", F.array_join(producer.informative(F.array("p_type", "p_name", "p_brand"), ["small", "large", "brand#13", "red box"]), "|").alias("levels"))


@query("G6_level_dispatch", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ['twenty', 'thirty', 'forty', 'fifty', 'sixty'][p_partkey % 5 + 1] || '-something' WHEN 1 THEN 'between ' || (p_partkey % 40 + 10) || ' and ' || 4 * (p_partkey % 40 + 10) || ' mg' END AS first FROM part")
def _(read, spark):
    """The source of levels depends on the type; unknown types abstain."""
    kind = F.element_at(F.array(F.lit("age"), F.lit("QUANTITY"), F.lit("MISC")), (F.col("p_size") % 3 + 1).cast("int"))
    age = ((F.col("p_partkey") % 5 + 2) * 10 + 4).cast("int").cast("string")
    amount = F.concat((2 * (F.col("p_partkey") % 40 + 10)).cast("int").cast("string"), F.lit(" mg"))
    levels = producer.by_type(kind, {"age": lattice.bucket_date(age), "QUANTITY": lattice.bucket_quantity(amount)})
    return read("part").select("p_partkey", F.get(levels, F.lit(0)).alias("first"))


@query("L4_retained", "SELECT event_id, event_type IN ('view', 'click') AND coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) >= 20 AS retained FROM events")
def _(read, spark):
    """Generalisations that the policy keeps are not restored."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    action = F.when(F.col("event_type").isin("view", "click"), "generalize").otherwise("placeholder")
    return read("events").select("event_id", rewrite.retained(action, F.when(k >= 20, "keep").otherwise("restore")).alias("retained"))


@query("N11_flags", "SELECT doc_id, unnest(list_filter([CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN contains(text, 'license') THEN 'license' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS flag FROM documents")
def _(read, spark):
    d = read("documents")
    return curation.review_flags(d, {"long": F.col("n_chars") > 3000, "license": F.contains("text", F.lit("license")), "foreign": F.col("lang") != "en"}, "doc_id")


@query("P8_calibration_pool", """
WITH t AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS vector, l_partkey AS decision, l_returnflag AS action, l_suppkey AS source FROM lineitem),
r AS (SELECT l_orderkey AS doc, l_linenumber AS vector, l_linestatus AS component, max(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3),
u AS (SELECT doc, vector, sum(w * score) / sum(w) AS utility FROM (SELECT *, CASE component WHEN 'F' THEN 2.0 ELSE 1.0 END AS w FROM r WHERE doc % 10 <> 3) GROUP BY 1, 2),
g AS (SELECT p_partkey AS decision, unnest(['A', 'N']) AS action, CAST(p_size AS DOUBLE) AS count_score FROM part),
c AS (SELECT doc, vector, avg(count_score) AS count_score FROM (SELECT DISTINCT doc, vector, t.decision, t.action, count_score FROM t LEFT JOIN g ON t.decision = g.decision AND t.action = g.action) GROUP BY 1, 2 HAVING count(*) = count(count_score)),
s AS (SELECT doc, vector, count(DISTINCT source) AS sources FROM t GROUP BY 1, 2)
SELECT s.doc, s.vector, utility, count_score, sources FROM s JOIN c ON s.doc = c.doc AND s.vector = c.vector JOIN u ON s.doc = u.doc AND s.vector = u.vector""")
def _(read, spark):
    """Vectors with a measured utility (some documents have no weights) and a target for every decision."""
    l = read("lineitem").withColumnsRenamed({"l_orderkey": "doc", "l_linenumber": "vector"})  # noqa: E741
    trajectories = l.select("doc", "vector", F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("decision"), F.col("l_returnflag").alias("action")).distinct()
    results = l.groupBy("doc", "vector", F.col("l_linestatus").alias("component")).agg(F.max("l_discount").alias("score"))
    targets = read("part").select(F.col("p_partkey").alias("decision"), F.explode(F.array(F.lit("A"), F.lit("N"))).alias("action"), F.col("p_size").cast("double").alias("count_score"))
    weights = l.where("doc % 10 <> 3").select("doc", F.col("l_linestatus").alias("component")).distinct().withColumn("weight", F.when(F.col("component") == "F", 2.0).otherwise(1.0))
    return compiler.calibration_pool(trajectories, results, targets, weights)


@query("P17_lambda_menu", f"""WITH s AS (SELECT lam, sum(weight) AS w FROM ({SWITCH}) GROUP BY lam), r AS (SELECT lam, sum(w) OVER (ORDER BY lam) AS c, sum(w) OVER () AS t FROM s)
SELECT min(q) AS q, value FROM (SELECT CAST(q AS DOUBLE) AS q, (SELECT min(lam) FROM r WHERE c >= q * t - 1e-12) AS value FROM (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) v(q)) GROUP BY value""")
def _(read, spark):
    """Weighted log quantiles of switch points, snapped to observed ones: a menu of trade-off weights."""
    s = frontier.switch_points(frontier.upper_hull(_sky(read)))
    q = frontier.weighted_quantiles(s, [0.1, 0.3, 0.5, 0.7, 0.9])
    return q.groupBy("value").agg(F.min("q").alias("q"))


@query("C7_two_clause_windows", r"SELECT doc_id, count(*) AS windows FROM (SELECT doc_id, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$') AS l FROM documents))) WHERE y IS NOT NULL GROUP BY doc_id")
def _(read, spark):
    c = segment.clauses(read("documents"))
    return c.withColumn("next", F.lead("content").over(Window.partitionBy("doc_id").orderBy("clause"))).where("next IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("windows"))


@query("D8_clause_cues", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$')) AS x FROM documents) WHERE regexp_matches(lower(x), '(^|[^a-z])(the|of) [a-z]+ (and|of)([^a-z]|$)') GROUP BY doc_id")
def _(read, spark):
    c = segment.clauses(read("documents")).where(F.lower("content").rlike("(^|[^a-z])(the|of) [a-z]+ (and|of)([^a-z]|$)"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("D10_contradictions", """
WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'patient denies ' || p_name WHEN 1 THEN 'there is no evidence of a tear. then came ' || p_name WHEN 2 THEN 'ruled out for now: ' || p_name WHEN 3 THEN 'it is a ' || p_name ELSE p_type || ' without any ' || p_name END AS text, p_name, p_type, p_size FROM part),
u AS (SELECT *, strpos(text, p_name) - 1 AS a, text || ', and ' || p_type || '!' AS whole FROM t)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'cooccurrence_connector' WHEN p_size % 3 = 0 THEN 'coordination_sibling' WHEN p_size % 5 IN (0, 2, 4) THEN 'negation_scope' END AS reason, regexp_matches(lower(text), '\\b(no|not|without|denies|denied)\\b') AS negated FROM u""")
def _(read, spark):
    """Why a pair asserts nothing: ', and' between its sides is co-occurrence for a cause and a list for one class."""
    size = F.col("p_size") % 5
    text = (
        F.when(size == 0, F.concat(F.lit("patient denies "), "p_name")).when(size == 1, F.concat(F.lit("there is no evidence of a tear. then came "), "p_name"))
        .when(size == 2, F.concat(F.lit("ruled out for now: "), "p_name")).when(size == 3, F.concat(F.lit("it is a "), "p_name")).otherwise(F.concat("p_type", F.lit(" without any "), "p_name"))
    )
    rows = read("part").select("p_partkey", "p_size", "p_name", "p_type", text.alias("t"))
    whole = F.concat("t", F.lit(", and "), "p_type", F.lit("!"))
    start, n = F.instr("t", F.col("p_name")) - 1, F.length("t")
    first = F.struct(start.alias("start"), n.alias("end"))
    second = F.struct((n + 6).alias("start"), (n + 6 + F.length("p_type")).alias("end"))
    reason = compiler.junk_pair(whole, first, second, F.when(F.col("p_size") % 2 == 0, "causes_or_explains").otherwise("prescribed_with"), F.col("p_size") % 3 == 0)
    return rows.select("p_partkey", reason.alias("reason"), compiler.negated(F.col("t")).alias("negated"))


_LITERALS = {"license": r"[A-Z][a-z]+ License", "the": r"[Tt]he [a-z]+"}


@query("D13_context_literals", "SELECT doc_id, type, count(*) AS n, min(literal) AS first FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest(regexp_extract_all(text, '{p}')) AS literal FROM documents" for k, p in _LITERALS.items()) + ") GROUP BY 1, 2")
def _(read, spark):
    """Typed literals of a document with their places."""
    return compiler.context_literals(read("documents"), _LITERALS).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min("literal").alias("first"))


@query("H4_missing_aliases", "WITH p AS (SELECT DISTINCT p_brand AS type, p_type AS canonical, p_name AS alias FROM part WHERE p_size > 20), r AS (SELECT DISTINCT 'alt ' || p_name AS alias, p_type AS canonical FROM part) SELECT * FROM p UNION SELECT DISTINCT p.type, r.canonical, r.alias FROM r JOIN p ON r.canonical = p.canonical")
def _(read, spark):
    """A resolved alias is added where its generic exists."""
    p = read("part")
    profiles_ = p.where("p_size > 20").select(F.col("p_brand").alias("type"), F.col("p_type").alias("canonical"), F.col("p_name").alias("alias")).distinct()
    return producer.add_resolved_aliases(profiles_, p.select(F.concat(F.lit("alt "), "p_name").alias("alias"), F.col("p_type").alias("canonical")).distinct())


@query("I4_best_match", "SELECT a.vec_id, max(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))) AS best FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id")
def _(read, spark):
    """The stated queries (ids divisible by 50) against the rows of their label, in blocks: a label may be hot."""
    v = read("embeddings").select("vec_id", "label", "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("l"), F.col("embedding").alias("e"))
    met = profiles.against_all(q, v, "vec_id").where("l = label AND q <> vec_id")
    return met.groupBy(F.col("q").alias("vec_id")).agg(F.max(profiles.dot(F.col("e"), F.col("embedding"))).alias("best"))


@query("J10_universe_counts", "SELECT 'a customer in ' || n_name AS level, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'a customer in ' || r_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(read, spark):
    j = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lattice.universe_counts(j, "a customer in", "c_name", "n_name", "r_name")


@query("O2_best_accepted", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0 WHEN split_part(p_name, ' ', 2) = ANY(['box', 'pipe']) OR p_size % 4 = 1 THEN 1.0 ELSE 0.0 END AS score FROM part")
def _(read, spark):
    """No accepted value, one of two fixed nouns, or the name itself."""
    size = F.col("p_size") % 4
    accepted = F.when(size == 0, F.array().cast("array<string>")).when(size == 1, F.array(F.lit("zzz"), F.col("p_name"))).otherwise(F.array(F.lit("box"), F.lit("pipe")))
    return read("part").select("p_partkey", qa.answer_score(F.col("p_name"), accepted).alias("score"))


@query("O19_first_free_level", "WITH l AS (SELECT l_orderkey, l_linenumber, min(p_name) AS level FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), t AS (SELECT DISTINCT l_orderkey, split_part(p_name, ' ', 2) AS term FROM lineitem JOIN part ON p_partkey = l_suppkey), h AS (SELECT l.l_orderkey, l_linenumber, level, count(term) > 0 AS hit FROM l LEFT JOIN t ON l.l_orderkey = t.l_orderkey AND contains(' ' || level || ' ', ' ' || term || ' ') GROUP BY 1, 2, 3) SELECT l_orderkey, arg_min(level, (hit, l_linenumber)) AS level FROM h GROUP BY 1")
def _(read, spark):
    """The first level of each plan that holds no protected surface of another decision."""
    names = read("part").select("p_partkey", "p_name")
    l = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # noqa: E741
    plans = l.join(names, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "l_linenumber").agg(F.min("p_name").alias("level"))
    taken = l.join(names, F.col("l_suppkey") == F.col("p_partkey")).select("l_orderkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term")).distinct()
    return compiler.first_free_level(plans, taken, key="l_orderkey", at="l_linenumber", level="level")


@query("O20_set_rows", "SELECT l_orderkey, l_returnflag, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS members FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1")
def _(read, spark):
    return compiler.set_rows(read("lineitem"), ["l_orderkey", "l_returnflag"], "l_partkey").withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query("O22_second_pass", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority[1] IN ('1', '2') AND o_orderstatus = 'P') THEN 'repair' ELSE 'missed' END AS why FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority[1] IN ('1', '2') AND o_orderstatus = 'P')")
def _(read, spark):
    o = read("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("reason"))
    return compiler.second_pass(read("customer").select("c_custkey"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "c_custkey", ["1", "2"])


@query("O24_promoted_literals", "WITH l AS (SELECT DISTINCT l_orderkey, p_name || ' ' || lower(p_type) AS literal FROM lineitem JOIN part ON l_partkey = p_partkey), o AS (SELECT l_orderkey, l_linenumber AS occurrence, lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS surface, p_brand AS level FROM lineitem JOIN part ON l_suppkey = p_partkey WHERE l_returnflag <> 'R'), m AS (SELECT l.l_orderkey, literal, min({'o': occurrence, 's': surface, 'l': level}) AS x FROM l JOIN o ON l.l_orderkey = o.l_orderkey AND len(list_filter(list_filter(string_split(surface, ' '), lambda w: len(w) > 2), lambda w: NOT list_contains(string_split(literal, ' '), w))) = 0 GROUP BY 1, 2) SELECT l.l_orderkey, l.literal, x.o AS occurrence, x.s AS surface, x.l AS level FROM l LEFT JOIN m ON l.l_orderkey = m.l_orderkey AND l.literal = m.literal")
def _(read, spark):
    """Literals whose words hold a controlled surface are linked to it."""
    l, p = read("lineitem"), read("part")  # noqa: E741
    literal = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    literals = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", literal.alias("literal"))
    surface = F.concat(F.lower("p_type"), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)))
    o = l.join(p, F.col("l_suppkey") == F.col("p_partkey")).select("l_orderkey", F.col("l_linenumber").alias("occurrence"), surface.alias("surface"), (F.col("l_returnflag") != "R").alias("controlled"), F.col("p_brand").alias("level"))
    return compiler.promoted_literals(literals, o, key="l_orderkey")


@query("O31_span_inventory", with_spans("SELECT doc_id, type, count(*) AS n, min(start) AS first FROM s GROUP BY 1, 2"))
def _(read, spark):
    return _spans(read).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query("O33_migrated", "SELECT a.p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'gone' WHEN a.p_size > 25 AND a.p_type <> 'SMALL' THEN 'changed' ELSE 'migrated' END AS state FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey AND b.p_retailprice < 1400")
def _(read, spark):
    """Assertions move to a new artifact where the frozen meaning is the same."""
    old = read("part").select("p_partkey", "p_name", "p_type")
    new = read("part").where("p_retailprice < 1400").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, "SMALL").otherwise(F.col("p_type")).alias("p_type"))
    return compiler.migrated(old, new, "p_partkey", ["p_name", "p_type"])


@query("R7_feedback", "SELECT event_id, CASE event_type WHEN 'error' THEN 'Level ' || k || ' is counted ' || CAST(floor(value) AS BIGINT) || ' times.' WHEN 'view' THEN 'Broaden ' || k || '.' END AS hint FROM (SELECT *, coalesce(json_extract_string(props, '$.k'), 'this rung') AS k FROM events WHERE event_type <> 'click')")
def _(read, spark):
    e = read("events").where("event_type <> 'click'")
    rows = e.select("event_id", F.col("event_type").alias("reason"), F.get_json_object("props", "$.k").alias("level"), F.floor("value").cast("long").alias("count"))
    return producer.rejection_feedback(rows, {"error": "Level {level} is counted {count} times.", "view": "Broaden {level}."}).select("event_id", "hint")


@query("Q20_bootstrap", qa.bootstrap_sql("SELECT c_custkey, c_acctbal FROM customer", "c_acctbal", "c_custkey", 100, 3))
def _(read, spark):
    return qa.bootstrap_interval(read("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", samples=100, seed=3)


@query("M9_leakage", "SELECT doc_id, CAST(count(*) AS BIGINT) AS leaked FROM (" + with_spans("SELECT DISTINCT s.doc_id, surface FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE contains(lower(text), lower(surface))") + ") GROUP BY doc_id")
def _(read, spark):
    s = _spans(read).select("doc_id", "surface").distinct().join(read("documents").select("doc_id", "text"), "doc_id")
    return s.where(F.instr(F.lower("text"), F.lower("surface")) > 0).groupBy("doc_id").agg(F.count("*").alias("leaked"))
