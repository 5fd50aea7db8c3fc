"""Queries over environments, relations and level production."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators import environment as N
from redactum.operators import compiler, lattice, patterns, producer, relations, reports
from redactum.plans.base import query
from redactum.plans.span_queries import CANON, with_spans


def _spans(read):
    return patterns.detect(read("documents"))


@query("P1_freeze_environment", with_spans(f"SELECT doc_id, type, {CANON.format('surface')} AS entity, count(*) AS n, min(start) AS first FROM s GROUP BY ALL"))
def _(read, spark):
    _, d = N.freeze(_spans(read))
    return d.select("doc_id", "type", "entity", F.size("occurrences").cast("long").alias("n"), F.col("occurrences")[0].start.alias("first"))


@query("P28_stable_ids", """SELECT n_nationkey, 'd' || sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}')[:16] AS id FROM nation""")
def _(read, spark):
    return read("nation").select("n_nationkey", N.stable_id("d", "n_regionkey", "n_name").alias("id"))


@query("P2_same_rows", "SELECT 'left' AS side, count(*) AS n FROM part WHERE p_size % 10 = 0 UNION ALL SELECT 'right', count(*) FROM part WHERE p_size % 10 = 0")
def _(read, spark):
    p = read("part").select("p_partkey", "p_name", "p_size")
    changed = p.withColumn("p_name", F.when(F.col("p_size") % 10 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    return N.same_rows(p, changed.withColumn("p_size", F.lit(0)), ["p_size"])


@query("P4_violations", "WITH o AS (SELECT l_suppkey AS doc_id, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) + l_linenumber - 2 AS b, l_orderkey AS id FROM lineitem), r AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o) SELECT 'range' AS rule, count(*) AS n FROM r WHERE a < 0 OR b <= a UNION ALL SELECT 'overlap', count(*) FROM r WHERE a < p UNION ALL SELECT 'duplicate', count(*) FROM (SELECT id FROM o GROUP BY id HAVING count(*) > 1)")
def _(read, spark):
    q = F.col("l_quantity").cast("int")
    return N.violations(read("lineitem").select(F.col("l_suppkey").alias("doc_id"), q.alias("start"), (q + F.col("l_linenumber") - 2).alias("end"), F.col("l_orderkey").alias("occurrence_id")))


@query("F11_mapping_errors", "SELECT o_custkey AS key, 'missing' AS error FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'unknown' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(read, spark):
    return N.mapping_errors(read("orders").select(F.col("o_custkey").alias("key")), read("customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("key")), "key")


_ACTIONS = "SELECT c_custkey AS decision, unnest(['keep', 'l1', 'l2', 'l3', 'ph']) AS action, unnest([NULL, 1, 2, 3, NULL]) AS idx FROM customer"
_SELECTED = "SELECT c_custkey AS decision, ['keep', 'l1', 'l2', 'l3', 'ph'][c_custkey % 5 + 1] AS sel FROM customer"


@query("P20_alternatives", f"""SELECT a.decision, a.action FROM ({_ACTIONS}) a JOIN ({_SELECTED}) s ON a.decision = s.decision WHERE action <> sel AND (idx IS NULL
 OR (sel = 'keep' AND idx = 1) OR (sel = 'ph' AND idx = 3) OR (sel LIKE 'l_' AND abs(idx - CAST(sel[2] AS INTEGER)) = 1))""")
def _(read, spark):
    names = F.array(*map(F.lit, ("keep", "l1", "l2", "l3", "ph")))
    c = read("customer").select(F.col("c_custkey").alias("decision"))
    a = c.select("decision", F.posexplode(names).alias("i", "action")).select("decision", "action", F.when(F.col("action").startswith("l"), "level").when(F.col("action") == "ph", "placeholder").otherwise("keep").alias("mode"), F.col("i").alias("index"))
    return N.structural_alternatives(a, c.select("decision", F.element_at(names, (F.col("decision") % 5 + 1).cast("int")).alias("action")))


@query("P7_anchor_walks")
def _(read, spark):
    d = read("customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").cast("int").alias("position"), F.array(F.concat(F.lit("a "), "c_mktsegment", F.lit(" customer"), (F.col("c_custkey") % 9).cast("string")), F.concat(F.lit("a "), "c_mktsegment", F.lit(" customer")), F.lit("a customer")).alias("fills"))
    return N.anchor_walks(d)


@query("K7_rendered_environment", f"SELECT doc_id, regexp_replace(text, '{patterns.PATTERNS['email'][1]}', 'an address', 'g') AS rendered FROM documents")
def _(read, spark):
    docs = read("documents")
    o, d = N.freeze(patterns.detect(docs, {"email": patterns.PATTERNS["email"]}))
    return N.render(docs, o, d.select("decision_id", F.lit("level").alias("mode"), F.lit("an address").alias("fill"))).select("doc_id", "rendered")


@query("P21_schedule", """
WITH p AS (SELECT o_orderkey AS pair, o_orderkey % 3 AS linked, round(o_totalprice) AS entropy, sha256('0|' || o_orderkey) AS h FROM orders), e AS (SELECT pair FROM p ORDER BY h, pair LIMIT 20)
SELECT pair, 'explore' AS why FROM e UNION ALL SELECT pair, why FROM (SELECT pair, 'priority' AS why FROM p WHERE pair NOT IN (SELECT pair FROM e) ORDER BY linked, entropy DESC, h LIMIT 80)""")
def _(read, spark):
    """A measurement budget of 100 pairs: the cap is the feature."""
    return N.schedule(read("orders").select(F.col("o_orderkey").alias("pair"), (F.col("o_orderkey") % 3).alias("linked"), F.round("o_totalprice").alias("entropy")), 100).select("pair", "why")


@query("P37_weighted_median", "WITH s AS (SELECT l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY 1), r AS (SELECT v, sum(w) OVER (ORDER BY v) AS c, sum(w) OVER () AS t FROM s) SELECT min(v) AS median FROM r WHERE c >= 0.5 * t - 1e-12")
def _(read, spark):
    return N.weighted_median(read("lineitem"), "l_quantity", "l_linenumber")


@query("P23_age_summary", "SELECT event_type, count(user_id) AS n, min(user_id) AS low, max(user_id) AS high, avg(user_id) AS mean FROM events GROUP BY event_type")
def _(read, spark):
    return N.age_summary(read("events"), ["event_type"], "user_id")


@query("P40_population", "SELECT l_returnflag AS grp, count(*) AS n, count(*) FILTER (WHERE l_tax > l_discount) AS gains, count(*) FILTER (WHERE l_tax < l_discount) AS losses, avg(l_tax - l_discount) AS mean, quantile_cont(l_tax - l_discount, 0.5) AS median FROM lineitem GROUP BY 1")
def _(read, spark):
    return N.population(read("lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_discount").alias("before"), F.col("l_tax").alias("after")), "grp")


_LISTS = {k: getattr(relations, k) for k in ("CONDITION_WORDS", "ORIENTATIONS", "RELIGIONS", "ETHNICITIES", "NATIONALITIES", "GENDERS", "MARITAL", "FAMILY", "PROFESSIONS")}
_WORDS = [w for words in _LISTS.values() for w in words] + ["dentist", "34", "musician", "blue", "two diabetics"]


def _sql(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


@query("B32_demographic_leaf", f"""WITH s AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN w WHEN 1 THEN upper(w) || 's' WHEN 2 THEN 'a ' || w || ' national' WHEN 3 THEN ' my  ' || w || ' ' WHEN 4 THEN w || ' aged ' || p_size ELSE p_name END AS surface
  FROM (SELECT *, {_sql(_WORDS)}[p_partkey % {len(_WORDS)} + 1] AS w FROM part)),
t AS (SELECT p_partkey, trim(lower(surface)) AS s, regexp_replace(trim(regexp_replace(lower(surface), '[ \\t\\n\\r]+', ' ', 'g')), 's+$', '') AS n FROM s)
SELECT p_partkey, CASE WHEN len(list_filter({_sql(relations.CONDITION_WORDS)}, lambda k: contains(s, k))) > 0 THEN 'health-condition' WHEN list_contains({_sql(relations.ORIENTATIONS)}, s) OR contains(s, 'homosexual') THEN 'sexual-orientation'
  WHEN list_contains({_sql(relations.RELIGIONS)}, s) THEN 'religion' WHEN list_contains({_sql(relations.ETHNICITIES)}, s) THEN 'ethnicity' WHEN list_contains({_sql(relations.NATIONALITIES)}, s) OR s LIKE '% national' OR s LIKE '% nationals' THEN 'nationality'
  WHEN list_contains({_sql(relations.GENDERS)}, s) THEN 'gender' WHEN list_contains({_sql(relations.MARITAL)}, s) OR list_contains({_sql(relations.MARITAL)}, n) THEN 'marital-status'
  WHEN list_contains({_sql(relations.FAMILY)}, s) OR list_contains({_sql(relations.FAMILY)}, n) OR list_has_any(string_split_regex(s, '\\s+'), {_sql(relations.FAMILY)}) THEN 'family-role'
  WHEN regexp_matches(s, '\\b(aged|years? old)\\b|\\b[0-9]{{1,3}}[- ]year|^[0-9]{{1,3}}$') THEN 'age' WHEN list_contains({_sql(relations.PROFESSIONS)}, s) OR list_contains({_sql(relations.PROFESSIONS)}, n) OR s LIKE '%ist' OR s LIKE '%ian' THEN 'profession' ELSE 'demographic-other' END AS leaf FROM t""")
def _(read, spark):
    """Every word of the lists, plain, in plural, as a national, behind a possessive, with an age; and names."""
    w, size = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % len(_WORDS) + 1).cast("int")), F.col("p_size") % 6
    s = (
        F.when(size == 0, w).when(size == 1, F.concat(F.upper(w), F.lit("s"))).when(size == 2, F.concat(F.lit("a "), w, F.lit(" national")))
        .when(size == 3, F.concat(F.lit(" my  "), w, F.lit(" "))).when(size == 4, F.concat(w, F.lit(" aged "), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    )
    return read("part").select("p_partkey", relations.demographic_leaf(s).alias("leaf"))


@query("F17_type_sane", "SELECT p_partkey, [true, false, true, false, true, false][p_partkey % 6 + 1] AS sane FROM part")
def _(read, spark):
    cases = [("DATETIME", "May", "in spring"), ("DATETIME", "May", "in a town"), ("QUANTITY", "x", "about 5 kg"), ("CODE", "x", "the code"), ("ORG", "a bank", "anywhere"), ("ORG", "<ORG_1>", "anywhere")]
    pick = lambda j: F.element_at(F.array(*[F.lit(c[j]) for c in cases]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read("part").select("p_partkey", relations.type_sane(pick(0), pick(1), pick(2)).alias("sane"))


@query("D3_joined_contractions", "SELECT p_partkey, 'I wanna  ' || p_name || ' gonna  go' AS view, true AS same_length FROM part")
def _(read, spark):
    t = F.concat(F.lit("I wan na "), "p_name", F.lit(" gon na go"))
    v = relations.joined_contractions(t)
    return read("part").select("p_partkey", v.alias("view"), (F.length(v) == F.length(t)).alias("same_length"))


@query("D9_hedges", r"""WITH t AS (SELECT p_partkey, p_size, ['maybe we ', 'if symptoms go on ', 'if and when ', 'we TALK  about ', 'we start '][p_partkey % 5 + 1] AS lead, p_name FROM part),
u AS (SELECT *, 'it might rain. ' || p_name || ' ' || lead || p_name || ', perhaps' AS text, CASE WHEN p_size % 3 = 0 THEN 'tests_for' ELSE 'prescribed_with' END AS relation FROM t)
SELECT p_partkey, relation <> 'tests_for' AND p_size % 4 <> 1 AND regexp_matches(substr(text, CASE WHEN p_size % 4 = 2 THEN 1 ELSE 16 END, CASE WHEN p_size % 4 = 2 THEN 15 ELSE 0 END + 2 * len(p_name) + len(lead) + 1), '(?i)\b(possibly|possible|maybe|perhaps|might|consider|talk\s+about|discuss|if\s+(your|you|we|he|she|it|they|the|his|her|symptoms|there|needed))\b') AS hedged,
       regexp_matches('would it be ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE lead END, '(?i)\b(may|might|could|would|possibl\w*|potential\w*|planned|plan\s+to|consider\w*|recommend\w*|in\s+the\s+future|future|if\s+\w+)\b') AS conditional, regexp_matches(lower(lead || CASE WHEN p_size % 2 = 0 THEN 'not ' ELSE 'nothing ' END), '\b(no|not|without|denies|denied)\b') AS negated FROM u""")
def _(read, spark):
    """Hedges count between the arguments only, and not for tests; a question may be conditional itself."""
    lead = F.element_at(F.array(*map(F.lit, ["maybe we ", "if symptoms go on ", "if and when ", "we TALK  about ", "we start "])), (F.col("p_partkey") % 5 + 1).cast("int"))
    t = read("part").select("p_partkey", "p_size", "p_name", lead.alias("lead"))
    text = F.concat(F.lit("it might rain. "), "p_name", F.lit(" "), "lead", "p_name", F.lit(", perhaps"))
    n, k = F.length("p_name"), F.length("lead")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    first = F.when(F.col("p_size") % 4 == 2, span(F.lit(0), n)).otherwise(span(F.lit(15), n + 15))
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.when(F.col("p_size") % 4 == 1, none).otherwise(F.array(span(16 + n + k, 16 + 2 * n + k), first))
    relation = F.when(F.col("p_size") % 3 == 0, "tests_for").otherwise("prescribed_with")
    question = F.concat(F.lit("would it be "), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("lead")))
    said = F.concat("lead", F.when(F.col("p_size") % 2 == 0, "not ").otherwise("nothing "))
    return t.select("p_partkey", compiler.hedged_window(text, spans, relation).alias("hedged"), compiler.conditional_question(question).alias("conditional"), compiler.negated(said).alias("negated"))


@query("F13_answer_leaks", "SELECT p_partkey, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda t: len(t) > 2)), list_distinct(list_filter(regexp_extract_all(lower('which red thing is a ' || p_type), '[a-z]+'), lambda t: len(t) > 2)))) AS leaks FROM part")
def _(read, spark):
    return read("part").select("p_partkey", F.size(relations.leak_tokens(F.concat(F.lit("which red thing is a "), "p_type"), F.col("p_name"), [])).cast("long").alias("leaks"))


@query("D12_typed_pairs", "SELECT a.l_orderkey, CASE WHEN a.l_returnflag = 'A' THEN 'treats' ELSE 'causes' END AS relation, a.l_linenumber AS subject_id, b.l_linenumber AS object_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND ((a.l_returnflag = 'A' AND b.l_returnflag = 'N') OR (a.l_returnflag = 'R' AND b.l_returnflag = 'A'))")
def _(read, spark):
    sig = spark.createDataFrame([("treats", "A", "N"), ("causes", "R", "A")], "relation string, subject string, object string")
    return relations.typed_pairs(read("lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("type")), sig, ["l_orderkey"])


@query("F16_conflicts", "SELECT doc, a, b FROM (SELECT DISTINCT l_orderkey AS doc, l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag <> 'R') r WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'R' AND k.l_orderkey = r.doc AND (k.l_partkey IN (r.a, r.b) OR k.l_suppkey IN (r.a, r.b)))")
def _(read, spark):
    rows = read("lineitem").select(F.col("l_orderkey").alias("doc"), F.array("l_partkey", "l_suppkey").alias("atoms"), "l_returnflag")
    out = relations.without_conflicts(rows.where("l_returnflag <> 'R'").select("doc", "atoms").distinct(), rows.where("l_returnflag = 'R'"), "doc")
    return out.select("doc", F.col("atoms")[0].alias("a"), F.col("atoms")[1].alias("b"))


@query("F10_clause_failures", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'count' END, CASE WHEN p_size % 4 = 0 THEN 'provenance' END, CASE WHEN p_size % 3 = 0 THEN 'status' END], lambda x: x IS NOT NULL), ',') AS failed FROM part")
def _(read, spark):
    p = read("part").select("p_partkey", F.when(F.col("p_size") >= 10, F.col("p_size")).alias("count"), F.when(F.col("p_size") % 3 == 0, "guess").otherwise("certified").alias("status"), F.when(F.col("p_size") % 4 != 0, "book").alias("source"), F.col("p_name").alias("level"))
    return relations.clause_failures(p).select("p_partkey", F.array_join("failed", ",").alias("failed"))


@query("F20_acceptance_gates", "SELECT unnest(['large', 'cheap']) AS gate, unnest([a, b]) AS observed, unnest([a >= 0.5, b >= 0.5]) AS passed FROM (SELECT avg(CASE WHEN p_size > 20 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN p_retailprice < 1000 THEN 1.0 ELSE 0 END) AS b FROM part)")
def _(read, spark):
    return relations.acceptance(read("part"), {"large": (F.col("p_size") > 20, 0.5), "cheap": (F.col("p_retailprice") < 1000, 0.5)})


@query("E11_sibling", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN (SELECT arg_min(s.l_linenumber, (s.l_suppkey, s.l_linenumber)) FROM lineitem s WHERE s.l_orderkey = l.l_orderkey AND s.l_returnflag = 'A') END AS moved FROM lineitem l")
def _(read, spark):
    rows = read("lineitem")
    a = rows.select(F.col("l_orderkey").alias("decision"), F.col("l_linenumber").alias("argument"), (F.col("l_linenumber") % 2 == 0).alias("grounded"))
    o = rows.select(F.col("l_orderkey").alias("decision"), F.col("l_linenumber").alias("occurrence"), F.col("l_suppkey").alias("start"), (F.col("l_returnflag") == "A").alias("grounds"))
    return relations.sibling(a, o).select(F.col("decision").alias("l_orderkey"), F.col("argument").alias("l_linenumber"), "moved")


_LEVELS = "SELECT p_brand AS type, p_partkey AS canonical, unnest([p_type, p_name, 'part']) AS level, unnest([0, 1, 2]) AS pos, unnest([p_size + 1, p_size * 20 + 2, 5000]) AS count FROM part"


def _levels(read):
    levels = F.arrays_zip(F.array("p_type", "p_name", F.lit("part")).alias("level"), F.array(F.col("p_size") + 1, F.col("p_size") * 20 + 2, F.lit(5000)).alias("count"))
    return read("part").select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("canonical"), F.posexplode(levels).alias("pos", "x")).select("type", "canonical", "pos", "x.level", "x.count")


@query("H6_type_roots", f"SELECT type, level, members FROM (SELECT type, level, count(DISTINCT canonical) AS members, row_number() OVER (PARTITION BY type ORDER BY count(DISTINCT canonical) DESC, avg(pos) DESC, avg(ln(count)) DESC, level) AS r FROM ({_LEVELS}) GROUP BY type, level) WHERE r = 1")
def _(read, spark):
    return relations.type_roots(_levels(read))


@query("H6_discriminative", f"SELECT type, count(*) AS n FROM (SELECT *, max(count) OVER (PARTITION BY type) AS m FROM ({_LEVELS})) WHERE count < 0.1 * m GROUP BY type")
def _(read, spark):
    return relations.discriminative_levels(_levels(read)).groupBy("type").agg(F.count("*").alias("n"))


@query("H16_identical_levels", "SELECT m AS a, p_partkey AS b FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS m FROM part) WHERE m <> p_partkey")
def _(read, spark):
    return relations.identical_pairs(read("part"), ["p_brand", "p_name"], "p_partkey")


@query("H19_curated_merges", "SELECT DISTINCT p_brand AS type, CASE WHEN p_name = 'red bolt' THEN 'blue bolt' ELSE p_name END AS canonical, p_type AS alias FROM part UNION SELECT p_brand, 'blue bolt', 'red bolt' FROM part WHERE p_name = 'red bolt'")
def _(read, spark):
    rows = read("part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("canonical"), F.col("p_type").alias("alias"))
    merges = rows.select("type").distinct().select("type", F.lit("blue bolt").alias("keep"), F.lit("red bolt").alias("fold"))
    return relations.fold(rows, merges)


@query("H15_ontology_ids", "SELECT p_name AS canonical, CASE WHEN p_name LIKE 'red%' THEN 'id:' || p_name WHEN count(DISTINCT p_brand) = 1 THEN 'id:' || min(p_brand) END AS id FROM (SELECT p_name || ' ' || p_size || p_type AS p_name, p_brand FROM part) GROUP BY p_name")
def _(read, spark):
    """The canonical's own id, else the one its aliases agree on."""
    named = read("part").select(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), "p_type").alias("canonical"), "p_brand")
    rows = named.groupBy("canonical").agg(F.collect_set("p_brand").alias("aliases"))
    names = named.where("canonical LIKE 'red%'").select(F.col("canonical").alias("surface")).unionByName(named.select(F.col("p_brand").alias("surface"))).distinct()
    return relations.ontology_id(rows, names.withColumn("id", F.concat(F.lit("id:"), "surface")))


@query("R20_top_per_type", "SELECT p_brand AS type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def _(read, spark):
    """Three entries a type: a top-k report."""
    return relations.top_per_type(read("part").withColumnRenamed("p_brand", "type"), 3, "p_retailprice", "p_partkey").select("type", "p_partkey")


@query("R10_repair_queues", "SELECT CASE event_type WHEN 'error' THEN 'producer' WHEN 'click' THEN 'manual' ELSE 'triage' END AS queue, user_id AS item, array_to_string(list_sort(list(DISTINCT CAST(event_id % 9 AS VARCHAR)))[1:5], ',') AS findings FROM events GROUP BY 1, 2")
def _(read, spark):
    e = read("events").select(F.col("event_type").alias("code"), F.col("user_id").alias("item"), (F.col("event_id") % 9).cast("string").alias("finding"))
    return relations.routed_findings(e, {"error": "producer", "click": "manual"}).withColumn("findings", F.array_join("findings", ","))


@query("R17_root_anchor", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '|' || p_type || '|Part' ELSE p_name || '|' || p_type || '|Part' END AS levels FROM part")
def _(read, spark):
    levels = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_name"), F.lit("part"), F.col("p_type"))).otherwise(F.array("p_name", "p_type"))
    return read("part").select("p_partkey", F.array_join(relations.root_last(levels, F.lit("Part")), "|").alias("levels"))


@query("R11_upsert_levels", "SELECT p_partkey, p_name || '|' || p_type || '|new' AS levels FROM part")
def _(read, spark):
    return read("part").select("p_partkey", F.array_join(relations.upsert_levels(F.array("p_name", "p_type"), F.array(F.lower("p_type"), F.lit("new"), F.lit("NEW"))), "|").alias("levels"))


@query("S11_mixture", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('0|' || doc_id), doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 10 ELSE 0 END")
def _(read, spark):
    """A ratio-capped sample: the cap is the feature."""
    return relations.mixture(read("documents").select("lang", "doc_id"), "lang", {"en": 30, "fr": 10}, "doc_id")


@query("S12_offset_checked", "SELECT doc_id, text[5:9] AS surface FROM documents WHERE len(text) >= 9 AND CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN text[5:9] = text[6:10] ELSE text[5:9] = lower(text[5:9]) END")
def _(read, spark):
    """Source rows whose offsets give their surface: right ones, ones off by one and ones in another case."""
    d = read("documents").where("length(text) >= 9")
    kind = F.col("doc_id") % 3
    surface = F.when(kind == 0, F.substring("text", 5, 5)).when(kind == 1, F.substring("text", 6, 5)).otherwise(F.lower(F.substring("text", 5, 5)))
    rows = d.select("doc_id", "text", F.lit(4).alias("start"), F.lit(9).alias("end"), surface.alias("surface"))
    return reports.offset_checked(rows, "text", "start", "end", "surface").select("doc_id", "surface")


@query("I7_deduplicated_pairs", "SELECT l_orderkey, l_linenumber, len(p_name) + len(p_type) AS score FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(read, spark):
    """Distinct texts are scored once and joined back; here the score is their length."""
    j = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name", "p_type")
    length = lambda once: once.withColumn("score", (F.length("p_name") + F.length("p_type")).cast("long"))
    return reports.scored_once(j, ["p_name", "p_type"], length).select("l_orderkey", "l_linenumber", "score")


@query("Q13_rules", "SELECT event_id, CASE WHEN k >= 80 THEN 'top' WHEN k >= 50 THEN 'high' ELSE 'low' END AS rule FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)")
def _(read, spark):
    return read("events").select("event_id", reports.resolved_rule(F.col("props"), "$.k", [("top", 80.0), ("high", 50.0)], "low").alias("rule"))


@query("Q5_distinct_menus", "SELECT p_brand, min(p_name) AS p_name, menu FROM (SELECT p_brand, p_name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS menu FROM part GROUP BY 1, 2) GROUP BY p_brand, menu")
def _(read, spark):
    m = reports.distinct_menus(read("part"), "p_brand", "p_name", "p_type")
    return m.select("p_brand", "p_name", F.array_join("actions", ",").alias("menu"))


@query("N6_scores", "SELECT d.source, count(*) AS n, avg(CASE WHEN len(b.text) > 300 THEN 1.0 ELSE 0 END) AS recall, avg(len(b.text) / (len(b.text) + n_chars)) AS share FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 GROUP BY d.source")
def _(read, spark):
    b = read("benchmark").select("item_id", F.length("text").alias("size"))
    j = read("documents").select("source", "n_chars", (F.col("doc_id") % 40).alias("item_id")).join(b, "item_id")
    return reports.summary(j, ["source"], recall=F.col("size") > 300, share=F.col("size") / (F.col("size") + F.col("n_chars")))


@query("B33_type_phrase", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'a small part' WHEN 'LARGE' THEN 'a large part' ELSE 'a part of ' || p_brand END AS phrase FROM part")
def _(read, spark):
    return read("part").select("p_partkey", producer.looked_up(F.col("p_type"), {"SMALL": "a small part", "LARGE": "a large part"}, F.concat(F.lit("a part of "), "p_brand")).alias("phrase"))


@query("B30_prompts", "SELECT p_partkey, replace(CASE WHEN p_type = 'SMALL' THEN 'Summarize: {doc}' ELSE 'Answer: {doc}' END, '{doc}', p_name) AS prompt FROM part")
def _(read, spark):
    """The template of the corpus, else the default one."""
    return read("part").select("p_partkey", producer.filled(producer.looked_up(F.col("p_type"), {"SMALL": "Summarize: {doc}"}, "Answer: {doc}"), doc=F.col("p_name")).alias("prompt"))


@query("C15_meaningful_tokens", "SELECT item_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: len(t) > 1 AND NOT list_contains(['the', 'of', 'and'], t)))) AS n FROM benchmark")
def _(read, spark):
    return read("benchmark").select("item_id", F.size(T.tokens(F.col("text"), 2, ["the", "of", "and"])).cast("long").alias("n"))


@query("M8_substitution_rate", "SELECT l_suppkey, avg(CASE WHEN l_returnflag = w THEN 1.0 ELSE 0 END) AS self_rate, count(DISTINCT l_returnflag) AS outputs FROM (SELECT *, CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'A' END AS w FROM lineitem) GROUP BY l_suppkey")
def _(read, spark):
    rows = read("lineitem").withColumn("w", F.when(F.col("l_linestatus") == "O", "N").otherwise("A"))
    return reports.self_substitution(rows, ["l_suppkey"], "w", "l_returnflag")


@query("M19_rank_agreement", "SELECT a.l_orderkey, avg(CASE WHEN b.l_quantity >= a.l_quantity THEN 1.0 ELSE 0 END) AS agreement FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_extendedprice < b.l_extendedprice GROUP BY 1")
def _(read, spark):
    return reports.rank_agreement(read("lineitem"), "l_orderkey", "l_extendedprice", "l_quantity")


@query("K10_privacy_reward", "SELECT user_id, coalesce(avg(value) FILTER (WHERE event_type = 'click'), 0) AS mean, coalesce(max(value) FILTER (WHERE event_type = 'click'), 0) AS high, count(*) FILTER (WHERE event_type = 'click') AS n FROM events GROUP BY user_id")
def _(read, spark):
    return reports.proximity_reward(read("events"), ["user_id"], "value", F.col("event_type") == "click")


@query("K8_representative", "SELECT c_nationkey AS doc, c_mktsegment AS decision, max_by(c_name, (c_custkey % 10, c_custkey)) AS fill FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2")
def _(read, spark):
    """The coarsest entailing level of each decision; here levels entail where the balance is positive."""
    c = read("customer").withColumnsRenamed({"c_nationkey": "doc", "c_mktsegment": "decision"}).withColumn("rank", F.col("c_custkey") % 10)
    return compiler.latest_level(c, ["doc", "decision"], "c_name", ["rank", "c_custkey"], F.col("c_acctbal") > 0)


@query("G5_curated_chain", "SELECT p_partkey, CASE WHEN p_name LIKE '%bolt' THEN 'fastener|hardware' ELSE '' END AS levels FROM part")
def _(read, spark):
    curated = F.create_map(F.lit("bolt"), F.array(F.lit("fastener"), F.lit("hardware")))
    word = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s"))
    return read("part").select("p_partkey", F.array_join(F.coalesce(curated[word], curated[T.singular_token(word)]), "|").alias("levels")).fillna({"levels": ""})


@query("G14_code_sections", "SELECT o_orderkey, CASE CAST(o_orderkey AS VARCHAR)[1] WHEN '1' THEN 'first|procedure' WHEN '2' THEN 'second|procedure' ELSE 'procedure' END AS levels FROM orders")
def _(read, spark):
    return read("orders").select("o_orderkey", F.array_join(producer.code_levels(F.col("o_orderkey").cast("string"), (1,), {"1": "first", "2": "second"}, "procedure"), "|").alias("levels"))


@query("G10_ordered_levels", "SELECT p_partkey, array_to_string(CASE WHEN p_size > 25 THEN [p_type, p_brand, 'part'] ELSE ['part', p_type, p_brand] END, '|') AS levels FROM part")
def _(read, spark):
    a = lambda i, level: F.struct(F.lit(i).cast("int").alias("index") if isinstance(i, int) else i.cast("int").alias("index"), level.alias("level"))
    actions = F.array(a(F.when(F.col("p_size") > 25, 9).otherwise(0), F.lit("part")), a(3, F.col("p_brand")), a(1, F.col("p_type")), a(2, F.lit("<PART>")))
    return read("part").select("p_partkey", F.array_join(lattice.ordered_levels(actions), "|").alias("levels"))