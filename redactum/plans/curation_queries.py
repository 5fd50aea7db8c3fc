"""Queries over curation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators import curation as C
from redactum.operators import compiler, reports, segment, spans
from redactum.plans.base import query
from redactum.plans.span_queries import _spans, with_spans
from redactum.sources import readers


@query("H3_ingredient_index", "SELECT name, min(base) AS base FROM (SELECT lower(unnest([p_name || ' ' || p_brand, p_type || ' by ' || p_brand[7:]])) AS name, p_type AS base FROM part) WHERE NOT regexp_matches(name, '[0-9]') GROUP BY name HAVING count(DISTINCT base) = 1 UNION ALL SELECT name, min(base) FROM (SELECT lower(p_type || ' of ' || p_name) AS name, p_type AS base FROM part) GROUP BY name HAVING count(DISTINCT base) = 1")
def _(read, spark):
    names = F.array(F.concat_ws(" ", "p_name", "p_brand"), F.concat("p_type", F.lit(" by "), F.expr("substring(p_brand, 7)")), F.concat("p_type", F.lit(" of "), "p_name"))
    return C.ingredient_index(read("part").select(names.alias("names"), F.array("p_type").alias("ingredients")))


@query("A16_counted_surfaces", "SELECT lower(c_mktsegment) AS surface, count(*) AS count, max(c_nationkey) AS level FROM customer GROUP BY 1")
def _(read, spark):
    return C.counted_surfaces(read("customer"), "c_mktsegment", "c_nationkey")


@query("A15_single_group_titles", "SELECT title, min(g) AS \"group\" FROM (SELECT lower(p_name || ' ' || p_size) AS title, p_brand[:7] AS g FROM part) GROUP BY 1 HAVING count(DISTINCT g) = 1")
def _(read, spark):
    rows = read("part").select(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("title"), "p_brand")
    return C.single_group_titles(rows, "title", "p_brand", 7)


@query("A22_length_range", "SELECT doc_id FROM documents WHERE len(text) BETWEEN 500 AND 5000")
def _(read, spark):
    return C.within_length(read("documents"), 500, 5000).select("doc_id")


@query("A7_seeded_order", "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id < 3 THEN 0 ELSE 1 END, CASE WHEN doc_id < 3 THEN lpad(CAST(doc_id AS VARCHAR), 9, '0') ELSE sha256('7|' || doc_id) END, doc_id) - 1 AS position FROM documents")
def _(read, spark):
    """The first rows keep their places, the tail follows in hash order."""
    return readers.seeded_order(read("documents").select("doc_id"), F.col("doc_id") < 3, "doc_id", seed="7")


@query("R1_registry", "SELECT event_id, CASE event_type WHEN 'error' THEN 'placeholder' WHEN 'click' THEN 'lattice' ELSE 'unmapped' END AS outcome FROM events")
def _(read, spark):
    r = spark.createDataFrame([("error", "placeholder", "CODE"), ("click", "lattice", "DATETIME")], "family string, outcome string, runtime_type string")
    return C.registry_outcomes(read("events").select("event_id", F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")).alias("label")), r).select("event_id", "outcome")


@query("R1_label_families", "SELECT p_partkey, lower(p_name) || ' x' AS family FROM part")
def _(read, spark):
    return read("part").select("p_partkey", C.label_family(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("__"))), F.lit("-X"))).alias("family"))


@query("R3_eligible", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'empty' WHEN p_type NOT IN ('SMALL', 'LARGE') THEN 'type' WHEN p_size % 2 = 0 THEN 'done' ELSE 'queue' END AS reason FROM part")
def _(read, spark):
    levels = F.when(F.col("p_size") % 2 == 0, F.array("p_name", "p_type")).otherwise(F.array("p_name"))
    items = read("part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")).alias("surface"), F.col("p_type").alias("runtime_type"), levels.alias("levels"))
    return C.eligible(items, ["SMALL", "LARGE"]).select("p_partkey", F.coalesce("reason", F.lit("queue")).alias("reason"))


@query("R4_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey % 9 <> 0")
def _(read, spark):
    o = read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return C.pending(read("customer").select("c_custkey"), [o, read("customer").where("c_custkey % 9 = 0")], "c_custkey")


@query("R4_requeue", "SELECT item, attempt + 1 AS attempt FROM (SELECT l_orderkey AS item, max_by(l_returnflag, l_linenumber) AS status, max(l_linenumber) AS attempt FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1) WHERE status = 'R' AND attempt <= 3")
def _(read, spark):
    r = read("lineitem").groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("attempt")).agg(F.max("l_returnflag").alias("f"))
    return C.requeued(r.select("item", "attempt", F.when(F.col("f") == "R", "rejected").otherwise("accepted").alias("status")), 3)


@query("R15_slotted_order", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_type, p_retailprice, p_partkey) - 1 AS INTEGER) AS position FROM part")
def _(read, spark):
    rows = read("part").select("p_brand", F.col("p_partkey").alias("level"), (F.col("p_size") % 3).alias("slot"), F.col("p_type").alias("rank"), F.col("p_retailprice").alias("baseline"))
    return C.slotted_order(rows, "p_brand").select(F.col("level").alias("p_partkey"), "position")


@query("R16_median_baseline", "SELECT p_brand AS type, p_type AS level, quantile_cont(p_size, 0.5) AS baseline FROM part GROUP BY 1, 2")
def _(read, spark):
    return C.median_baseline(read("part").select(F.col("p_brand").alias("type"), F.col("p_type").alias("level"), F.col("p_size").alias("count")))


@query("I13_strided_band", "SELECT p_brand, p_partkey FROM (SELECT *, floor(r * 4 / c) AS a, CASE WHEN r = 0 THEN -1 ELSE floor((r - 1) * 4 / c) END AS b FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part)) WHERE a <> b")
def _(read, spark):
    """Four examples of each brand at even strides: a prompt's slice."""
    return C.strided_band(read("part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey", 4).select("p_brand", "p_partkey")


@query("B27_literal_starts", "SELECT p_partkey, [0, len(p_name) + 1, 2 * len(p_name) + 4][1] AS first, 3 AS n, 2 * len(p_name) + 6 AS last FROM part")
def _(read, spark):
    t = F.concat("p_name", F.lit(" "), "p_name", F.lit(" and "), "p_name")
    s = C.literal_starts(t, F.col("p_name"))
    return read("part").select("p_partkey", s[0].alias("first"), F.size(s).alias("n"), F.element_at(s, -1).alias("last"))


@query("C3_sentence_with", "SELECT p_partkey, 'It is a ' || p_name || '.' AS sentence, p_size % 2 = 0 AS doubled FROM part")
def _(read, spark):
    t = F.concat(F.lit("First one. It is a "), "p_name", F.lit(". Last!"))
    tail = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" "), F.element_at(F.split("p_name", " "), -1))).otherwise(F.col("p_name"))
    return read("part").select("p_partkey", C.sentence_with(t, F.col("p_name")).alias("sentence"), C.doubled_word(tail).alias("doubled"))


@query("C14_word_snap", "SELECT p_partkey, 2 AS start, 2 + len(split_part(p_name, ' ', 1)) AS \"end\" FROM part")
def _(read, spark):
    t = F.concat(F.lit("a "), "p_name", F.lit("."))
    return read("part").select("p_partkey", C.word_snap(t, F.lit(3), F.lit(4)).alias("x")).select("p_partkey", "x.*")


@query("B28_serialized_fields", "SELECT p_partkey, 'p_type: ' || p_type || chr(10) || 'p_name: ' || p_name AS text, 8 AS s0, 8 + len(p_type) AS e0, len(p_type) + 17 AS s1 FROM part")
def _(read, spark):
    x = C.fielded("p_type", "p_name")
    return read("part").select("p_partkey", x.alias("x")).select("p_partkey", "x.text", F.col("x.fields")[0].start.alias("s0"), F.col("x.fields")[0].end.alias("e0"), F.col("x.fields")[1].start.alias("s1"))


@query("B24_prose_list", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' and ' || p_type ELSE p_name || ', ' || p_type || ' and ' || p_brand END AS phrase FROM part")
def _(read, spark):
    a = F.slice(F.array("p_name", "p_type", "p_brand"), F.lit(1), (F.col("p_size") % 3 + 1).cast("int"))
    return read("part").select("p_partkey", C.prose_list(a).alias("phrase"))


@query("B26_teacher_text", "SELECT p_partkey, 'the owner has a ' || p_name || ' of ' || lower(p_type) AS text FROM part")
def _(read, spark):
    snake = F.concat(F.lit(" the_owner has  a "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_of  "), F.lower("p_type"))
    return read("part").select("p_partkey", compiler.underscored(snake).alias("text"))


_CLAUSES = r"(SELECT doc_id, len(x) AS n, sum(len(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$') AS l FROM documents)))"


@query("C9_clause_of_span", with_spans(f"SELECT s.doc_id, s.start, CAST(c.e - c.n AS INTEGER) AS clause_start FROM s JOIN {_CLAUSES} c ON c.doc_id = s.doc_id AND s.start >= c.e - c.n AND s.start < c.e"))
def _(read, spark):
    c = segment.clauses(read("documents"))
    out = segment.clause_of(_spans(read), c)
    starts = c.select("doc_id", "clause", F.col("start").alias("clause_start"))
    return out.join(starts, ["doc_id", "clause"]).select("doc_id", "start", "clause_start")


@query("C18_span_words", with_spans("SELECT doc_id, start, \"end\", len(regexp_extract_all(surface, '[A-Za-z0-9]+')) AS words FROM s"))
def _(read, spark):
    return _spans(read).select("doc_id", "start", "end", F.size(F.regexp_extract_all("surface", F.lit("([A-Za-z0-9]+)"))).cast("long").alias("words"))


@query("E8_violation_counters", with_spans("SELECT type, count(*) AS n, count(*) FILTER (WHERE len(surface) < 10) AS short, count(*) FILTER (WHERE start = 0) AS at_start, count(*) FILTER (WHERE len(surface) < 10) <= 5 AS ok FROM s GROUP BY type"))
def _(read, spark):
    short = F.count_if(F.length("surface") < 10)
    return _spans(read).groupBy("type").agg(F.count("*").alias("n"), short.alias("short"), F.count_if(F.col("start") == 0).alias("at_start"), (short <= 5).alias("ok"))


@query("I5_containment")
def _(read, spark):
    """Containment of a name in a text that holds it, one word of it, or another name; no SQL has the fuzzy ratio, tests
    hold it to brute force."""
    text = F.concat(F.lit("the "), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.col("p_type")), F.lit(" here"))
    return read("part").select("p_partkey", C.containment_column(F.upper("p_name"), text).alias("score"))


@query("L3_best_with_margin", "SELECT l_orderkey, candidate, score FROM (SELECT l_orderkey, l_linenumber AS candidate, score, row_number() OVER w AS r, lead(score) OVER w AS n FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber)) WHERE r = 1 AND score >= 30 AND score - coalesce(n, 0) >= 4")
def _(read, spark):
    s = read("lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("candidate")).agg(F.max("l_quantity").alias("score"))
    return C.best_with_margin(s, "l_orderkey", 30.0, 4.0)


@query("O7_contracts", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS score FROM part")
def _(read, spark):
    kind = F.element_at(F.array(F.lit("contains"), F.lit("sections"), F.lit("field")), (F.col("p_size") % 3 + 1).cast("int"))
    values = F.when(F.col("p_size") % 3 == 0, F.array("p_name", "p_type")).otherwise(F.array(F.col("p_name"), F.lit("absent thing")))
    return read("part").select("p_partkey", C.contract_score(kind, F.concat_ws(", ", "p_type", "p_name"), values).alias("score"))


@query("O9_reward_role", "SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'policy' ELSE 'monitoring' END AS role FROM part")
def _(read, spark):
    return read("part").select("p_partkey", C.reward_role(F.array("p_type", "p_brand"), ["SMALL", "LARGE"]).alias("role"))


@query("O8_component_scores", "WITH s AS (SELECT user_id, event_type, avg(value) AS score FROM events GROUP BY 1, 2), w AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1) SELECT user_id, s.event_type, score, sum(weight * score) OVER (PARTITION BY user_id) / sum(weight) OVER (PARTITION BY user_id) AS utility FROM s JOIN w ON s.event_type = w.event_type")
def _(read, spark):
    """Component scores and their mean, weighted by how common a component is."""
    weights = read("events").groupBy("event_type").agg(F.count("*").cast("double").alias("weight"))
    return reports.component_utility(read("events"), weights, "user_id", "event_type", "value")


@query("O11_protected_terms", "SELECT p_partkey, p_name || '|' || p_type || CASE WHEN p_size % 2 = 0 THEN '|' || p_brand ELSE '' END AS terms FROM part")
def _(read, spark):
    terms = compiler.protected_terms(F.col("p_name"), F.lit(" "), F.col("p_type"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_type"))
    return read("part").select("p_partkey", F.array_join(terms, "|").alias("terms"))


@query("O15_fact_keys", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'treats|' || l_partkey || '|' || l_suppkey ELSE 'pairs|' || least(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) || '|' || greatest(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) END AS key FROM lineitem")
def _(read, spark):
    directed = F.col("l_returnflag") == "A"
    k = C.fact_key(F.when(directed, "treats").otherwise("pairs"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), directed)
    return read("lineitem").select("l_orderkey", "l_linenumber", k.alias("key"))


@query("O17_competing_surfaces", "SELECT DISTINCT a.l_orderkey, a.l_suppkey AS decision, (SELECT coalesce(string_agg(DISTINCT CAST(b.l_partkey AS VARCHAR), ',' ORDER BY CAST(b.l_partkey AS VARCHAR)), '') FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey) AS others FROM lineitem a")
def _(read, spark):
    s = read("lineitem").select("l_orderkey", F.col("l_suppkey").alias("decision"), F.col("l_partkey").cast("string").alias("surface"))
    return C.competing(s, ["l_orderkey"]).withColumn("others", F.array_join("others", ","))


@query("O18_reverse_groups", "SELECT p_brand AS relation, p_type AS condition, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS literals FROM part GROUP BY 1, 2")
def _(read, spark):
    g = C.grouped_literals(read("part").select(F.col("p_brand").alias("relation"), F.col("p_type").alias("condition"), F.col("p_name").alias("literal")))
    return g.withColumn("literals", F.array_join("literals", "|"))


@query("O26_rejections", "SELECT CASE WHEN p_size < 5 THEN 'small' WHEN p_retailprice > 1500 THEN 'price' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1")
def _(read, spark):
    r = C.rejections(read("part"), [("small", F.col("p_size") < 5), ("price", F.col("p_retailprice") > 1500)])
    return r.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("O28_review_flags", "SELECT doc_id, 'long' AS flag FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 'foreign' FROM documents WHERE lang <> 'en'")
def _(read, spark):
    return C.review_flags(read("documents"), {"long": F.col("n_chars") > 3000, "foreign": F.col("lang") != "en"}, "doc_id")


@query("Q3_pair_accuracy", "SELECT a.l_orderkey, avg(CASE WHEN a.l_extendedprice < b.l_extendedprice THEN 1.0 ELSE 0 END) AS accuracy FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity < b.l_quantity GROUP BY 1")
def _(read, spark):
    return C.pair_accuracy(read("lineitem"), "l_orderkey", "l_quantity", "l_extendedprice")


@query("Q3_log_errors", "SELECT p_brand, count(*) AS n, quantile_cont(abs(ln((p_size + 5.0) / p_size)), 0.5) AS median_error, avg(CASE WHEN abs(ln((p_size + 5.0) / p_size)) <= ln(2.0) + 1e-9 THEN 1.0 ELSE 0 END) AS covered FROM (SELECT p_brand, p_size + 0.25 AS p_size FROM part) GROUP BY p_brand")
def _(read, spark):
    rows = read("part").select("p_brand", (F.col("p_size") + 0.25).alias("t"), (F.col("p_size") + 5.25).alias("g"))
    return C.log_errors(rows, "p_brand", "t", "g")


@query("Q3_macro_means", "SELECT l_returnflag, avg(m) AS mean FROM (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(read, spark):
    return C.macro(read("lineitem"), "l_suppkey", "l_returnflag", "l_quantity")


@query("Q9_arm_deltas", "SELECT user_id, max(value) FILTER (WHERE event_type = 'view') - max(value) FILTER (WHERE event_type = 'click') AS delta FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'view') > 0 AND count(*) FILTER (WHERE event_type = 'click') > 0")
def _(read, spark):
    return C.arm_deltas(read("events"), "user_id", "event_type", "value", "click", "view")


@query("Q11_injective_losses", "SELECT c_nationkey, count(*) - count(DISTINCT lower(c_mktsegment)) AS collisions, count(*) AS decisions FROM customer GROUP BY 1")
def _(read, spark):
    return C.injective_losses(read("customer").select("c_nationkey", F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("fill")), "c_nationkey")


@query("N3_fact_recall", "SELECT p_brand, avg(CASE WHEN p_name IN ('small ring', 'red widget') THEN 1.0 ELSE 0 END) AS recall, count(*) AS restated FROM part WHERE p_size % 2 = 0 GROUP BY p_brand")
def _(read, spark):
    """Facts the reference restates, and those the final text has."""
    reference = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("a "), "p_name")).otherwise(F.lit(""))
    has = lambda text, x: F.instr(T.canonical(text), T.canonical(x)) > 0
    rows = read("part").where(has(reference, F.col("p_name")))
    return rows.groupBy("p_brand").agg(F.avg(has(F.lit("said small ring, red widget"), F.col("p_name")).cast("double")).alias("recall"), F.count("*").alias("restated"))


@query("N8_gate_patterns", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def _(read, spark):
    return reports.patterns(read("lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("P35_epoch_report", "SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS mean, avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0 END) AS taxed FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(read, spark):
    return reports.stratified(read("lineitem"), ["l_returnflag", "l_linestatus"], mean=F.col("l_quantity"), taxed=F.col("l_tax") > 0.04)


@query("M17_ngram_mi", """
WITH g AS (SELECT event_type || ',' || lead(event_type) OVER w AS x, user_id % 2 AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), p AS (SELECT x, y, count(*) AS n FROM g WHERE x IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS t FROM p),
h AS (SELECT -sum(c / t * log2(c / t)) AS h, 1 AS s FROM (SELECT sum(n) AS c FROM p GROUP BY x), t UNION ALL SELECT -sum(c / t * log2(c / t)), 1 FROM (SELECT sum(n) AS c FROM p GROUP BY y), t UNION ALL SELECT -sum(c / t * log2(c / t)), -1 FROM (SELECT n AS c FROM p), t) SELECT sum(h * s) AS mi FROM h""")
def _(read, spark):
    from pyspark.sql import Window

    from redactum.operators import probes

    w = Window.partitionBy("user_id").orderBy("event_id")
    g = read("events").select(F.concat("event_type", F.lit(","), F.lead("event_type").over(w)).alias("x"), (F.col("user_id") % 2).alias("y")).where("x IS NOT NULL")
    return probes.plugin_mutual_information(g, "x", "y", corrected=False)


@query("F3_gate_spans", with_spans("SELECT doc_id, start, CASE WHEN recognizer = 'email' THEN 'keep' WHEN recognizer = 'license' THEN 'retype' WHEN len(surface) > 12 THEN 'drop' ELSE 'open' END AS decision FROM s"))
def _(read, spark):
    r = F.col("recognizer")
    return _spans(read).select("doc_id", "start", F.when(r == "email", "keep").when(r == "license", "retype").when(F.length("surface") > 12, "drop").otherwise("open").alias("decision"))


@query("F22_collapse_rule", "SELECT event_type, avg(value) AS observed, avg(value) < 20 AS fires FROM events GROUP BY event_type")
def _(read, spark):
    return reports.collapse(read("events"), ["event_type"], "value", 20)


@query("G9_first_occurrence", with_spans("SELECT type, lower(surface) AS surface, min(doc_id) AS doc_id FROM s GROUP BY 1, 2"))
def _(read, spark):
    """Lattice facts are frozen once per surface, at its first occurrence."""
    return _spans(read).groupBy("type", F.lower("surface").alias("surface")).agg(F.min("doc_id").alias("doc_id"))


@query("I11_within_doc_pairs", "WITH s AS (SELECT l_orderkey AS doc_id, l_returnflag AS type, l_linenumber AS start, p_name AS surface FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT a.doc_id, a.start, b.start AS other FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.type = b.type AND a.start < b.start AND split_part(a.surface, ' ', 1) = split_part(b.surface, ' ', 1)")
def _(read, spark):
    """Same-type mentions of one document that share their first word: the pairs a similarity model would score."""
    m = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    m = m.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("start"), F.col("p_name").alias("surface"))
    return C.sibling_pairs(m, "doc_id", "type", "start", "surface")


@query("O25_premises", with_spans("SELECT doc_id, type, string_agg(DISTINCT surface, '; ' ORDER BY surface) AS premise FROM s GROUP BY doc_id, type"))
def _(read, spark):
    merged = spans.coalesce_mentions(_spans(read))
    return merged.groupBy("doc_id", "type").agg(F.array_join(F.array_sort(F.collect_set("surface")), "; ").alias("premise"))
