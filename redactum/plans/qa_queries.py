"""Queries over segmentation, answers, metrics, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators import components, producer, qa, reports, segment
from redactum.plans.base import query
from redactum.sources import readers
from redactum.streaming import incremental

LINES = "SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query("C10_lines", f"SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(coalesce(sum(len(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, content FROM ({LINES})")
def _(read, spark):
    return segment.lines(read("documents"))


@query("C8_sections", f"SELECT doc_id, CAST(line AS INTEGER) AS line, last_value(CASE WHEN regexp_matches(content, '^Th[a-z]+') THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM ({LINES})")
def _(read, spark):
    return segment.sections(segment.lines(read("documents")), heading="^Th[a-z]+").select("doc_id", "line", "section")


@query("C4_clauses", r"SELECT doc_id, CAST(sum(len(x)) AS BIGINT) AS n, count(*) AS clauses FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$')) AS x FROM documents) GROUP BY doc_id")
def _(read, spark):
    return segment.clauses(read("documents")).groupBy("doc_id").agg(F.sum(F.length("content")).alias("n"), F.count("*").alias("clauses"))


@query("C1_chunks")
def _(read, spark):
    return segment.chunks(read("documents"))


@query("C11_word_windows", r"SELECT doc_id, CAST(w AS INTEGER) AS window, CAST(least(150, n - w * 150) AS INTEGER) AS words FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // 150 + 1)) AS w FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM documents) WHERE n > 0)")
def _(read, spark):
    return segment.word_windows(read("documents"))


@query("C2_sentence_around", r"SELECT p_partkey, p_name || ' of ' || p_brand AS sentence FROM part")
def _(read, spark):
    text = F.concat(F.lit("Before. "), "p_name", F.lit(" of "), "p_brand", F.lit(".\nAfter."))
    return read("part").select("p_partkey", T.source_sentence(text, F.lit(9), F.lit(11)).alias("sentence"))


_KEEP = "SELECT DISTINCT conv_id, turn FROM (SELECT c.conv_id, c.turn FROM conversations c JOIN conversations k ON k.conv_id = c.conv_id AND k.role = 'user' AND k.turn % 4 = 0 AND abs(c.turn - k.turn) <= 1 UNION ALL SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user' AND turn % 4 = 0))"


@query("C5_turn_excerpts", f"""
WITH k AS (SELECT x.conv_id, x.turn, c.text, x.turn - row_number() OVER (PARTITION BY x.conv_id ORDER BY x.turn) AS g FROM ({_KEEP}) x JOIN conversations c ON c.conv_id = x.conv_id AND c.turn = x.turn),
b AS (SELECT conv_id, min(turn) AS a, string_agg(text, chr(10) ORDER BY turn) AS t FROM k GROUP BY conv_id, g)
SELECT conv_id, string_agg(t, chr(10) || '[...]' || chr(10) ORDER BY a) AS excerpt FROM b GROUP BY conv_id""")
def _(read, spark):
    c = read("conversations")
    return qa.turn_excerpts(c, c.where("role = 'user' AND turn % 4 = 0").select("conv_id", "turn"))


@query("O1_fact_score", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.0 WHEN p_size % 3 = 1 THEN 0.0 ELSE 2.0 * 2 / 5 END AS score FROM part""")
def _(read, spark):
    """A full answer, one without the number, one with two words of two and three."""
    name = F.concat("p_name", F.lit(" 7"))
    answer = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("the "), name)).when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise(F.col("p_name"))
    gold = F.when(F.col("p_size") % 3 == 2, F.concat("p_name", F.lit(" x"))).otherwise(name)
    return read("part").select("p_partkey", qa.fact_score(answer, gold).alias("score"))


@query("O4_set_recall", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END AS recall FROM part")
def _(read, spark):
    lines_ = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("zeta one"), F.col("p_name"))).otherwise(F.array(F.col("p_name"), F.lit("other")))
    return read("part").select("p_partkey", qa.set_recall(lines_, F.array(F.col("p_name"), F.lit("zeta"))).alias("recall"))


@query("O3_alias_sequence", "SELECT p_partkey, true AS found, false AS scattered FROM part")
def _(read, spark):
    alias = F.split("p_name", " ")
    said = F.concat(F.array(F.lit("maybe")), alias, F.array(F.lit("today")))
    return read("part").select("p_partkey", qa.contains_sequence(said, alias).alias("found"), qa.contains_sequence(F.array(alias[0], F.lit("x"), alias[1]), alias).alias("scattered"))


@query("O5_json_reply", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n FROM events")
def _(read, spark):
    reply = F.when(F.col("event_id") % 5 == 0, "no [broken").otherwise(F.concat(F.lit('Sure: ["'), "event_type", F.lit('", "b"] done')))
    return read("events").select("event_id", F.size(qa.json_array(reply)).alias("n"))


@query("O6_permuted_options", "SELECT event_id, (list_sort([sha256(event_type || '|a') || 'a', sha256(event_type || '|b') || 'b', sha256(event_type || '|c') || 'c'])[event_id % 3 + 1])[-1:] AS first FROM events")
def _(read, spark):
    o = qa.permuted_options(F.col("event_type"), F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("event_id"))
    return read("events").select("event_id", o[0].alias("first"))


_A = "SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'delivered' ELSE 'relation' END AS family, event_type || (user_id % 9) AS grp, CASE WHEN user_id % 9 = 4 THEN 'structure' ELSE 'fact' END AS subtype FROM events"


@query("O12_static_weights", f"""
WITH a AS ({_A}), g AS (SELECT family, grp, count(*) AS n, CASE WHEN family = 'delivered' THEN max(CASE WHEN subtype = 'structure' THEN 1 ELSE 0 END) ELSE 0 END AS s FROM a GROUP BY family, grp),
f AS (SELECT *, CASE WHEN family = 'delivered' THEN 0.6 ELSE 0.4 END AS b, count(*) OVER (PARTITION BY family) AS t, sum(s) OVER (PARTITION BY family) AS st FROM g)
SELECT id, CASE WHEN st = 0 THEN b / t WHEN s = 1 THEN least(b * 0.1, b * st / t) / st ELSE (b - least(b * 0.1, b * st / t)) / (t - st) END / n AS weight FROM a JOIN f ON a.family = f.family AND a.grp = f.grp""")
def _(read, spark):
    a = read("events").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "delivered").otherwise("relation").alias("family"), F.concat("event_type", (F.col("user_id") % 9).cast("string")).alias("group"), F.when(F.col("user_id") % 9 == 4, "structure").otherwise("fact").alias("subtype"))
    budgets = spark.createDataFrame([("delivered", 0.6), ("relation", 0.4)], "family string, budget double")
    return qa.static_weights(a, budgets, 0.1).select("id", "weight")


@query("O14_three_point_gate", """
SELECT l_suppkey AS assertion, avg(CASE WHEN l_quantity >= 25 AND l_quantity >= 20 AND l_discount * 100 < 6 THEN 1.0 ELSE 0 END) AS passed,
 CASE WHEN avg(CASE WHEN l_quantity >= 25 AND l_discount * 100 < 6 THEN 1.0 ELSE 0 END) >= 0.3 THEN 'accepted' WHEN avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0 END) < 0.3 THEN 'unsupported' ELSE 'unstable' END AS status FROM lineitem GROUP BY l_suppkey""")
def _(read, spark):
    t = read("lineitem").select(F.col("l_suppkey").alias("assertion"), (F.col("l_quantity") / 50).alias("original"), (F.col("l_quantity") / 40).alias("representative"), (F.col("l_discount") * 100 / 12).alias("placeholder"))
    return qa.three_point_gate(t, 0.5, 0.3)


@query("O13_routing", "SELECT l_orderkey AS assertion, CASE WHEN count(CASE WHEN l_partkey % 3 = 0 THEN 1 END) > 0 THEN 'linked' ELSE 'residual' END AS routing, count(DISTINCT CASE WHEN l_partkey % 3 = 0 THEN p_brand END) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def _(read, spark):
    d = read("lineitem").select(F.col("l_orderkey").alias("assertion"), F.col("l_partkey").alias("occurrence"))
    linked = read("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("occurrence"), F.col("p_brand").alias("decision"))
    return qa.routed(d, linked).select("assertion", "routing", F.size("decisions").cast("long").alias("n"))


@query("O16_first_by_fact", "SELECT p_brand, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size % 2, p_partkey) AS r FROM part) WHERE r = 1")
def _(read, spark):
    return qa.first_by_fact(read("part"), ["p_brand", "p_name"], [F.col("p_size") % 2, F.col("p_partkey")]).select("p_brand", "p_name", "p_partkey")


@query("O23_outcome_route", "SELECT l_orderkey, l_linenumber, CASE WHEN o AND r AND p THEN 'floor_answerable' WHEN o <> r OR (p AND NOT o AND NOT r) THEN 'lattice_suspect' WHEN NOT o AND NOT r AND NOT p AND l_linenumber = 1 THEN 'no_relation' END AS route FROM (SELECT *, l_quantity >= 25 AS o, l_discount * 100 >= 5 AS r, l_tax * 100 >= 4 AS p FROM (SELECT * FROM lineitem))")
def _(read, spark):
    r = qa.outcome_route((F.col("l_quantity") >= 25).cast("double"), (F.col("l_discount") * 100 >= 5).cast("double"), (F.col("l_tax") * 100 >= 4).cast("double"), F.col("l_linenumber") == 1)
    return read("lineitem").select("l_orderkey", "l_linenumber", r.alias("route"))


_REC = "SELECT p_brand, p_name AS surface, '<P_' || (p_size % 7) || '>' AS replacement, 'a <P_3> and <P_5>' AS out_p, 'said small ring, red widget' AS out_final FROM part"


@query("N2_restoration", f"""
SELECT p_brand AS doc_id, count(*) FILTER (WHERE e) AS echoed, count(*) FILTER (WHERE e AND b) AS restored, count(*) FILTER (WHERE NOT e AND b) AS unsupported, count(*) FILTER (WHERE e AND b) / nullif(count(*) FILTER (WHERE e), 0) AS recovery
FROM (SELECT *, contains(out_p, replacement) AS e, contains('said small ring red widget', surface) AS b FROM ({_REC})) GROUP BY p_brand""")
def _(read, spark):
    r = read("part").select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("surface"), F.concat(F.lit("<P_"), (F.col("p_size") % 7).cast("string"), F.lit(">")).alias("replacement"), F.lit("a <P_3> and <P_5>").alias("out_p"), F.lit("said small ring, red widget").alias("out_final"))
    return qa.restoration_report(r)


@query("N1_echo_labels", f"SELECT replacement, CASE WHEN contains(out_p, replacement) THEN 'exact' ELSE 'absent' END AS echo, count(*) AS n FROM ({_REC}) GROUP BY ALL")
def _(read, spark):
    r = read("part").select(F.concat(F.lit("<P_"), (F.col("p_size") % 7).cast("string"), F.lit(">")).alias("replacement"))
    return r.groupBy("replacement", qa.echo(F.col("replacement"), F.lit("a <P_3> and <P_5>")).alias("echo")).agg(F.count("*").alias("n"))


@query("N4_rouge_l", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 2.0 * 2 / 5 END AS rouge FROM part")
def _(read, spark):
    said = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" x "), F.split_part("p_name", F.lit(" "), F.lit(2))))
    refs = F.when(F.col("p_size") % 2 == 0, F.array("p_name", F.lit("none"))).otherwise(F.array(F.col("p_name")))
    return read("part").select("p_partkey", qa.rouge_l_column(said, refs).alias("rouge"))


@query("N7_domain_summary", "SELECT source, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY source")
def _(read, spark):
    return reports.summary(read("documents"), ["source"], mean=F.col("n_chars"))


@query("N5_bootstrap_interval", qa.bootstrap_sql("SELECT o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY 1", "v", "o_custkey", 200))
def _(read, spark):
    return qa.bootstrap_interval(read("orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v")), "v", "o_custkey", samples=200)


@query("A1_interleave", "SELECT doc_id, CAST(row_number() OVER (ORDER BY r, p) - 1 AS INTEGER) AS position FROM (SELECT doc_id, doc_id % 3 AS p, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS r FROM documents)")
def _(read, spark):
    d = read("documents").select("doc_id")
    return readers.interleave([d.where(F.col("doc_id") % 3 == i) for i in range(3)], "doc_id")


@query("A2_references", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '|' || p_brand ELSE p_type END AS refs FROM part")
def _(read, spark):
    several = F.when(F.col("p_size") % 2 == 0, F.array("p_name", "p_brand")).otherwise(F.array().cast("array<string>"))
    return read("part").select("p_partkey", F.array_join(readers.references(several, F.col("p_type")), "|").alias("refs"))


@query("A8_items", "SELECT 'parts/' || CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN 'd' || p_partkey ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS item_id, 'parts' AS corpus, p_type AS doc_orig FROM part")
def _(read, spark):
    rows = read("part").select(F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("id"), F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("d"), "p_partkey")).alias("doc_id"), F.col("p_partkey").alias("position"), F.col("p_type").alias("text"))
    return readers.to_item(rows, "parts")


@query("A10_gazetteer", "SELECT s AS surface, c_nationkey AS country, c_custkey AS region, c_acctbal AS population FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c_acctbal DESC, c_nationkey DESC, c_custkey DESC) AS r FROM (SELECT lower(c_mktsegment) AS s, * FROM customer UNION ALL SELECT lower(c_name), * FROM customer)) WHERE r = 1")
def _(read, spark):
    c = read("customer").select(F.col("c_mktsegment").alias("name"), F.col("c_name").alias("ascii_name"), F.col("c_nationkey").alias("country"), F.col("c_custkey").alias("region"), F.col("c_acctbal").alias("population"))
    return readers.gazetteer(c)


@query("A12_reviewable", "SELECT c_custkey, len(c_name) <= 48 AND regexp_matches(c_name, '^[A-Za-z0-9 .,''()/&-]+$') AS ok FROM customer")
def _(read, spark):
    return read("customer").select("c_custkey", readers.reviewable(F.col("c_name")).alias("ok"))


@query("A20_typed_cache", "SELECT event_type AS type, CAST(user_id AS VARCHAR) AS surface, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL")
def _(read, spark):
    key = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat_ws("::", "event_type", "user_id"))
    return readers.typed_cache(read("events").select(key.alias("key"), "value")).groupBy("type", "surface").agg(F.count("*").alias("n"))


@query("A23_split_mail", "SELECT c_custkey, c_name AS text, c_mktsegment AS subject FROM customer")
def _(read, spark):
    return read("customer").select("c_custkey", readers.split_mail(F.concat("c_name", F.lit(" @subject "), "c_mktsegment")).alias("x")).select("c_custkey", "x.*")


@query("A24_split_reply", "SELECT c_custkey, c_name AS reply FROM customer")
def _(read, spark):
    body = F.concat("c_name", F.lit("\n"), F.when(F.col("c_custkey") % 2 == 0, "> old text").otherwise("-----Original Message-----\nx"))
    return read("customer").select("c_custkey", readers.split_reply(body).reply.alias("reply"))


@query("A30_cache_identity", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS identity FROM customer""")
def _(read, spark):
    return read("customer").select("c_custkey", readers.cache_identity("c_name", "c_custkey").alias("identity"))


@query("S13_config_hash", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}')[:16] AS hash FROM nation""")
def _(read, spark):
    return read("nation").select("n_nationkey", readers.config_hash("n_regionkey", "n_name").alias("hash"))


@query("S7_surfaces_by_type", "SELECT p_brand, string_agg(DISTINCT p_name, ';' ORDER BY p_name) AS surfaces, count(DISTINCT p_name) < 40 AS thin FROM part GROUP BY p_brand")
def _(read, spark):
    return reports.pools(read("part"), "p_brand", "p_name", 40).withColumn("surfaces", F.array_join("surfaces", ";"))


@query("S8_balance_rare", "SELECT event_type, count(*) + count(*) FILTER (WHERE event_type = 'purchase' OR value > 90) AS n FROM events GROUP BY event_type")
def _(read, spark):
    """Rows with a rare label stand twice, no more."""
    return reports.balanced(read("events"), (F.col("event_type") == "purchase") | (F.col("value") > 90)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("S9_shares", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, sum(n_chars) / (SELECT sum(n_chars) FROM documents) AS share FROM documents GROUP BY lang")
def _(read, spark):
    return reports.shares(read("documents"), "lang", "n_chars")


@query("S5_last_mention", "SELECT c_nationkey, c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, lower(c_mktsegment) ORDER BY c_custkey DESC) AS r FROM customer) WHERE r = 1")
def _(read, spark):
    c = read("customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    return reports.last_mention(c, ["c_nationkey"], "c_mktsegment", "c_custkey")


@query("R2_category_coverage", "SELECT b.p_brand, count(p.p_partkey) AS n, count(p.p_partkey) < 60 AS needed FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN part p ON p.p_brand = b.p_brand AND p.p_size > 12 AND b.p_brand NOT LIKE '%1' GROUP BY b.p_brand")
def _(read, spark):
    """Every registered label, those without rows too."""
    rows = read("part").where("p_size > 12 AND p_brand NOT LIKE '%1'")
    return producer.category_coverage(read("part"), rows, "p_brand", 60)


@query("R5_chain_sufficient", "SELECT p_brand, count(*) >= 2 AND max(n) >= 20 AS sufficient FROM (SELECT p_brand, p_type, count(DISTINCT p_name) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def _(read, spark):
    return producer.chain_sufficient(read("part"), "p_brand", "p_type", "p_name", least=2, floor=20)


@query("R8_parse_candidates", """SELECT event_id, position, level, count, source_family FROM (SELECT event_id, 0 AS position, 'k ' || json_extract_string(props, '$.k') AS level, value AS count, CASE WHEN event_type = 'view' THEN 'book' ELSE 'model-proposed' END AS source_family FROM events WHERE event_type <> 'click'
UNION ALL SELECT event_id, 2, event_type, NULL, 'model-proposed' FROM events WHERE event_type = 'click')""")
def _(read, spark):
    """Replies with candidates, with plain levels of which one is blank, and one that is no JSON."""
    level = F.concat(F.lit("k "), F.get_json_object("props", "$.k"))
    source = F.when(F.col("event_type") == "view", "book")
    full = F.to_json(F.struct(F.array(F.struct(F.concat(level, F.lit(" ")).alias("level"), F.col("value").alias("count"), source.alias("source_family"))).alias("candidates")))
    plain = F.to_json(F.struct(F.array(F.lit(" "), F.lit(""), F.col("event_type")).alias("candidate_levels")))
    reply = F.when(F.col("event_type") == "click", plain).otherwise(full)
    rows = read("events").select("event_id", reply.alias("reply"))
    broken = rows.select("event_id", F.lit("no json").alias("reply"))
    return producer.parse_candidates(rows.unionByName(broken), "reply", "event_id").select("event_id", "position", "level", "count", "source_family")


@query("R18_entity_components")
def _(read, spark):
    """Entities of all lines; recursive SQL is too slow on the whole table, a test holds it to brute force."""
    return components.labelled(read("lineitem").select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 1000000).alias("v")))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY ALL")
def _(read, spark):
    return incremental.tumbling(read("events"))


@query("stream_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def _(read, spark):
    return incremental.sliding(read("events"))


@query("stream_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, g")
def _(read, spark):
    return incremental.sessions(read("events"))
