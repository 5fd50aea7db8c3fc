"""Queries that need a trained model in production, run with deterministic stand-ins; and the last compositions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redactum.operators import compiler, curation, lattice, models, profiles, qa, reports, segment
from redactum.plans.base import query
from redactum.plans.lattice_queries import ANCESTORS, _edges
from redactum.plans.span_queries import _spans, with_spans
from redactum.sources import readers


def _asked(name: str, doc: str, table: str, key: str, prompt, sql: str) -> None:
    """A model call: distinct prompts once, answers joined back."""

    def run(read, spark):
        rows = read(table).select(key, prompt().alias("prompt"))
        out, _ = models.answers(rows, ["prompt"], models.word_count, "long")
        return out.select(key, "answer")

    run.__doc__ = doc
    query(name, f"SELECT {key}, len(string_split({sql}, ' ')) AS answer FROM {table}")(run)


_asked("M_cached_answers", "Distinct prompts are answered once.", "part", "p_partkey", lambda: F.concat(F.lit("is it red ? "), F.col("p_name")), "'is it red ? ' || p_name")


@query("I6_rerank", "SELECT p_type, p_name, CAST(len(p_type) + len(p_name) AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY p_type ORDER BY len(p_name) DESC, p_name) AS INTEGER) AS rank FROM (SELECT DISTINCT p_type, p_name FROM part) QUALIFY rank <= 3")
def _(read, spark):
    """The most relevant passages of each question."""
    return models.top_passages(read("part"), "p_type", "p_name", models.length_score, 3)


@query("I9_semantic_scores", "SELECT p_brand, avg(least(1.0, (len(p_name) + len(p_type)) / 15.0)) AS similarity FROM part GROUP BY p_brand")
def _(read, spark):
    """Similarity of fills to their originals."""
    return models.mean_similarity(read("part"), ["p_brand"], "p_name", "p_type", models.length_score, scale=15.0)


@query("M6_reconstruct", "SELECT p_brand, count(*) AS n, avg(CASE WHEN split_part(p_name, ' ', 2) = 'box' OR p_size % 4 = 0 THEN 1.0 ELSE 0 END) AS recovered FROM part GROUP BY p_brand")
def _(read, spark):
    """Masked recovery of a redacted word: the stand-in says the prompt's last word."""
    original = F.split_part("p_name", F.lit(" "), F.lit(2))
    rows = read("part").select("p_brand", original.alias("original"), F.concat(F.lit("a <PART_1> like a "), F.when(F.col("p_size") % 4 == 0, F.upper(original)).otherwise("box")).alias("prompt"))
    return models.recovery(rows, ["p_brand"], "original", "prompt", models.last_word)


@query("M11_reranked_utility", "SELECT c_mktsegment, avg(len(c_name) - c_custkey % 3) AS utility, avg(len(c_name) - c_custkey % 3) / avg(len(c_name)) AS control FROM customer GROUP BY 1")
def _(read, spark):
    """Relevance of private answers against plain ones."""
    rows = read("customer").select("c_mktsegment", "c_name", F.expr("substring(c_name, 1, int(length(c_name) - c_custkey % 3))").alias("private"))
    return models.utility_ratio(rows, ["c_mktsegment"], "c_name", "private", models.length_score)


@query("O10_context_reader", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 OR split_part(p_name, ' ', 2) = 'box' THEN 1.0 ELSE 0.0 END AS score FROM part")
def _(read, spark):
    """A reader's answer to a question in its context."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    context = F.concat(F.lit("it is made by "), "p_brand", F.lit(" as a "), F.when(F.col("p_size") % 2 == 0, noun).otherwise("box"))
    rows = read("part").select("p_partkey", F.lit("what is it ?").alias("question"), context.alias("context"), F.array(noun).alias("accepted"))
    return models.read_answers(rows, "question", "context", "accepted", models.last_word).select("p_partkey", "score")


@query("O29_relation_judge", "SELECT p_partkey, CASE WHEN len(p_name) + len(p_type) >= 14 THEN 'accepted' WHEN len(p_name) + len(p_type) >= 12 THEN 'review' ELSE 'rejected' END AS verdict FROM part")
def _(read, spark):
    """Judgement of a proposed relation by its score."""
    return models.verdicts(read("part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], models.length_score, 14, 12).select("p_partkey", "verdict")


@query("O30_relation_teacher", "SELECT item_id, min(i) AS position, lower(trim(w)) AS level FROM (SELECT item_id, unnest(l) AS w, unnest(range(0, len(l))) AS i FROM (SELECT item_id, string_split(text, ' ') AS l FROM benchmark)) WHERE trim(w) <> '' AND lower(trim(w)) NOT IN ('the', 'and') GROUP BY 1, 3")
def _(read, spark):
    """Proposals for a document, parsed from the teacher's reply, without what is known."""
    rows = read("benchmark").select("item_id", "text")
    return models.proposed_levels(rows, "item_id", "text", models.words_as_levels, F.lower("level").isin("the", "and")).withColumn("position", F.col("position").cast("long"))


@query("S3_pair_relations", "WITH l AS (SELECT p_partkey, p_name AS a, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN p_name || ' ' || p_brand ELSE p_type END AS b FROM part), e AS (SELECT p_partkey, len(list_filter(list_distinct(string_split(lower(b), ' ')), lambda w: NOT list_contains(string_split(lower(a), ' '), w))) = 0 AS f, len(list_filter(list_distinct(string_split(lower(a), ' ')), lambda w: NOT list_contains(string_split(lower(b), ' '), w))) = 0 AS g FROM l) SELECT p_partkey, CASE WHEN f AND g THEN 'equal' WHEN f THEN 'narrower' WHEN g THEN 'broader' ELSE 'none' END AS relation FROM e")
def _(read, spark):
    """Entailment of a pair of levels in both directions."""
    size = F.col("p_size") % 4
    b = F.when(size == 0, F.col("p_name")).when(size == 1, F.split_part("p_name", F.lit(" "), F.lit(2))).when(size == 2, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_type"))
    rows = read("part").select("p_partkey", F.col("p_name").alias("a"), b.alias("b"))
    return models.pair_relations(rows, "a", "b", models.shared_words, 0.999).select("p_partkey", "relation")


@query("G8_teacher_levels", "SELECT p_partkey, min(i) AS position, lower(w) AS level FROM (SELECT p_partkey, unnest(l) AS w, unnest(range(0, len(l))) AS i FROM (SELECT p_partkey, string_split(p_type || ' <PART_1> ' || p_name || ' ' || p_type, ' ') AS l FROM part)) WHERE w <> '<PART_1>' GROUP BY 1, 3")
def _(read, spark):
    """Levels proposed for a surface; placeholders and repeated ones go."""
    rows = read("part").select("p_partkey", F.concat_ws(" ", "p_type", F.lit("<PART_1>"), "p_name", "p_type").alias("prompt"))
    return models.proposed_levels(rows, "p_partkey", "prompt", models.words_as_levels).withColumn("position", F.col("position").cast("long"))


@query("P22_counterfactuals", "WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_shipdate || l_quantity AS x, len(p_name) AS y, l_returnflag = 'A' AS base, p_name FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT l_orderkey, arg_min(y, p_name) AS b FROM v WHERE base GROUP BY 1) SELECT v.l_orderkey, l_linenumber, p_name, CAST(y - b AS DOUBLE) AS effect FROM v LEFT JOIN b ON v.l_orderkey = b.l_orderkey")
def _(read, spark):
    """Each distinct action vector is measured once; its effect is against the document's base vector."""
    rows = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name", "l_returnflag")
    return models.counterfactual_effects(rows, "l_orderkey", "p_name", F.col("l_returnflag") == "A", models.length_score).select("l_orderkey", "l_linenumber", "p_name", "effect")


@query("H7_vector_index", "SELECT vec_id, len(embedding) AS size, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm, 1.0 AS unit FROM embeddings")
def _(read, spark):
    """Unit vectors with their norms and fingerprints."""
    v = profiles.vector_index(read("embeddings"), "vec_id", "embedding")
    return v.select("vec_id", F.size("v").cast("long").alias("size"), "norm", profiles.dot(F.col("v"), F.col("v")).alias("unit"))


@query("G4_hypernym_chain", ANCESTORS + " SELECT node, count(DISTINCT ancestor) AS broader FROM a WHERE hops <= 3 AND ancestor <> 'world' GROUP BY node")
def _(read, spark):
    """At most three steps up, generic roots left out."""
    return lattice.ancestors(_edges(read), 3).where("ancestor <> 'world'").groupBy("node").agg(F.countDistinct("ancestor").alias("broader"))


@query("D5_role_phrases", "WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN p_name ELSE ' their ' || p_type END AS phrase FROM part) SELECT p_partkey, regexp_matches(lower(trim(phrase)), '^(the|a|an|this|that|my|his|her|their)\\b') OR lower(trim(phrase)) IN (SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE p_size < 3) AS role FROM t")
def _(read, spark):
    """An article or possessive in front, or one word from a table of nouns."""
    size, noun = F.col("p_size") % 4, F.split_part("p_name", F.lit(" "), F.lit(2))
    phrase = F.when(size == 0, F.concat(F.lit("The "), "p_name")).when(size == 1, noun).when(size == 2, F.col("p_name")).otherwise(F.concat(F.lit(" their "), "p_type"))
    nouns = read("part").where("p_size < 3").select(noun.alias("noun"))
    return compiler.role_phrases(read("part").select("p_partkey", phrase.alias("phrase")), "phrase", nouns).select("p_partkey", "role")


@query("D7_detected_batches", with_spans("SELECT recognizer, count(DISTINCT doc_id) AS documents, count(*) AS n FROM s GROUP BY recognizer"))
def _(read, spark):
    return _spans(read).groupBy("recognizer").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("n"))


@query("D11_cue_support", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND regexp_matches(lower(q), '\\b(prescribed|started on|hot)\\b') THEN 'cue' WHEN p_size % 2 = 1 AND regexp_matches(lower(q), '\\b(causes|due to|red)\\b') THEN 'cue' ELSE 'judge' END AS support FROM (SELECT *, ['Prescribed ', 'it is due to ', 'likes '][p_partkey % 3 + 1] || p_name AS q FROM part)")
def _(read, spark):
    """A lexical cue of the relation decides; only the rest would go to the judge."""
    said = F.element_at(F.array(F.lit("Prescribed "), F.lit("it is due to "), F.lit("likes ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    relation = F.when(F.col("p_size") % 2 == 0, "treats").otherwise("causes")
    cues = {"treats": ["prescribed", "started on", "hot"], "causes": ["causes", "due to", "red"]}
    return read("part").select("p_partkey", compiler.cue_support(F.concat(said, "p_name"), relation, cues).alias("support"))


@query("A14_ontology_stanzas", "SELECT 'N:' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN lower(r_name) || '|world' ELSE lower(r_name) || '|world' END AS levels FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'R:' || r_regionkey, r_name, 'world' FROM region")
def _(read, spark):
    """Stanzas of an ontology file, here written from the nation and region tables; levels are the families above."""
    stanza = lambda kind, key, name, up: F.format_string('Term]\nid: ' + kind + ':%d\nname: %s\nsynonym: "x" EXACT []\nis_a: ' + up + ' ! above\n', key, name)
    n = read("nation").select(F.replace(stanza("N", "n_nationkey", "n_name", "R:#"), F.lit("#"), F.col("n_regionkey").cast("string")).alias("value"))
    regions = read("region")
    r = regions.select(stanza("R", "r_regionkey", "r_name", "W:0").alias("value"))
    roots = {"W:0": "world"} | {f"R:{x.r_regionkey}": x.r_name.lower() for x in regions.collect()}  # the region table has a fixed size
    return readers.term_levels(readers.stanza_fields(n.unionByName(r)), roots).withColumn("levels", F.array_join("levels", "|"))


@query("A18_nested_json", "SELECT n_nationkey AS code, n_name AS name FROM nation")
def _(read, spark):
    """A territory file: an object keyed by code (here one for each region)."""
    whole = read("nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))).alias("value"))
    return readers.territories(whole).select(F.col("code").cast("int").alias("code"), "name")


@query("B25_relation_clauses", "SELECT p_partkey, 'the ' || p_name || ' that the ' || p_type || ' is for' AS clause FROM part")
def _(read, spark):
    return read("part").select("p_partkey", compiler.clause_text("the %s that the %s is for", F.concat("p_name", F.lit(" ")), F.col("p_type")).alias("clause"))


@query("C6_turn_clauses", r"SELECT conv_id, turn, count(*) AS clauses FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$')) AS x FROM conversations) GROUP BY conv_id, turn")
def _(read, spark):
    """Clauses never cross a turn."""
    t = read("conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    return segment.clauses(t, key="k").groupBy("k").agg(F.count("*").alias("clauses")).select("k.conv_id", "k.turn", "clauses")


@query("D14_candidates", "SELECT l_orderkey, l_linenumber, p_name, n FROM (SELECT l_orderkey, l_linenumber, p_name, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE n >= 3")
def _(read, spark):
    """Decisions joined to parsed rows, kept where a document has three or more."""
    facts = read("part").withColumnRenamed("p_partkey", "l_partkey")
    return compiler.delivered_candidates(read("lineitem"), facts, "l_partkey", by="l_orderkey", least=3).select("l_orderkey", "l_linenumber", "p_name", "n")


@query("M14_output_containment")
def _(read, spark):
    """Share of a brand's names that the output still holds; a fuzzy ratio has no SQL, tests hold it to brute force."""
    output = F.concat(F.lit("it says "), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))))
    return curation.containment_recall(read("part").select("p_brand", F.col("p_name").alias("surface"), output.alias("text")), ["p_brand"])


@query("I8_candidate_windows")
def _(read, spark):
    """The best window of a text's words for a phrase: windows two words shorter to four longer, best twelve by ratio."""
    w = F.split(F.concat(F.lit("we saw one "), "p_brand", F.lit(" and a "), "p_name", F.lit(" there")), " ")
    # the few files of a small table are many ratios, so rows are dealt out first
    rows = read("part").select("p_partkey", "p_name", w.alias("w")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    scored = rows.select("p_partkey", curation.best_windows(F.col("p_name"), F.col("w")).alias("best")).select("p_partkey", F.inline("best"))
    r = F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.desc("score"), "k", "at"))
    return scored.withColumn("r", r).where("r <= 12").select("p_partkey", "window", "score", "r")


@query("O21_compiled_assertions", "SELECT l_orderkey, count(*) AS kept, sum(w) AS weight FROM (SELECT l_orderkey, 1.0 / count(*) OVER (PARTITION BY l_orderkey) AS w FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R')) GROUP BY 1")
def _(read, spark):
    """Candidates without the rejected, once per fact, weighted within their document."""
    c = curation.rejections(read("lineitem"), [("returned", F.col("l_returnflag") == "R")]).where("reason IS NULL")
    once = qa.first_by_fact(c.withColumn("fact", curation.fact_key(F.lit("has"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.lit(True))), ["fact"], [F.col("l_linenumber")])
    weight = 1.0 / F.count("*").over(Window.partitionBy("l_orderkey"))
    return once.select("l_orderkey", weight.alias("w")).groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.sum("w").alias("weight"))


@query("Q17_preflight_report", "SELECT 'collisions' AS check, CAST(sum(n) AS DOUBLE) AS observed FROM (SELECT count(*) - count(DISTINCT lower(c_mktsegment)) AS n FROM customer GROUP BY c_nationkey) UNION ALL SELECT 'flat', avg(CASE WHEN c = b THEN 1.0 ELSE 0 END) FROM (SELECT p_size AS c, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS b FROM part) WHERE b IS NOT NULL")
def _(read, spark):
    losses = curation.injective_losses(read("customer").select("c_nationkey", F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("fill")), "c_nationkey")
    b = F.lag("p_size").over(Window.partitionBy("p_brand").orderBy("p_size"))
    flat = read("part").select("p_size", b.alias("b")).where("b IS NOT NULL").agg(F.avg((F.col("p_size") == F.col("b")).cast("double")).alias("observed"))
    return losses.agg(F.sum("collisions").cast("double").alias("observed")).select(F.lit("collisions").alias("check"), "observed").unionByName(flat.select(F.lit("flat").alias("check"), "observed"))


@query("Q16_paired_improvements", "SELECT l_suppkey, avg(t - d) AS difference FROM (SELECT l_suppkey, l_linenumber, l_returnflag, avg(l_tax) AS t, avg(l_discount) AS d FROM lineitem GROUP BY ALL) GROUP BY 1")
def _(read, spark):
    """Paired by profile, seed and fold."""
    by = ["l_suppkey", "l_linenumber", "l_returnflag"]
    arm = lambda c: read("lineitem").groupBy(*by).agg(F.avg(c).alias("v"))
    return reports.paired_difference(arm("l_discount"), arm("l_tax"), by, "v", ["l_suppkey"])