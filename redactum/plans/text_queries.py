"""Queries over string functions and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators import producer
from redactum.plans.base import query

DOCS = "SELECT doc_id, {} AS {} FROM documents"
STOP = ["the", "and", "for", "that", "with", "this"]
GENERIC = ["brand", "type", "person", "product"]

WS = r"'[ \t\n\r\f\x0B]+'"


def _document_text(name: str, column: str, f, sql: str) -> None:
    query(name, f"SELECT doc_id, {sql} AS {column} FROM documents")(lambda read, spark: read("documents").select("doc_id", f(F.col("text")).alias(column)))


_AGE = "replace(lower(text), '-year-old', ' years old')"
_document_text("B1_canonical", "canon", T.canonical, f"trim(regexp_replace({_AGE}, '[^a-z0-9_<>]+', ' ', 'g'))")
_document_text("B3_canonical_plain", "canon", T.canonical_plain, f"trim(regexp_replace({_AGE}, '[^a-z0-9]+', ' ', 'g'))")
_document_text("B5_normalized", "norm", T.normalized, f"trim(regexp_replace(lower(text), {WS}, ' ', 'g'))")
_document_text("B6_strip_plural", "norm", T.strip_plural, f"regexp_replace(trim(regexp_replace(lower(text), {WS}, ' ', 'g')), 's+$', '')")
_document_text("B9_mined_normal", "norm", T.mined_normal, f"trim(regexp_replace(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9+-]+', ' ', 'g'), {WS}, ' ', 'g'))")
_document_text("B10_coherence_normal", "norm", T.coherence_normal, f"trim(regexp_replace(translate(lower(text), '_-', '  '), {WS}, ' ', 'g'))")
_document_text("B11_noise_normal", "norm", lambda c: T.compact(T.noise_normal(c)), "replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ', '')")
_document_text("C12_content_words", "words", lambda c: F.array_join(F.array_sort(T.tokens(c, 3, STOP)), " "), "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: len(t) > 2 AND NOT list_contains(['the','and','for','that','with','this'], t)))), ' ')")
_document_text("D15_capitalized_names", "names", lambda c: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+)+)")))), "|"), "array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))), '|')")


@query("B18_reply_lines", r"""
WITH l AS (SELECT doc_id, i, trim(regexp_replace(x, '^[ ]*(?:[-*]|[0-9]+[.)])[ ]*', '')) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE regexp_matches(x, '^[A-Za-z]') AND len(regexp_split_to_array(x, ' +')) <= 8)
SELECT d.doc_id, coalesce(p.reply, '') AS lines FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY r) AS reply FROM k WHERE r <= 3 GROUP BY doc_id) p ON d.doc_id = p.doc_id""")
def _reply(read, spark):
    return read("documents").select("doc_id", F.array_join(T.reply_lines(F.col("text")), "\n").alias("lines"))


@query("B4_clinical_canonical", "SELECT p_partkey, regexp_replace(regexp_replace('dr ' || lower(p_name) || ' milligrams', '\\bdr\\.?( )', 'doctor\\1', 'g'), '\\bmilligrams?\\b', 'mg', 'g') AS canon FROM part")
def _clinical(read, spark):
    return read("part").select("p_partkey", T.clinical_canonical(F.concat(F.lit("dr "), "p_name", F.lit(" milligrams"))).alias("canon"))


@query("B7_singular_words", """
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(s)) AS BIGINT) AS letters FROM (
 SELECT doc_id, CASE WHEN len(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN len(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END AS s
 FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents)) GROUP BY doc_id""")
def _singular(read, spark):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))
    folded = F.filter(F.split(T.singular_words(F.array_join(words, " ")), " "), lambda t: t != "")
    return read("documents").where(F.size(words) > 0).select("doc_id", F.size(folded).cast("long").alias("n"), F.length(F.array_join(folded, "")).cast("long").alias("letters"))


@query("B12_placeholder", "SELECT p_partkey, '<' || coalesce(nullif(trim(regexp_replace(upper(p_type), '[^A-Z0-9]+', '_', 'g'), '_'), ''), 'OTHER') || '_' || p_size || '>' AS token FROM part")
def _placeholder(read, spark):
    return read("part").select("p_partkey", T.placeholder(F.col("p_type"), F.col("p_size")).alias("token"))


@query("B13_strip_dose", "SELECT p_partkey, lower(p_name) AS drug FROM part")
def _dose(read, spark):
    """Each part name with a spoken dose appended loses it again."""
    doses = F.array(F.lit(" 81 mg daily"), F.lit(" zero point four milligrams"), F.lit(" two units"))
    return read("part").select("p_partkey", T.strip_dose(F.concat(F.lower("p_name"), F.element_at(doses, (F.col("p_partkey") % 3 + 1).cast("int")))).alias("drug"))


@query("B14_without_tokens", "SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_type), ' '), lambda t: NOT list_contains(['steel', 'tin', 'brass'], t)), ' ') AS base FROM part")
def _tokens_out(read, spark):
    return read("part").select("p_partkey", T.without_tokens(F.lower("p_type"), ["steel", "tin", "brass"]).alias("base"))


@query("B15_first_suffix", "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '% steel' THEN lower(p_type)[:-7] WHEN lower(p_type) LIKE '% tin' THEN lower(p_type)[:-5] ELSE lower(p_type) END AS base FROM part")
def _suffix(read, spark):
    return read("part").select("p_partkey", T.strip_first_suffix(F.lower("p_type"), ["steel", "tin"]).alias("base"))


@query("B16_class_label", "SELECT p_partkey, lower(p_type) AS label FROM part")
def _class(read, spark):
    return read("part").select("p_partkey", T.class_label(F.concat("p_type", F.lit(" [EPC]"))).alias("label"))


@query("B17_words_to_number", """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) * 1000 + 7 AS n FROM lineitem""")
def _number(read, spark):
    """Quantities spelt in English and read back."""
    q = F.col("l_quantity").cast("int")
    ones = F.array(*map(F.lit, T.ONES))
    tens = F.create_map(*[F.lit(x) for w, v in T.TENS.items() for x in (v, w)])
    spelt = F.when(q < 20, F.element_at(ones, q + 1)).otherwise(F.concat(tens[(F.floor(q / 10) * 10).cast("int")], F.when(q % 10 == 0, "").otherwise(F.concat(F.lit("-"), F.element_at(ones, q % 10 + 1)))))
    return read("lineitem").select("l_orderkey", "l_linenumber", T.words_to_number(F.concat(spelt, F.lit(" thousand and seven"))).alias("n"))


@query("B19_cache_key", "SELECT c_custkey, c_mktsegment || '::' || lower(trim(c_name)) AS key FROM customer")
def _cache(read, spark):
    return read("customer").select("c_custkey", T.cache_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query("B20_fix_articles", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[aeiouAEIOU]') THEN 'an ' ELSE 'a ' END || p_name AS phrase FROM part WHERE regexp_matches(p_name, '^[A-Za-z]')")
def _articles(read, spark):
    wrong = F.when(F.col("p_name").rlike("^[aeiouAEIOU]"), "a ").otherwise("an ")
    return read("part").where(F.col("p_name").rlike("^[A-Za-z]")).select("p_partkey", T.fix_articles(F.concat(wrong, "p_name")).alias("phrase"))


@query("B21_case_adjust", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN upper(p_name[1]) || p_name[2:] ELSE lower(p_name[1]) || p_name[2:] END AS fill FROM part")
def _case(read, spark):
    before = F.when(F.col("p_size") % 3 == 0, "He left. ").otherwise("in ")
    return read("part").select("p_partkey", T.case_adjust(F.col("p_name"), before).alias("fill"))


@query("B22_fill_key", "SELECT p_partkey, lower(p_name || ' ' || p_type) AS key FROM part")
def _fill_key(read, spark):
    return read("part").select("p_partkey", T.fill_key(F.concat_ws(" ", "p_name", "p_type")).alias("key"))


@query("B31_type_rollup", """
SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'PROMO') THEN 'DEM' WHEN split_part(p_type, ' ', 1) = 'SMALL' THEN 'MISC' ELSE split_part(p_type, ' ', 1) END AS coarse FROM part""")
def _rollup(read, spark):
    t = F.split_part("p_type", F.lit(" "), F.lit(1))
    return read("part").select("p_partkey", producer.looked_up(t, {"ECONOMY": "DEM", "PROMO": "DEM", "SMALL": "MISC"}, t).alias("coarse"))


_JACC = "CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END"
_PAIRS = "SELECT x.p_partkey AS a_key, y.p_partkey AS b_key, list_distinct(regexp_extract_all(lower(x.p_name || ' ' || x.p_type), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(y.p_name || ' ' || y.p_type), '[a-z]+')) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1"


def _part_pairs(read):
    words = T.tokens(F.concat_ws(" ", "p_name", "p_type"))
    p = read("part").select("p_partkey", words.alias("w"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b_key"), F.col("w").alias("v"))
    return p.join(q, "p_partkey").withColumnRenamed("p_partkey", "a_key")


@query("B35_label_overlap", f"SELECT a_key, b_key, CASE WHEN len(list_filter(list_intersect(a, b), lambda t: NOT list_contains(['brand','type','person','product'], t))) = 0 THEN 0.0 ELSE {_JACC} END AS overlap FROM ({_PAIRS})")
def _overlap(read, spark):
    return _part_pairs(read).select("a_key", "b_key", T.label_overlap(F.col("w"), F.col("v"), GENERIC).alias("overlap"))


@query("B34_whole_words", f"SELECT a_key, b_key, len(a) > 0 AND len(b) > 0 AND (len(list_intersect(a, b)) = len(a) OR len(list_intersect(a, b)) = len(b)) AS contains FROM ({_PAIRS})")
def _contains(read, spark):
    return _part_pairs(read).select("a_key", "b_key", T.whole_words_contain(F.col("w"), F.col("v")).alias("contains"))


@query("B37_merge_anchors", """
SELECT p_partkey, CASE WHEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.5 THEN lower(p_type) ELSE lower(p_type) || '|' || pl END AS levels
FROM (SELECT p_partkey, p_type, lower(split_part(p_type, ' ', 1)) || ' ' || lower(split_part(p_type, ' ', 3)) || CASE WHEN p_size % 2 = 0 THEN ' other words here' ELSE '' END AS pl,
 list_distinct(string_split(lower(p_type), ' ')) AS a, list_distinct(string_split(lower(split_part(p_type, ' ', 1)) || ' ' || lower(split_part(p_type, ' ', 3)) || CASE WHEN p_size % 2 = 0 THEN ' other words here' ELSE '' END, ' ')) AS b FROM part)""")
def _anchors(read, spark):
    part = lambda i: F.lower(F.split_part("p_type", F.lit(" "), F.lit(i)))
    proposed = F.concat(part(1), F.lit(" "), part(3), F.when(F.col("p_size") % 2 == 0, " other words here").otherwise(""))
    return read("part").select("p_partkey", F.array_join(T.drop_near(F.array(F.lower("p_type")), F.array(proposed)), "|").alias("levels"))


@query("C13_bigram_candidates", """
WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z]+') AS w FROM part)
SELECT p_partkey, len(list_distinct(list_filter(w, lambda t: len(t) > 2))) + len(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS candidates FROM w""")
def _bigrams(read, spark):
    return read("part").select("p_partkey", F.size(T.bigram_candidates(F.col("p_name"))).cast("long").alias("candidates"))


@query("C17_distance_bucket", "SELECT event_id, CASE WHEN d = 0 THEN 0 ELSE CAST(sign(d) AS INTEGER) * least(8, CAST(floor(log2(abs(d))) AS INTEGER) + 1) END AS bucket FROM (SELECT event_id, CAST(user_id AS BIGINT) - 75 AS d FROM events)")
def _distance(read, spark):
    return read("events").select("event_id", T.distance_bucket(F.col("user_id") - 75).cast("int").alias("bucket"))
