"""Queries over pattern spans, their algebra, rewriting, restoration and attacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactum.functions import text as T
from redactum.operators import patterns, probes, rewrite, spans
from redactum.plans.base import query

CANON = "trim(regexp_replace(replace(lower({}), '-year-old', ' years old'), '[^a-z0-9_<>]+', ' ', 'g'))"


def span_sql(names=tuple(patterns.PATTERNS)) -> str:
    """CTE body: doc_id, start, end, surface, type, score, recognizer of the named patterns."""
    part = """SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS INTEGER) AS start,
 m[i] AS surface, '{kind}' AS type, {score} AS score, '{name}' AS recognizer
 FROM (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m FROM documents))"""
    return " UNION ALL ".join(part.format(kind=patterns.PATTERNS[n][0], pattern=patterns.PATTERNS[n][1], score=patterns.PATTERNS[n][2], name=n) for n in names)


def with_spans(body: str, names=tuple(patterns.PATTERNS)) -> str:
    return f'WITH s0 AS ({span_sql(names)}), s AS (SELECT *, CAST(start + len(surface) AS INTEGER) AS "end" FROM s0) {body}'


_OVER = 'k.start < x[1]."end" AND x[1].start < k."end"'
#: Overlap resolution as two ordered folds over one-element lists.
RESOLVED = f"""p1 AS (SELECT doc_id, list([{{start: start, "end": "end", surface: surface, type: type, score: score}}] ORDER BY start - "end", -score, start, "end", type, surface) AS l FROM s GROUP BY doc_id),
k1 AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.type = x[1].type AND {_OVER})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM p1),
p2 AS (SELECT doc_id, list([k] ORDER BY -greatest(k.score, 0.9), k.start - k."end", k.start, k."end", k.type, k.surface) AS l FROM k1 GROUP BY doc_id),
r AS (SELECT doc_id, k.start AS start, k."end" AS "end", k.surface AS surface, k.type AS type, k.score AS score FROM (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_OVER})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM p2))"""
REDACTED = f"""{RESOLVED},
n AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS pe, row_number() OVER (PARTITION BY doc_id, type ORDER BY start DESC, "end" DESC) AS i FROM r),
red AS (SELECT d.doc_id, d.source, CASE WHEN max(n."end") IS NULL THEN any_value(text) ELSE string_agg(text[pe + 1:n.start] || '<' || n.type || '_' || i || '>', '' ORDER BY n.start) || any_value(text)[max(n."end") + 1:] END AS redacted FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, d.source)"""


def with_resolved(body: str, parts: str = RESOLVED) -> str:
    return with_spans("SELECT 1").removesuffix(" SELECT 1") + f", {parts} {body}"


def _spans(read, *names):
    return patterns.detect(read("documents"), {n: patterns.PATTERNS[n] for n in names} if names else None)


@query("D1_pattern_spans", with_spans('SELECT doc_id, start, "end", surface, type, score, recognizer FROM s'))
def _(read, spark):
    return _spans(read).drop("source")


@query("D4_code_without_digit", with_spans("SELECT recognizer, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(surface, '[0-9]') THEN 0 ELSE 1 END) AS BIGINT) AS rejected FROM s WHERE type = 'CODE' GROUP BY recognizer"))
def _(read, spark):
    return _spans(read).where("type = 'CODE'").groupBy("recognizer").agg(F.count("*").alias("n"), F.sum(patterns.without_digit(F.col("surface")).cast("long")).alias("rejected"))


@query("D_pattern_counts", "SELECT source, " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS {n}" for n, (_, p, _) in patterns.PATTERNS.items()) + " FROM documents GROUP BY source")
def _(read, spark):
    return read("documents").groupBy("source").agg(*[F.sum(F.regexp_count("text", F.lit(p))).alias(n) for n, (_, p, _) in patterns.PATTERNS.items()])


@query("E1_resolve_overlaps", with_resolved("SELECT *, 'pattern' AS source FROM r"))
def _(read, spark):
    return spans.resolve(_spans(read))


@query("E2_coref_chains")
def _(read, spark):
    return spans.chains(spans.resolve(_spans(read)))


@query("E3_negative_filter", with_spans("""SELECT doc_id, start, surface, CASE WHEN len(surface) % 3 = 1 THEN 'REF' ELSE type END AS type FROM s WHERE len(surface) % 3 <> 0"""))
def _(read, spark):
    s = _spans(read)
    n = F.length("surface") % 3
    d = s.select("surface", "type").distinct().withColumns({"action": F.when(n == 0, "drop").when(n == 1, "retype").otherwise("keep"), "new_type": F.when(n == 1, "REF")})
    return spans.gate_types(s, d).select("doc_id", "start", "surface", "type")


@query("E4_prepare_spans", with_spans("SELECT doc_id, start, surface, type FROM s WHERE NOT (type = 'MISC' AND false)"))
def _(read, spark):
    kept, _ = spans.noise_free(_spans(read))
    return kept.select("doc_id", "start", "surface", "type")


_MENTIONS = "SELECT l_orderkey AS doc_id, CAST(l_quantity AS INTEGER) % 4 AS start, CAST(l_quantity AS INTEGER) % 4 + 1 AS \"end\", l_linenumber AS annotator, CASE WHEN l_returnflag = 'R' THEN 'DIRECT' ELSE 'QUASI' END AS identifier FROM lineitem"


def _mentions(read):
    q = F.col("l_quantity").cast("int") % 4
    return read("lineitem").select(F.col("l_orderkey").alias("doc_id"), q.alias("start"), (q + 1).alias("end"), F.col("l_linenumber").alias("annotator"), F.when(F.col("l_returnflag") == "R", "DIRECT").otherwise("QUASI").alias("identifier"))


for _name, _direct in (("E5_gold_last_direct", False), ("E9_gold_first_direct", True)):
    _rank = "annotator" if _direct else "CASE WHEN identifier = 'DIRECT' THEN -annotator ELSE annotator END"

    @query(_name, f"SELECT doc_id, start, \"end\", annotator, identifier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, \"end\" ORDER BY CASE WHEN identifier = 'DIRECT' THEN 0 ELSE 1 END, {_rank}) AS r FROM ({_MENTIONS})) WHERE r = 1")
    def _(read, spark, direct=_direct):
        return spans.gold(_mentions(read), first_direct=direct)


_GOLD = ("license", "name")


@query("E6_overlap_recall", with_spans("""SELECT recognizer, count(*) AS n, avg(CASE WHEN EXISTS (SELECT 1 FROM s f WHERE f.recognizer = 'license' AND f.doc_id = s.doc_id AND f.start < s."end" AND s.start < f."end") THEN 1.0 ELSE 0.0 END) AS recall FROM s GROUP BY recognizer""", _GOLD))
def _(read, spark):
    s = _spans(read, *_GOLD)
    return spans.overlap_hits(s, s.where("recognizer = 'license'")).groupBy("recognizer").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("recall"))


@query("E7_residuals", with_spans("""SELECT doc_id, start, "end", surface FROM s WHERE recognizer = 'name' AND NOT EXISTS (SELECT 1 FROM s f WHERE f.recognizer = 'license' AND f.doc_id = s.doc_id AND f.start = s.start AND f."end" = s."end")""", _GOLD))
def _(read, spark):
    s = _spans(read, *_GOLD)
    return spans.residuals(s.where("recognizer = 'name'"), s.where("recognizer = 'license'")).select("doc_id", "start", "end", "surface")


@query("E10_text_occurrences", with_spans("SELECT DISTINCT s.doc_id, surface, CAST((len(text) - len(replace(text, surface, ''))) / len(surface) AS BIGINT) AS n, CAST(instr(text, surface) - 1 AS INTEGER) AS first FROM s JOIN documents d ON s.doc_id = d.doc_id", ("email", "ipv4")))
def _(read, spark):
    docs = read("documents")
    return patterns.occurrences(docs, _spans(read, "email", "ipv4")).groupBy("doc_id", "surface").agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query("E12_unique_spans", with_spans('SELECT doc_id, surface, min(start) AS start, min("end") AS "end" FROM s GROUP BY doc_id, surface HAVING count(*) = 1'))
def _(read, spark):
    return spans.unique_surfaces(_spans(read))


@query("E13_coalesce_mentions", with_spans("SELECT doc_id, type, surface, string_agg(start || '-' || \"end\", ',' ORDER BY start, \"end\") AS ranges FROM s GROUP BY ALL"))
def _(read, spark):
    rows = spans.coalesce_mentions(_spans(read))
    return rows.select("doc_id", "type", "surface", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r.start, r.end)), ",").alias("ranges"))


@query("E14_offset_integrity", with_spans("SELECT recognizer, count(*) AS n, CAST(0 AS BIGINT) AS broken FROM s GROUP BY recognizer"))
def _(read, spark):
    s = _spans(read)
    bad = spans.broken_offsets(read("documents"), s).groupBy("recognizer").agg(F.count("*").alias("broken"))
    return s.groupBy("recognizer").agg(F.count("*").alias("n")).join(bad, "recognizer", "left").fillna({"broken": 0})


@query("K2_no_privacy_record", with_spans("SELECT doc_id, start, surface AS replacement, 'keep' AS action, 1.0 AS risk FROM s"))
def _(read, spark):
    return rewrite.keep_all(_spans(read)).select("doc_id", "start", "replacement", "action", "risk")


@query("K3_placeholder_record", with_spans("""SELECT doc_id, start, "end", '<' || type || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY start DESC, "end" DESC) || '>' AS replacement FROM s""", ("email", "ipv4", "license")))
def _(read, spark):
    return rewrite.number_placeholders(_spans(read, "email", "ipv4", "license")).select("doc_id", "start", "end", "replacement")


@query("K6_rendered_placeholders", f"SELECT doc_id, regexp_replace(text, '{patterns.PATTERNS['email'][1]}', '<CODE>', 'g') AS redacted FROM documents")
def _(read, spark):
    s = _spans(read, "email").withColumn("replacement", T.placeholder(F.col("type")))
    return rewrite.splice(read("documents"), s).select("doc_id", "redacted")


@query("K4_coarsest_level", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '<PART>' ELSE 'a ' || lower(split_part(p_type, ' ', 1)) || ' part' END AS replacement FROM part")
def _(read, spark):
    level = F.concat(F.lit("a "), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit(" part"))
    lattice = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("<PART>"))).otherwise(F.array(F.col("p_type"), level, F.lit("<PART>")))
    return read("part").select("p_partkey", rewrite.coarsest(lattice, F.lit("part")).alias("replacement"))


def _redacted(read):
    docs = read("documents").select("doc_id", "text", "source")
    s = rewrite.number_placeholders(spans.resolve(_spans(read)))
    return rewrite.splice(docs, s), s


@query("K5_oracle_extractor", "SELECT doc_id, text AS restored FROM documents")
def _(read, spark):
    """Redaction and literal restoration, longest replacement first, give every text back."""
    red, s = _redacted(read)
    pairs = s.groupBy("doc_id").agg(F.collect_set(F.struct("surface", "replacement")).alias("r"))
    back = F.when(F.col("r").isNull(), F.col("redacted")).otherwise(rewrite.restore_longest_first(F.col("redacted"), F.col("r")))
    return red.join(pairs, "doc_id", "left").select("doc_id", back.alias("restored"))


@query("L1_restore_placeholders", "SELECT doc_id, text AS restored FROM documents")
def _(read, spark):
    """As above by the one-pass alternation."""
    red, s = _redacted(read)
    return rewrite.restored(red, s).select("doc_id", "restored")


@query("L2_canonical_surface", with_spans("""SELECT doc_id, type, max_by(surface, (len(surface), -start, -"end")) AS surface FROM s GROUP BY doc_id, type"""))
def _(read, spark):
    return _spans(read).groupBy("doc_id", "type").agg(F.max_by("surface", F.struct(F.length("surface"), -F.col("start"), -F.col("end"))).alias("surface"))


@query("K1_substitute")
def _(read, spark):
    s = spans.chains(spans.resolve(_spans(read)))
    lattice = F.array(F.concat(F.lit("a "), F.lower("type"), F.lit(" of "), F.length("surface").cast("string"), F.lit(" letters")), F.lit("something"))
    return rewrite.substitute(s.withColumns({"lattice": lattice, "risks": F.array(F.lit(0.4), F.lit(0.2))})).drop("lattice", "risks")


_HALF = f"regexp_replace(text, '{patterns.PATTERNS['ipv4'][1]}', '<CODE>', 'g')"
_LEAKS = with_spans(f"""SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN contains({CANON.format(_HALF)}, {CANON.format('surface')}) THEN 1 ELSE 0 END), 0) AS BIGINT) AS leaks,
 CASE WHEN coalesce(sum(CASE WHEN contains({CANON.format(_HALF)}, {CANON.format('surface')}) THEN 1 ELSE 0 END), 0) > 0 THEN 1.0 ELSE 0.0 END AS attack_success
 FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id""", ("email", "ipv4"))


def _attack(read):
    half = read("documents").withColumn("redacted", F.regexp_replace("text", patterns.PATTERNS["ipv4"][1], "<CODE>"))
    return probes.surface_attack(half, _spans(read, "email", "ipv4"))


@query("M1_leak_attackers", _LEAKS)
def _(read, spark):
    return _attack(read)


@query("M3_realized_privacy", f"SELECT coalesce(round_even(1 - avg(attack_success), 6), 1.0) AS realized_privacy FROM ({_LEAKS})")
def _(read, spark):
    return _attack(read).agg(probes.realized_privacy(F.col("attack_success")).alias("realized_privacy"))


@query("M2_reidentifier", """
WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark),
n AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b ON d.t = b.t GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS r FROM n) WHERE r = 1""")
def _(read, spark):
    words = lambda df, k: df.select(k, F.explode(T.tokens(F.col("text"))).alias("t"))
    n = words(read("documents"), "doc_id").join(words(read("benchmark"), "item_id"), "t").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    best = n.groupBy("doc_id").agg(F.max_by(F.struct("item_id", "shared"), F.struct("shared", -F.col("item_id"))).alias("b"))
    return best.select("doc_id", "b.item_id", "b.shared")


@query("M4_privacy_bins", "SELECT printf('%.2f', floor(l_discount / 0.05) * 0.05) || '-' || printf('%.2f', floor(l_discount / 0.05) * 0.05 + 0.05) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(read, spark):
    return read("lineitem").groupBy(probes.privacy_bin(F.col("l_discount")).alias("bin")).agg(F.count("*").alias("n"))


@query("M7_word_survival", """SELECT p_partkey, len(list_intersect(a, b)) / nullif(len(a), 0) AS survival FROM (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z]+')) AS b FROM part)""")
def _(read, spark):
    return read("part").select("p_partkey", probes.survival(T.tokens(F.concat_ws(" ", "p_name", "p_type")), T.tokens(F.col("p_type"))).alias("survival"))


_GRAMS = " * ".join(f"CASE WHEN len(w) >= {n} THEN len(list_distinct([array_to_string(w[i:i + {n - 1}], ' ') for i in range(1, len(w) - {n - 2})])) / (len(w) - {n - 1}) ELSE 0 END" for n in (2, 3, 4))


@query("M12_diversity", f"SELECT doc_id, {_GRAMS} AS diversity FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)")
def _(read, spark):
    return probes.diversity(read("documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")).alias("w")))


@query("M16_plugin_mi", """
WITH p AS (SELECT event_type AS x, user_id % 10 AS y, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT sum(n) AS t FROM p),
h AS (SELECT -sum(c / t * log2(c / t)) + (count(*) - 1) / (2 * max(t) * ln(2)) AS h, 1 AS s FROM (SELECT sum(n) AS c FROM p GROUP BY x), t
 UNION ALL SELECT -sum(c / t * log2(c / t)) + (count(*) - 1) / (2 * max(t) * ln(2)), 1 FROM (SELECT sum(n) AS c FROM p GROUP BY y), t
 UNION ALL SELECT -sum(c / t * log2(c / t)) + (count(*) - 1) / (2 * max(t) * ln(2)), -1 FROM (SELECT n AS c FROM p), t)
SELECT sum(h * s) AS mi FROM h""")
def _(read, spark):
    return probes.plugin_mutual_information(read("events").select("event_type", (F.col("user_id") % 10).alias("y")), "event_type", "y")


@query("M15_channel_information", """
WITH c AS (SELECT event_type AS x, user_id % 10 AS y, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT x, y, n / sum(n) OVER (PARTITION BY x) AS p FROM c),
q AS (SELECT y, sum(p) / (SELECT count(DISTINCT x) FROM p) AS q FROM p GROUP BY y)
SELECT x, sum(p * log2(p / q)) AS bits FROM p JOIN q ON p.y = q.y GROUP BY x""")
def _(read, spark):
    from pyspark.sql import Window

    c = read("events").groupBy(F.col("event_type").alias("x"), (F.col("user_id") % 10).alias("y")).agg(F.count("*").alias("n"))
    return probes.channel_information(c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("x"))))


@query("M18_auc", """
SELECT sum(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0 END) / count(*) AS auc
FROM (SELECT n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1) p, (SELECT n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0) n""")
def _(read, spark):
    rows = read("documents").select("doc_id", "n_chars").join(read("labels"), "doc_id")
    return probes.auc(rows.select(F.col("quality").alias("label"), F.col("n_chars").alias("score")))


@query("M5_inversion_recovery", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS r FROM embeddings),
q AS (SELECT vec_id, r, list_transform(r, lambda x: x * 0.7 + 0.05) AS m FROM v WHERE vec_id % 50 = 0),
d AS (SELECT q.vec_id AS q, list_sum(list_transform(list_zip(q.m, v.r), lambda p: (p[1] - p[2]) ** 2)) AS d, list_sum(list_transform(list_zip(q.m, q.r), lambda p: (p[1] - p[2]) ** 2)) AS own FROM q, v),
a AS (SELECT q, count(*) FILTER (WHERE d < own) AS ahead FROM d GROUP BY q)
SELECT avg(CASE WHEN ahead < 1 THEN 1.0 ELSE 0 END) AS recovery_1, avg(CASE WHEN ahead < 5 THEN 1.0 ELSE 0 END) AS recovery_5 FROM a""")
def _(read, spark):
    raw = F.transform("embedding", lambda x: x.cast("double"))
    v = read("embeddings").select(F.col("vec_id").alias("id"), raw.alias("raw"), F.transform(raw, lambda x: x * 0.7 + 0.05).alias("moved"))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return probes.nearest_recovery(v, square, (1, 5), queries=F.col("id") % 50 == 0)


@query("M20_tags_to_spans", """
WITH t AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'B-x' WHEN 'view' THEN 'I-x' WHEN 'purchase' THEN 'I-y' ELSE 'O' END AS tag FROM events),
k AS (SELECT *, CASE WHEN tag = 'O' THEN NULL ELSE tag[3:] END AS k FROM t), p AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM k),
r AS (SELECT *, sum(CASE WHEN k IS NOT NULL AND (tag LIKE 'B-%' OR p IS NULL OR p <> k) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM p)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, any_value(k) AS type FROM r WHERE k IS NOT NULL GROUP BY user_id, run""")
def _(read, spark):
    e = F.col("event_type")
    tag = F.when(e == "click", "B-x").when(e == "view", "I-x").when(e == "purchase", "I-y").otherwise("O")
    return probes.tags_to_spans(read("events").select("user_id", "event_id", tag.alias("tag")), key="user_id", at="event_id", tag="tag")


_ATTACK = f"attack AS (SELECT red.doc_id, red.source, count(r.surface) AS spans, coalesce(sum(CASE WHEN contains({CANON.format('redacted')}, {CANON.format('r.surface')}) AND {CANON.format('r.surface')} <> '' THEN 1 ELSE 0 END), 0) AS leaks FROM red LEFT JOIN r ON r.doc_id = red.doc_id GROUP BY red.doc_id, red.source)"


@query("flagship_leak_report", with_resolved("SELECT source, count(*) AS documents, CAST(sum(spans) AS BIGINT) AS spans, CAST(sum(leaks) AS BIGINT) AS leaks, coalesce(round_even(1 - avg(CASE WHEN leaks > 0 THEN 1.0 ELSE 0 END), 6), 1.0) AS realized_privacy FROM attack GROUP BY source", f"{REDACTED}, {_ATTACK}"))
def _(read, spark):
    """Detect, resolve, redact: surfaces that survive redaction and realised privacy, by source."""
    red, s = _redacted(read)
    attack = probes.surface_attack(red, s)
    found = s.groupBy("doc_id").agg(F.count("*").alias("spans"))
    rows = red.select("doc_id", "source").join(attack, "doc_id").join(found, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.coalesce("spans", F.lit(0))).alias("spans"), F.sum("leaks").alias("leaks"), probes.realized_privacy(F.col("attack_success")).alias("realized_privacy"))
