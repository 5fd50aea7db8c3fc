"""Compiling assertions about spans: hedges and negations around relations, free levels, literals, calibration points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T

# fixed values: patterns that results depend on
NEGATIONS = r"\b(?:no|not|without|denies|denied)\b"
HEDGES = r"(?i)\b(?:possibly|possible|maybe|perhaps|might|consider|talk\s+about|discuss|if\s+(?:your|you|we|he|she|it|they|the|his|her|symptoms|there|needed))\b"
CONDITIONAL_QUESTION = r"(?i)\b(?:may|might|could|would|possibl\w*|potential\w*|planned|plan\s+to|consider\w*|recommend\w*|in\s+the\s+future|future|if\s+\w+)\b"
COORDINATION = r"(?i)^[\s,;:/&()\-\.]*(?:\b(?:and|or)\b[\s,;:/&()\-\.]*)*$"
COOCCURRENCE = r"(?i)^[\s,;:/&()\-\.]*(?:\b(?:and|or|with|without|w|associated|along|some|a|an|the)\b[\s,;:/&()\-\.]*)+$"
SCOPE_NEGATION = r"(?i)\b(?:denies|denied|no evidence of|negative for|ruled out|no history of|no known|non-?contributory|without any)\b"
EXEMPT_FROM_HEDGES = "tests_for"
ROLE_PREFIX = r"^(?:the|a|an|this|that|my|his|her|their)\b"
#: Characters before an argument in which a negation counts.
SCOPE = 55


def negated(text: Column) -> Column:
    return F.lower(text).rlike(NEGATIONS)


def hedged(text: Column) -> Column:
    return text.rlike(HEDGES)


def conditional_question(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(CONDITIONAL_QUESTION)


def hedged_window(text: Column, spans: Column, relation: Column) -> Column:
    """The text from the first start to the last end of the arguments is hedged; tests are exempt, as uncertainty about
    a result does not make the test uncertain. spans: array of structs (start, end), ends exclusive; none: false."""
    low = F.array_min(F.transform(spans, lambda s: s["start"]))
    high = F.array_max(F.transform(spans, lambda s: s["end"]))
    window = F.substring(text, low + 1, high - low)
    return F.coalesce(relation != EXEMPT_FROM_HEDGES, F.lit(True)) & F.coalesce(hedged(window), F.lit(False))


def negated_before(text: Column, start: Column) -> Column:
    """A negation stands within SCOPE characters before the argument, in its own sentence."""
    before = F.substring(text, F.greatest(start - SCOPE, F.lit(0)) + 1, F.least(start, F.lit(SCOPE)))
    return F.coalesce(before.rlike(SCOPE_NEGATION + r"[^.?!]*$"), F.lit(False))


def junk_pair(text: Column, first: Column, second: Column, relation: Column, same_class: Column) -> Column:
    """Why a pair of arguments (structs start, end) cannot assert a relation, null if it may: only words of
    co-occurrence between the two sides of a cause, a plain enumeration of the same class, or a negation before one."""
    ordered = first["end"] <= second["start"]
    low = F.when(ordered, first["end"]).otherwise(second["end"])
    high = F.when(ordered, second["start"]).otherwise(first["start"])
    gap = F.substring(text, F.least(low, high) + 1, F.abs(high - low))
    return (
        F.when((relation == "causes_or_explains") & gap.rlike(COOCCURRENCE), "cooccurrence_connector").when(gap.rlike(COORDINATION) & same_class, "coordination_sibling")
        .when(negated_before(text, first["start"]) | negated_before(text, second["start"]), "negation_scope")
    )


def cue_support(quote: Column, relation: Column, cues: dict[str, list[str]]) -> Column:
    """'cue' where the quote holds a whole-word cue of its relation, else 'judge': only these go to the model."""
    out = F.lit(False)
    for name, words in cues.items():
        out = F.when(relation == name, F.lower(quote).rlike(r"\b(?:" + "|".join(words) + r")\b")).otherwise(out)
    return F.when(out, "cue").otherwise("judge")


def role_phrases(rows: DataFrame, phrase: str, nouns: DataFrame) -> DataFrame:
    """rows with role: an article or possessive in front, or a single word that the table of nouns (noun) has."""
    t = F.trim(F.lower(F.col(phrase)))
    words = F.regexp_extract_all(t, F.lit("([a-z]+)"))
    known = nouns.select(F.col("noun").alias("_noun"), F.lit(True).alias("_known")).distinct()
    joined = rows.withColumn("_noun", F.when(F.size(words) == 1, words[0])).join(known, "_noun", "left")
    return joined.withColumn("role", t.rlike(ROLE_PREFIX) | F.coalesce("_known", F.lit(False))).drop("_noun", "_known")


def legal(arguments: DataFrame, signatures: DataFrame, by: list[str]) -> DataFrame:
    """arguments with legal: the signature table has their types."""
    s = signatures.select(*[F.col(c).alias(f"_{c}") for c in by], F.lit(True).alias("_legal")).distinct()
    on = [arguments[c] == s[f"_{c}"] for c in by]
    return arguments.join(s, on, "left").withColumn("legal", F.coalesce("_legal", F.lit(False))).drop("_legal", *[f"_{c}" for c in by])


def context_literals(docs: DataFrame, patterns: dict[str, str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, type, start, end, literal) of every match of a pattern's first group, a literal once for its place."""
    from redactum.operators import patterns as P

    out = P.detect(docs, {k: (k, p, 0.0) for k, p in patterns.items()}, key=key, text=text)
    return out.select(key, "type", "start", "end", F.col("surface").alias("literal")).distinct()


def promoted_literals(literals: DataFrame, occurrences: DataFrame, *, key: str, least: int = 3) -> DataFrame:
    """literals (key, literal), occurrences (key, occurrence, surface, controlled, level). A literal whose words hold all
    words of a controlled surface that has a level is linked to the first such occurrence: with occurrence, surface and
    level, null where none fits.

    They meet by the words of one document: a surface is dealt by its first word in order only, which its words need.
    """
    words = lambda c: F.array_sort(F.array_distinct(T.tokens(F.col(c), least, [])))
    l = literals.select(key, "literal").distinct().withColumn("_l", words("literal")).where(F.size("_l") > 0)  # noqa: E741
    o = occurrences.where("controlled AND level IS NOT NULL").withColumn("_s", words("surface")).where(F.size("_s") > 0)
    o = o.select(key, "occurrence", "surface", "level", "_s", F.col("_s")[0].alias("_w"))
    met = l.withColumn("_w", F.explode("_l")).join(o, [key, "_w"]).where(F.size(F.array_except("_s", "_l")) == 0)
    first = met.groupBy(key, "literal").agg(F.min(F.struct("occurrence", "surface", "level")).alias("x"))
    return l.drop("_l").join(first, [key, "literal"], "left").select(key, "literal", "x.occurrence", "x.surface", "x.level")


def first_free_level(plans: DataFrame, taken: DataFrame, *, key: str, at: str, level: str) -> DataFrame:
    """plans (key, at, level), taken (key, term): the first level, in order, that holds no taken term as a phrase; if all
    do, the first of all. The terms of a key are few and travel as one array."""
    t = taken.groupBy(key).agg(F.collect_set(T.canonical(F.col("term"))).alias("_t"))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    hit = F.exists("_t", lambda x: (x != "") & F.contains(padded(T.canonical(F.col(level))), padded(x)))
    rows = plans.join(t, key, "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return rows.groupBy(key).agg(F.min_by(level, F.struct("_hit", at)).alias("level"))


def set_rows(facts: DataFrame, by: list[str], member: str, *, least: int = 2) -> DataFrame:
    """(by..., members): one set-valued row for the sides of a relation that several members share."""
    return facts.groupBy(*by).agg(F.array_sort(F.collect_set(member)).alias("members")).where(F.size("members") >= least)


def delivered_candidates(decisions: DataFrame, facts: DataFrame, on: str, *, by: str, least: int = 2) -> DataFrame:
    """decisions joined to the parsed facts they name, with n: kept where a document has `least` or more of them.
    Counted before the join back, so that no document is gathered."""
    joined = decisions.join(facts, on)
    n = joined.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return joined.join(n, by)


def second_pass(targets: DataFrame, kept: DataFrame, rejected: DataFrame, key: str, repairable: list[str]) -> DataFrame:
    """(key, why): targets that a second pass takes up, those without any kept fact ('missed') and those rejected for a
    repairable reason ('repair', which comes first)."""
    missed = targets.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti").withColumn("why", F.lit("missed"))
    repair = rejected.where(F.col("reason").isin(repairable)).select(key).distinct().withColumn("why", F.lit("repair"))
    return missed.unionByName(repair).groupBy(key).agg(F.max("why").alias("why"))


def migrated(old: DataFrame, new: DataFrame, key: str, frozen: list[str]) -> DataFrame:
    """(key, state): 'migrated' where the frozen fields are equal (null to null), 'changed' where not, 'gone' without a
    counterpart."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*[df[c] for c in frozen]), {"ignoreNullFields": "false"}), 256)
    a, b = old.select(key, digest(old).alias("_a")), new.select(key, digest(new).alias("_b"))
    state = F.when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "migrated").otherwise("changed")
    return a.join(b, key, "left").select(key, state.alias("state"))


def calibration_pool(trajectories: DataFrame, results: DataFrame, targets: DataFrame, weights: DataFrame) -> DataFrame:
    """Calibration points (doc, vector, utility, count_score, sources).

    trajectories (doc, vector, source, decision, action): a row for each decision of a vector; results (doc, vector,
    component, score); targets (decision, action, count_score); weights (doc, component, weight). Utility is the
    weighted mean of the measured components, count_score the mean over the vector's decisions; a vector without a
    result, or with a decision without a target, makes no point. Equal vectors of several sources are one point.
    """
    known = results.join(weights, ["doc", "component"]).groupBy("doc", "vector").agg(F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("utility"))
    sources = trajectories.groupBy("doc", "vector").agg(F.countDistinct("source").alias("sources"))
    steps = trajectories.select("doc", "vector", "decision", "action").distinct().join(targets, ["decision", "action"], "left")
    scored = steps.groupBy("doc", "vector").agg(F.avg("count_score").alias("count_score"), F.max(F.col("count_score").isNull()).alias("_open")).where("NOT _open").drop("_open")
    return sources.join(scored, ["doc", "vector"]).join(known.where("utility IS NOT NULL"), ["doc", "vector"]).select("doc", "vector", "utility", "count_score", "sources")


def latest_level(levels: DataFrame, by: list[str], fill: str, rank: list[str], entails: Column) -> DataFrame:
    """(by..., fill): the coarsest level that still entails the answer, by the given ranks."""
    return levels.where(entails).groupBy(*by).agg(F.max_by(fill, F.struct(*rank)).alias("fill"))


def protected_terms(surface: Column, *aliases: Column) -> Column:
    """The surface, then its aliases in order, equal ones once; blank and null ones left out."""
    return F.array_distinct(F.filter(F.array(surface, *aliases), lambda x: x.isNotNull() & (F.trim(x) != "")))


def underscored(text: Column) -> Column:
    """snake_case as words, blanks closed up."""
    return F.trim(F.regexp_replace(F.translate(text, "_", " "), r"[ \t\r\n]+", " "))


def clause_text(template: str, *parts: Column) -> Column:
    """The frozen clause of a relation with its phrases typeset in order."""
    return F.format_string(template, *[F.trim(p) for p in parts])
