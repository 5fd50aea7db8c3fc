"""Relations between spans: cue predicates, legality, conflicts, linking and level production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T

# fixed values: word lists that results depend on
NATIONALITIES = [
    "german", "austrian", "polish", "british", "english", "swedish", "swiss", "spanish", "french",
    "american", "romanian", "russian", "italian", "dutch", "greek", "turkish", "norwegian", "danish", "finnish",
    "belgian", "portuguese", "irish", "scottish", "welsh", "czech", "slovak", "hungarian", "bulgarian", "ukrainian",
    "croatian", "serbian", "bosnian", "albanian", "moldovan", "georgian", "armenian", "azerbaijani", "chinese",
    "japanese", "korean", "indian", "pakistani", "afghan", "iranian", "iraqi", "syrian", "lebanese", "israeli",
    "nigerian", "kenyan", "ghanaian", "egyptian", "moroccan", "algerian", "tunisian", "ethiopian", "somali", "manx",
    "sierra leonean",
]
ETHNICITIES = ["kurdish", "gypsy", "gypsies", "roma", "romani", "sami", "tamil", "arab", "chechen", "tatar"]
RELIGIONS = [
    "muslim", "christian", "catholic", "protestant", "jewish", "hindu", "buddhist", "orthodox", "sunni",
    "shia", "islam", "islamic", "christianity", "judaism", "jehovah", "evangelical", "atheist", "agnostic",
]
ORIENTATIONS = ["homosexual", "homosexuality", "gay", "lesbian", "bisexual", "heterosexual", "transsexual", "transgender", "lgbt"]
GENDERS = ["male", "female", "man", "woman", "transgender man", "transgender woman"]
MARITAL = ["married", "divorced", "single", "widow", "widower", "widowed", "unmarried", "separated"]
FAMILY = [
    "father", "mother", "son", "daughter", "brother", "sister", "wife", "husband", "spouse", "child",
    "children", "grandmother", "grandfather", "grandchild", "parent", "sibling", "cousin", "uncle", "aunt",
    "nephew", "niece", "stepson", "stepdaughter", "stepfather", "stepmother", "in-law", "widow", "widower",
]
CONDITION_WORDS = [
    "diabet", "depress", "cancer", "hiv", "aids", "disorder", "syndrome", "disease", "illness",
    "schizophren", "tumour", "tumor", "psychiat", "psycholog", "addict", "alcohol", "dementia", "epilep", "asthma",
    "arthritis", "hepatitis", "paralys", "mesothelioma", "devitalis", "korsakoff", "traumatic stress", "disabil",
    "blood pressure", "infection", "heart attack", "stroke", "injur", "fracture", "wound", "amputat",
]
PROFESSIONS = [
    "journalist", "lawyer", "doctor", "nurse", "teacher", "engineer", "judge", "prosecutor", "accountant",
    "officer", "officers", "police", "policeman", "soldier", "professor", "physician", "architect", "farmer",
    "driver", "businessman", "politician", "priest", "minister", "author", "artist", "actor", "scientist",
]
PLACEHOLDER = r"^<[A-Z_]+_?[0-9]*>$"
DATE_CUES = r"\b([0-9]{1,4}|january|february|march|april|may|june|july|august|september|october|november|december|today|yesterday|tomorrow|spring|summer|fall|autumn|winter|morning|evening|night|week|month|year)\b"
QUANTITY_CUES = r"[0-9$€£%]|\b(dollars?|euros?|pounds?|percent|kg|mg|ml|miles?|hours?)\b"


def demographic_leaf(surface: Column) -> Column:
    """The finer type of a demographic surface, first rule that holds: conditions and orientations come before the
    names of peoples, religions before nationalities."""
    s = F.trim(F.lower(surface))
    n = T.strip_plural(surface)
    words = F.split(s, r"\s+")
    return (
        F.when(s.rlike("|".join(CONDITION_WORDS)), "health-condition").when(s.isin(ORIENTATIONS) | s.contains("homosexual"), "sexual-orientation")
        .when(s.isin(RELIGIONS), "religion").when(s.isin(ETHNICITIES), "ethnicity").when(s.isin(NATIONALITIES) | s.endswith(" national") | s.endswith(" nationals"), "nationality")
        .when(s.isin(GENDERS), "gender").when(s.isin(MARITAL) | n.isin(MARITAL), "marital-status")
        .when(s.isin(FAMILY) | n.isin(FAMILY) | F.arrays_overlap(words, F.array(*map(F.lit, FAMILY))), "family-role")
        .when(s.rlike(r"\b(?:aged|years? old)\b|\b[0-9]{1,3}[- ]year|^[0-9]{1,3}$"), "age")
        .when(s.isin(PROFESSIONS) | n.isin(PROFESSIONS) | s.endswith("ist") | s.endswith("ian"), "profession").otherwise("demographic-other")
    )


def type_sane(kind: Column, fill: Column, window: Column) -> Column:
    """A restored fill may only stand where the text around it has a cue of its type; placeholders never."""
    w = F.lower(window)
    return (
        F.when(F.trim(fill).rlike(PLACEHOLDER), False).when(kind == "DATETIME", w.rlike(DATE_CUES)).when(kind == "QUANTITY", w.rlike(QUANTITY_CUES))
        .when(kind == "CODE", window.rlike(r"[A-Z]{1,6}[-_/]?[0-9]|[0-9][-_/][0-9]|# ?[0-9]")).otherwise(True)
    )


def joined_contractions(text: Column) -> Column:
    """'wan na' and 'gon na' as one word and a space, so that no offset moves."""
    return F.regexp_replace(text, r"\b([Ww]an|[Gg]on) (na)\b", "$1$2 ")


def leak_tokens(question: Column, answer: Column, stop: list[str]) -> Column:
    """Answer words of three letters or more that the question gives away."""
    return F.array_intersect(T.tokens(answer, 3, stop), T.tokens(question, 3, stop))


def typed_pairs(arguments: DataFrame, signatures: DataFrame, place: list[str]) -> DataFrame:
    """arguments (place..., id, type), signatures (relation, subject, object). Pairs of one place whose types fit a relation.

    Arguments of a place meet through the types a relation allows; a place's pairs are the result itself, so a place
    with many arguments of fitting types has as many rows.
    """
    a = arguments.select(*place, F.col("id").alias("subject_id"), F.col("type").alias("subject")).join(signatures, "subject")
    b = arguments.select(*place, F.col("id").alias("object_id"), F.col("type").alias("object"))
    return a.join(b, [*place, "object"]).where("subject_id <> object_id").select(*place, "relation", "subject_id", "object_id")


def without_conflicts(rows: DataFrame, kept: DataFrame, doc: str) -> DataFrame:
    """rows (doc, atoms) whose atoms no kept row of the document shares."""
    a = rows.withColumn("_id", F.xxhash64(doc, F.to_json(F.struct("atoms"))))
    k = kept.select(F.col(doc), F.explode("atoms").alias("_x")).distinct()
    hit = a.select(doc, "_id", F.explode("atoms").alias("_x")).join(k, [doc, "_x"], "left_semi").select(doc, "_id").distinct()
    return a.join(hit, [doc, "_id"], "left_anti").drop("_id")


def clause_failures(levels: DataFrame) -> DataFrame:
    """levels (.., count, status, source, level) with failed: the sorted names of the clauses that do not hold."""
    c = F.col("count")
    tests = {"count": c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 1), "level": F.length(F.trim("level")) > 0, "provenance": F.length("source") > 0, "status": F.col("status").isin("certified", "measured")}
    return levels.withColumn("failed", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in sorted(tests.items())])))


def acceptance(rows: DataFrame, gates: dict[str, tuple[Column, float]]) -> DataFrame:
    """(gate, observed, passed): named means against their thresholds."""
    one = rows.agg(*[F.avg(c.cast("double")).alias(n) for n, (c, _) in gates.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("observed"), (F.col(n) >= t).alias("passed")) for n, (_, t) in gates.items()])).alias("x")).select("x.*")


def sibling(arguments: DataFrame, occurrences: DataFrame) -> DataFrame:
    """arguments (argument, decision, grounded), occurrences (decision, occurrence, start, grounds): the argument's own
    place if it is grounded, else the first occurrence of its decision that grounds."""
    first = occurrences.where("grounds").groupBy("decision").agg(F.min_by("occurrence", F.struct("start", "occurrence")).alias("moved"))
    return arguments.join(first, "decision", "left").withColumn("moved", F.when(~F.col("grounded"), F.col("moved")))


def type_roots(levels: DataFrame) -> DataFrame:
    """levels (type, canonical, level, pos, count). (type, level, members): the level most canonical rows share, then the
    deepest, then of the highest count."""
    per = levels.groupBy("type", "level").agg(F.countDistinct("canonical").alias("members"), F.avg("pos").alias("_d"), F.avg(F.ln("count")).alias("_c"))
    w = Window.partitionBy("type").orderBy(F.desc("members"), F.desc("_d"), F.desc("_c"), "level")
    return per.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("type", "level", "members")


def discriminative_levels(levels: DataFrame, share: float = 0.1) -> DataFrame:
    """Levels whose count is below `share` of their type's highest."""
    return levels.withColumn("_m", F.max("count").over(Window.partitionBy("type"))).where(F.col("count") < share * F.col("_m")).drop("_m")


def identical_pairs(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """(a, b): for rows equal in `by`, each with the smallest of them; a star per group, no pairs."""
    first = rows.groupBy(*by).agg(F.min(key).alias("a"))
    return rows.select(*by, F.col(key).alias("b")).join(first, by).where("a <> b").select("a", "b")


def fold(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """rows (type, canonical, alias) with curated merges (type, keep, fold): folded names become aliases of the kept one."""
    m = merges.select(F.col("type").alias("_t"), F.col("fold").alias("_f"), "keep")
    j = rows.join(m, (rows["type"] == m["_t"]) & (rows["canonical"] == m["_f"]), "left")
    kept = j.select("type", F.coalesce("keep", "canonical").alias("canonical"), "alias")
    folded = j.where("keep IS NOT NULL").select("type", F.col("keep").alias("canonical"), F.col("canonical").alias("alias"))
    return kept.unionByName(folded).distinct()


def ontology_id(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (canonical, aliases), index (surface, id). (canonical, id): the canonical's own id, else the aliases' if they agree."""
    i = index.select(F.col("surface").alias("_s"), F.col("id").alias("_i"))
    own = rows.join(i, rows["canonical"] == i["_s"], "left").select("canonical", "aliases", F.col("_i").alias("own"))
    other = rows.select("canonical", F.explode("aliases").alias("_a")).join(i, F.col("_a") == F.col("_s")).groupBy("canonical").agg(F.when(F.min("_i") == F.max("_i"), F.min("_i")).alias("other"))
    return own.join(other, "canonical", "left").select("canonical", F.coalesce("own", "other").alias("id"))


def top_per_type(rows: DataFrame, n: int, score: str, key: str) -> DataFrame:
    w = Window.partitionBy("type").orderBy(F.desc(score), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def routed_findings(events: DataFrame, routes: dict[str, str], default: str = "triage") -> DataFrame:
    """(queue, item, findings): events to their queues, at most five distinct findings each, in order."""
    queue = F.coalesce(*[F.when(F.col("code") == c, q) for c, q in routes.items()], F.lit(default))
    return events.groupBy(queue.alias("queue"), "item").agg(F.slice(F.array_sort(F.collect_set("finding")), 1, 5).alias("findings"))


def root_last(levels: Column, root: Column) -> Column:
    """Levels with the root moved to the end, added if it is missing."""
    return F.concat(F.filter(levels, lambda x: F.lower(x) != F.lower(root)), F.array(root))


def upsert_levels(existing: Column, incoming: Column) -> Column:
    """Existing levels, then new ones; equal ones once without regard to case."""
    both = F.concat(existing, incoming)
    return F.filter(both, lambda x, i: F.array_position(F.transform(both, F.lower), F.lower(x)) == i + 1)


def mixture(rows: DataFrame, source: str, caps: dict[str, int], key: str, seed: str = "0") -> DataFrame:
    """At most caps[source] rows of each source, in hash order; a sampling operator."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    limit = F.coalesce(*[F.when(F.col(source) == s, n) for s, n in caps.items()], F.lit(0))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(order, key))).where(F.col("_r") <= limit).drop("_r")
