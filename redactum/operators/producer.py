"""Proposing, gating and describing generalisation levels: predicates and reports as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T

# fixed values: levels too broad to be a profession, and their endings
GENERIC_PROFESSIONS = [
    "worker", "professional worker", "technical worker", "production worker", "education worker", "arts and media worker",
    "business and financial occupation", "architecture and engineering occupation", "science occupation", "construction worker",
    "installation and repair worker", "transportation and material moving worker",
]
GENERIC_ENDINGS = [" worker", " occupation", " professional"]
# fixed values: words of aliases that name nothing
FILLER_WORDS = [
    "clinical", "agent", "substance", "reference", "entry", "record", "formulation", "preparation", "product", "variant", "drug", "medication",
    "therapeutic", "pharmaceutical", "designated", "indexed", "target", "compound", "chemical", "medicinal", "molecule", "material", "biological",
    "code", "fragment",
]
PLACEHOLDER = "^<[A-Z_]+_?[0-9]*>$"

CANDIDATES = "array<struct<level:string,count:double,source_family:string,selector:string,count_evidence:string,rationale:string>>"


def parse_candidates(rows: DataFrame, payload: str, *key: str) -> DataFrame:
    """(key..., position, level, count, source_family, selector, count_evidence, rationale): the levels of model replies.

    A reply is a JSON object with `candidates`, or with `candidate_levels`, plain strings whose selector is that name.
    Other replies and null ones give no rows; blank levels are left out; a missing source is 'model-proposed'.
    """
    parsed = F.from_json(payload, f"candidates {CANDIDATES}, candidate_levels array<string>")
    plain = F.transform(parsed.candidate_levels, lambda x: F.struct(
        x.alias("level"), F.lit(None).cast("double").alias("count"), F.lit(None).cast("string").alias("source_family"), F.lit("candidate_levels").alias("selector"),
        F.lit(None).cast("string").alias("count_evidence"), F.lit(None).cast("string").alias("rationale"),
    ))
    out = rows.select(*key, F.posexplode(F.coalesce(parsed.candidates, plain)).alias("position", "c")).where("trim(c.level) <> ''")
    return out.select(*key, "position", F.trim("c.level").alias("level"), "c.count", F.coalesce("c.source_family", F.lit("model-proposed")).alias("source_family"), "c.selector", "c.count_evidence", "c.rationale")


def model_proposed(source: Column, status: Column) -> Column:
    return F.coalesce(source == "model-proposed", F.lit(False)) | F.coalesce(status == "model-proposed", F.lit(False))


def model_evidence(*fields: Column) -> Column:
    """Every field of a proposal's evidence is there and not blank."""
    out = F.lit(True)
    for f in fields:
        out = out & (F.coalesce(F.trim(f.cast("string")), F.lit("")) != "")
    return out


def generic_profession(level: Column) -> Column:
    """A known broad level, or one of at most three words with a broad ending."""
    t = T.normalized(level)
    ending = F.lit(False)
    for e in GENERIC_ENDINGS:
        ending = ending | t.endswith(e)
    return t.isin(GENERIC_PROFESSIONS) | ((F.size(F.split(t, " ")) <= 3) & ending)


def filler_aliases(aliases: Column, words: list[str] | None = None) -> Column:
    """Two or more aliases, every one of filler words only."""
    filler = F.array(*map(F.lit, words or FILLER_WORDS))
    tokens = lambda a: F.regexp_extract_all(F.lower(a), F.lit("([a-z0-9]+)"))
    return (F.size(aliases) > 1) & F.forall(aliases, lambda a: (F.size(tokens(a)) > 0) & (F.size(F.array_except(tokens(a), filler)) == 0))


def admissible_count(count: Column, status: Column, source: Column, members: Column, selector: Column, evidence: Column, universe: Column) -> Column:
    """The count, if it is finite, at least 1, and its status has the evidence it needs; else null."""
    c = count.cast("double")
    there = lambda x: F.coalesce(x != "", F.lit(False))
    backed = (
        F.when(status == "certifying", there(members)).when(status == "model-proposed", there(selector) & there(evidence))
        .when(status == "proposal-universe", there(members) | there(universe)).otherwise(F.lit(False))
    )
    return F.when(~F.isnan(c) & (c >= 1) & (c < float("inf")) & there(source) & backed, c)


def chain_sufficient(candidates: DataFrame, key: str, level: str, members: str, *, least: int = 2, floor: float = 100.0) -> DataFrame:
    """(key, sufficient): at least `least` levels, the broadest of at least `floor` members; a null member is none."""
    sizes = candidates.groupBy(key, level).agg(F.countDistinct(members).alias("_n"))
    return sizes.groupBy(key).agg(((F.count("*") >= least) & (F.max("_n") >= floor)).alias("sufficient"))


def category_coverage(labels: DataFrame, rows: DataFrame, label: str, floor: int) -> DataFrame:
    """(label, n, needed) of every label of the registry, those without rows too."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return labels.select(label).distinct().join(counts, label, "left").fillna({"n": 0}).withColumn("needed", F.col("n") < floor)


def rejection_feedback(rejected: DataFrame, hints: dict[str, str]) -> DataFrame:
    """rejected (reason, level, count, ...) with hint: the reason's sentence with {level} and {count} filled in, null for
    a reason that has none."""
    template = F.create_map(*[F.lit(x) for kv in hints.items() for x in kv])[F.col("reason")]
    level = F.coalesce(F.col("level"), F.lit("this rung"))
    count = F.coalesce(F.col("count").cast("string"), F.lit("None"))
    return rejected.withColumn("hint", F.replace(F.replace(template, F.lit("{level}"), level), F.lit("{count}"), count))


def context_packets(mentions: DataFrame, key: str, at: str, context: str, *, most: int, chars: int) -> DataFrame:
    """(key, contexts, packet): the first `most` different contexts of an item in order of `at`, each cut to `chars`
    characters, numbered in one prompt; the limits are the packet's size. Only the first ones of each item are held."""
    once = mentions.groupBy(key, F.substring(F.col(context), 1, chars).alias("_c")).agg(F.min(at).alias("_at"))
    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_at", "_c"))).where(F.col("_r") <= most)
    line = F.concat(F.col("_r").cast("string"), F.lit(": "), "_c")
    packed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))).alias("x"))
    return packed.select(key, F.size("x").cast("long").alias("contexts"), F.array_join(F.transform("x", lambda i: i.line), "\n").alias("packet"))


def level_violations(levels: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """levels with rule: every rule that holds, one row each."""
    return levels.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(r, n) for n, r in rules])))) if rules else levels.limit(0).withColumn("rule", F.lit(""))


def proposed_rules(level: Column, count: Column, source: Column) -> list[tuple[str, Column]]:
    """What a proposed level must not be: uncounted, a placeholder, in capitals, without a source."""
    c = count.cast("double")
    return [
        ("count", c.isNull() | F.isnan(c) | (c < 1)), ("placeholder", level.rlike(PLACEHOLDER)), ("casing", level != F.lower(level)),
        ("grounding", F.coalesce(F.trim(source), F.lit("")) == ""),
    ]


def ladder_issues(ladder: DataFrame, key: str, at: str, count: str, *, jump: float = 10.0) -> DataFrame:
    """(key, issue, n): steps of a ladder that do not broaden, or broaden by more than `jump` times."""
    before = F.lag(count).over(Window.partitionBy(key).orderBy(at))
    steps = ladder.withColumn("_b", before).where("_b IS NOT NULL")
    issue = F.when(F.col(count) == F.col("_b"), "flat").when(F.col(count) < F.col("_b"), "narrows").when(F.col(count) > jump * F.col("_b"), "jumps")
    return steps.groupBy(key, issue.alias("issue")).agg(F.count("*").alias("n")).where("issue IS NOT NULL")


def informative(levels: Column, broad: list[str]) -> Column:
    """Levels that are not on the list of broad ones, without regard to case and blanks."""
    return F.filter(levels, lambda x: ~T.normalized(x).isin(broad))


def code_levels(code: Column, widths: tuple[int, ...], names: dict[str, str] | None = None, last: str | None = None) -> Column:
    """Levels of a hierarchical code: its prefixes, by name where the table has one (without names: the prefixes
    themselves; with names, nameless prefixes have no level), then `last`; equal levels once."""
    parts = [F.when(F.length(code) >= w, F.substring(code, 1, w)) for w in widths]
    if names is not None:
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        parts = [table[p] for p in parts]
    return F.array_distinct(F.array_compact(F.array(*parts, *([F.lit(last)] if last else []))))


def add_resolved_aliases(profiles: DataFrame, resolved: DataFrame) -> DataFrame:
    """profiles (type, canonical, alias), resolved (alias, canonical). The profiles' rows and a row for every resolved
    alias whose canonical has a profile; aliases that are there already are not repeated."""
    known = profiles.select("type", "canonical").distinct()
    return profiles.unionByName(resolved.join(known, "canonical").select("type", "canonical", "alias")).distinct()


def without_profile(surfaces: DataFrame, profiles: DataFrame, surface: str) -> DataFrame:
    """Distinct surfaces, compared in normal form, that no profile names."""
    known = profiles.select(T.normalized(F.col(surface)).alias("_k")).distinct()
    return surfaces.select(F.col(surface), T.normalized(F.col(surface)).alias("_k")).distinct().join(known, "_k", "left_anti").select(surface).distinct()


def by_type(kind: Column, levels: dict[str, Column]) -> Column:
    """Levels from the source that the type names; other types have none."""
    out = F.lit(None).cast("array<string>")
    for name, value in levels.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def looked_up(key: Column, table: dict[str, str], default: Column | str | None = None) -> Column:
    """A small fixed table's value, else the default (a label phrase, a template, a coarse type)."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


def filled(template: Column, **values: Column) -> Column:
    """A template with every {name} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


# places: a hierarchy of units with names
def place_levels(rows: DataFrame, phrase: str, *names: str) -> Column:
    """'a city in X' for each unit that has a name, narrowest first; a unit named like the place itself is left out."""
    own = F.lower(F.col(names[0]))
    kept = F.filter(F.array(*[F.col(n) for n in names[1:]]), lambda x: x.isNotNull() & (F.lower(x) != own))
    return F.transform(kept, lambda x: F.concat(F.lit(phrase + " "), x))


def place_counts(places: DataFrame, *units: str) -> DataFrame:
    """(grain, name, n): places within each named unit of each grain."""
    each = F.array(*[F.struct(F.lit(u).alias("grain"), F.lower(F.col(u)).alias("name")) for u in units])
    return places.select(F.explode(each).alias("u")).where("u.name IS NOT NULL").groupBy("u.grain", "u.name").agg(F.count("*").alias("n"))


def fill_count(fills: DataFrame, counts: DataFrame, fill: str, phrase: str, grains: list[str]) -> DataFrame:
    """fills with count: the places within X for a fill 'phrase X', from the first grain that knows X; else null."""
    rank = F.array_position(F.array(*map(F.lit, grains)), F.col("grain"))
    best = counts.where(F.col("grain").isin(grains)).groupBy("name").agg(F.min_by("n", rank).alias("count"))
    pattern = f"(?i)^{phrase} (.+)$"
    name = F.lower(F.regexp_extract(F.trim(F.col(fill)), pattern, 1))
    return fills.withColumn("_n", F.when(name != "", name)).join(best.withColumnRenamed("name", "_n"), "_n", "left").drop("_n")
