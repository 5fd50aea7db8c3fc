"""Generalisation hierarchies: rule buckets, level filters, containment walks, anonymity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T

# fixed values: the phrases and the months' seasons that results must name
DECADES = {20: "twenty", 30: "thirty", 40: "forty", 50: "fifty", 60: "sixty", 70: "seventy", 80: "eighty", 90: "ninety"}
SEASONS = ["winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "autumn", "autumn", "autumn", "winter"]
GENERIC_COUNT = 1e9
TYPE_LABELS = ["a person", "an organization", "a place", "a date", "a quantity", "something"]


def _none() -> Column:
    return F.lit(None).cast("array<string>")


def age_levels(v: Column) -> Column:
    """Thirteen to nineteen: teenaged; twenty to 109: a decade of age; else none."""
    words = F.create_map(*[F.lit(x) for p in DECADES.items() for x in p])
    decade = words[F.least((F.floor(v / 10) * 10).cast("int"), F.lit(90))]
    return F.when(v.between(13, 19), F.array(F.lit("teenaged"))).when(v.between(20, 109), F.array(F.concat(decade, F.lit("-something"))))


def decade_levels(year: Column) -> Column:
    """The early, mid or late part of the decade, then the decade."""
    decade = F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))
    part = F.when(year % 10 < 4, "early").when(year % 10 < 7, "mid").otherwise("late")
    return F.array(F.concat(F.lit("the "), part, F.lit(" "), decade), F.concat(F.lit("the "), decade))


def bucket_date(text: Column) -> Column:
    """Coarser phrases of a date or an age, most specific first; null where nothing is recognised.

    A bare number of up to three digits is an age, never a year.
    """
    return T.let(F.trim(text), _bucket_date)


def _bucket_date(t: Column) -> Column:
    low = F.lower(t)
    digits = t.try_cast("int")
    age_text = F.regexp_extract(low, r"^(.+?)[ -]*years?[ -]*old$", 1)
    age = F.coalesce(T.words_to_number(age_text), F.when(age_text.rlike("^[0-9]{1,6}$"), age_text.try_cast("double")))
    year = F.regexp_extract(t, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    month = F.coalesce(*[F.when(low.rlike(rf"\b{m}\b"), F.lit(i)) for i, m in enumerate(T.MONTHS)])
    season = F.element_at(F.array(*map(F.lit, SEASONS)), month + 1)
    name = F.initcap(F.element_at(F.array(*map(F.lit, T.MONTHS)), month + 1))
    vague = low.rlike(r"\b(spring|summer|autumn|fall|winter|month|week|year)s?\b")
    past = low.rlike(r"\b(last|ago|previous|past)\b")
    return (
        F.when(t.rlike("^(19|20)[0-9]{2}$"), decade_levels(digits))
        .when((age_text != "") & (age > 0), age_levels(age.cast("int")))
        .when(t.rlike("^[0-9]{1,3}$"), age_levels(digits))
        .when(year.isNotNull() & month.isNotNull(), F.concat(F.array(F.concat(name, F.lit(" "), year.cast("string"))), decade_levels(year)))
        .when(year.isNotNull(), decade_levels(year))
        .when(month.isNotNull(), F.array(F.concat(F.lit("the "), season)))
        .when(vague, F.array(F.when(past, "some time ago").otherwise("at some point")))
        .otherwise(_none())
    )


def _plain(x: Column) -> Column:
    """A number with thousands commas from 10 on, else with up to six significant digits."""
    small = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(x >= 10, F.format_number(F.bround(x, 0), 0)).otherwise(small)


def bucket_quantity(text: Column) -> Column:
    """'between half and twice' the number with its unit; k and m suffixes and currency signs are read."""
    return T.let(text, _bucket_quantity)


def _bucket_quantity(text: Column) -> Column:
    number = F.regexp_extract(text, r"([0-9][0-9,.]*)", 1)
    at = F.instr(text, number)
    after = F.substring(text, at + F.length(number), F.length(text))
    suffix = F.lower(F.regexp_extract(after, r"^[ ]?([kKmM])(?![A-Za-z])", 1))
    rest = F.when(suffix != "", F.regexp_replace(after, r"^[ ]?[kKmM]", "")).otherwise(after)
    unit = F.trim(F.concat(F.substring(text, F.lit(1), at - 1), rest))

    def spelt(u: Column) -> Column:
        out = F.when(F.lit(False), u)
        for sign, word in (("$", "dollars"), ("€", "euros"), ("£", "pounds")):
            out = out.when(F.instr(u, sign) > 0, F.concat_ws(" ", F.nullif(F.trim(F.replace(u, F.lit(sign), F.lit(""))), F.lit("")), F.lit(word)))
        return out.otherwise(u)

    unit = T.let(unit, spelt)
    value = F.replace(number, F.lit(","), F.lit("")).try_cast("double") * F.when(suffix == "k", 1_000).when(suffix == "m", 1_000_000).otherwise(1)
    money = F.regexp_extract(text, r"(?i)(dollars?|euros?|pounds?|USD|EUR|GBP|kr)\b", 1)
    before = F.when(money == "", text).otherwise(F.substring(text, F.lit(1), F.instr(text, money) - 1))
    both = F.struct(F.when(number != "", value).otherwise(T.words_to_number(before)).alias("v"), F.when(number != "", unit).otherwise(money).alias("u"))
    phrase = lambda x: F.array(F.trim(F.concat(F.lit("between "), _plain(x.v * 0.5), F.lit(" and "), _plain(x.v * 2), F.lit(" "), x.u)))
    return T.let(both, lambda x: F.when(x.v.isNotNull(), phrase(x)))


def with_placeholder(levels: Column, type_name: Column) -> Column:
    return F.concat(levels, F.array(T.placeholder(type_name)))


def filtered_levels(levels: Column, surface: Column, generic: list[str]) -> Column:
    """Levels in order, equal ones once (without regard to case), without those that hold the surface, only name a
    type, or share a number with the surface."""
    low = F.lower(surface)
    digits = F.regexp_extract_all(surface, F.lit("([0-9]+)"))
    good = F.filter(levels, lambda x: (F.instr(F.lower(x), low) == 0) & ~F.lower(x).isin(generic) & ~F.arrays_overlap(F.regexp_extract_all(x, F.lit("([0-9]+)")), digits))
    return F.filter(good, lambda x, i: F.array_position(F.transform(good, F.lower), F.lower(x)) == i + 1)


def entailed(levels: Column) -> Column:
    """For each level the levels it entails: itself and all coarser ones."""
    return F.transform(levels, lambda x, i: F.struct(x.alias("level"), F.slice(levels, i + 1, F.size(levels)).alias("entails")))


def ancestors(edges: DataFrame, depth: int = 4) -> DataFrame:
    """edges (child, parent). (node, ancestor, hops): all pairs within `depth` steps, shortest distance.

    Joins by level, at most `depth` of them; a cycle ends by the bound.
    """
    step = edges.select("child", "parent").where("child <> parent").distinct()
    level = step.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops"))
    out = level
    for n in range(2, depth + 1):
        level = level.join(step, level["ancestor"] == step["child"]).select("node", F.col("parent").alias("ancestor"), F.lit(n).alias("hops")).distinct()
        out = out.unionByName(level)
    return out.groupBy("node", "ancestor").agg(F.min("hops").alias("hops"))


def descendants(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(node, descendants): how many nodes lie below."""
    return ancestors(edges, depth).groupBy(F.col("ancestor").alias("node")).agg(F.countDistinct("node").alias("descendants"))


def leaf_counts(edges: DataFrame, depth: int = 4) -> DataFrame:
    """(node, leaves): nodes below that are nobody's parent."""
    parents = edges.select(F.col("parent").alias("node")).distinct()
    return ancestors(edges, depth).join(parents, "node", "left_anti").groupBy(F.col("ancestor").alias("top")).agg(F.countDistinct("node").alias("leaves")).withColumnRenamed("top", "node")


def monotone_violations(levels: DataFrame, key: list[str], order: str = "pos", count: str = "count") -> DataFrame:
    """Levels whose count is below that of the level before."""
    w = Window.partitionBy(*key).orderBy(order)
    return levels.withColumn("before", F.lag(count).over(w)).where(F.col(count) < F.col("before"))


def ladder_defects(levels: DataFrame, key: list[str], order: str = "pos", count: str = "count") -> DataFrame:
    """(key, defect) of chains, first that applies: short, invalid, not_monotone, no_expansion."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = levels.withColumn("_b", F.lag(count).over(w))
    c = F.col(count)
    per = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.max(((c.isNull()) | F.isnan(c) | (c < 1)).cast("int")).alias("_bad"), F.max((c < F.col("_b")).cast("int")).alias("_down"), F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    defect = F.when(F.col("_n") < 2, "short").when(F.col("_bad") == 1, "invalid").when(F.col("_down") == 1, "not_monotone").when(F.col("_lo") == F.col("_hi"), "no_expansion")
    return per.select(*key, defect.alias("defect")).where("defect IS NOT NULL")


def date_window_days(fill: Column) -> Column:
    f = F.trim(F.lower(fill))
    months = "|".join(T.MONTHS)
    return (
        F.when(f.rlike("^the (early|mid|late) (19|20)[0-9]0s$"), 3652 / 3).when(f.rlike("^the (19|20)[0-9]0s$"), 3652.0)
        .when(f.rlike(f"^({months}) (19|20)[0-9]{{2}}$"), 30.0).when(f.rlike("^the (winter|spring|summer|autumn|fall)$"), 91.0)
    )


def date_granularity_days(original: Column) -> Column:
    t = F.trim(F.lower(original))
    year, month, day = t.rlike(r"\b(19|20)[0-9]{2}\b"), t.rlike(rf"\b({'|'.join(T.MONTHS)})\b"), t.rlike(r"\b([0-3]?[0-9])(st|nd|rd|th)?\b")
    return F.when(month & year & day, 1.0).when(month, 30.0).when(year, 365.0)


def date_count(fill: Column, original: Column) -> Column:
    """How many dates of the original's grain the fill covers; ages by decade; null where either is not read."""
    return T.let(F.struct(F.trim(F.lower(fill)).alias("f"), original.alias("o")), lambda x: _date_count(x.f, x.o))


def _date_count(f: Column, original: Column) -> Column:
    fill = f
    return (
        F.when(f == "teenaged", 7.0).when(f.rlike("^[a-z]+-something$"), 10.0).when(f.isin("at some point", "some time ago"), GENERIC_COUNT)
        .otherwise(F.greatest(date_window_days(fill) / date_granularity_days(original), F.when(date_window_days(fill).isNotNull() & date_granularity_days(original).isNotNull(), 1.0)))
    )


def quantity_step(number: Column) -> Column:
    """Weight of the last digit that is not a trailing zero, read from the decimal text."""
    fraction = F.regexp_replace(F.regexp_extract(number, r"\.([0-9]*)$", 1), "0+$", "")
    whole = F.regexp_extract(F.regexp_replace(number, r"\.[0-9]*$", ""), "(0*)$", 1)
    return F.when(F.length(fraction) > 0, F.pow(F.lit(10.0), -F.length(fraction))).otherwise(F.pow(F.lit(10.0), F.length(whole)))


def quantity_count(fill: Column, original: Column) -> Column:
    """Values of the original's precision between the bounds of the fill, one at least."""
    return T.let(F.struct(fill.alias("f"), original.alias("o")), lambda x: _quantity_count(x.f, x.o))


def _quantity_count(fill: Column, original: Column) -> Column:
    number = lambda c, pattern: F.replace(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.lit(","), F.lit(""))
    lo, hi = number(fill, r"(?i)between ([0-9,.]+) and [0-9,.]+"), number(fill, r"(?i)between [0-9,.]+ and ([0-9,.]+)")
    v = number(original, r"([0-9][0-9,.]*)")
    out = (hi.try_cast("double") - lo.try_cast("double")) / quantity_step(v) + 1
    return F.when(out.isNotNull() & v.try_cast("double").isNotNull(), F.greatest(out, F.lit(1.0)))


def anonymity_count(fill: Column, kind: Column, original: Column, looked_up: Column) -> Column:
    """Size of the set a fill hides in: 1 if it is the original or cannot be read, 1e9 for type labels."""
    f = F.trim(F.lower(fill))
    own = F.when(kind.isin("DATETIME", "age"), date_count(fill, original)).when(kind == "QUANTITY", quantity_count(fill, original)).otherwise(looked_up)
    return F.when(f == F.trim(F.lower(original)), 1.0).when(f.isin(TYPE_LABELS), GENERIC_COUNT).otherwise(F.coalesce(F.nullif(own, F.lit(0.0)), F.lit(1.0)))


def profile_scores(actions: DataFrame) -> DataFrame:
    """actions (doc, decision, action, mode, count) with `score`: log count over the decision's highest log count; a kept
    original scores 0, a placeholder 1, and so does all in a decision whose counts are all 1."""
    top = F.max(F.ln("count")).over(Window.partitionBy("doc", "decision"))
    score = F.when(F.col("mode") == "keep", 0.0).when(F.col("mode") == "placeholder", 1.0).when(top == 0, 1.0).otherwise(F.ln("count") / top)
    return actions.withColumn("score", score)


def normalized(values: DataFrame, key: list[str], value: str) -> DataFrame:
    """values with `normal`: share of the group's maximum, within [0, 1]; 1 for a single row."""
    w = Window.partitionBy(*key)
    return values.withColumn("normal", F.when(F.count("*").over(w) == 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(value), F.max(value).over(w))))))


def is_type_name(phrase: Column) -> Column:
    """The phrase only names a type, without regard to case and outer blanks."""
    return F.trim(F.lower(phrase)).isin(TYPE_LABELS)


def ordered_levels(actions: Column) -> Column:
    """Levels of actions (structs index, level) in authored order, placeholders left out."""
    return F.transform(F.array_sort(F.filter(actions, lambda x: ~x["level"].startswith("<"))), lambda x: x["level"])


def universe_counts(members: DataFrame, phrase: str, *columns: str) -> DataFrame:
    """members (own name, then its units). (level, count): members below the level 'phrase X' of every unit."""
    names = F.explode(F.array(*[F.col(c) for c in columns[1:]]))
    return members.select(names.alias("x")).where("x IS NOT NULL").groupBy(F.concat(F.lit(phrase + " "), "x").alias("level")).agg(F.count("*").alias("count"))
