"""String functions of the privacy pipeline as Column expressions. Variants that differ in one class stay apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that results depend on
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
MONTHS = "january february march april may june july august september october november december".split()
SALTS = ("hydrochloride", "sodium", "potassium", "sulfate", "acetate", "maleate")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def squeeze(c: Column) -> Column:
    """Runs of ASCII white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def canonical(c: Column) -> Column:
    """Comparison form of metrics and attackers: lower case, ages spelt out, only a-z 0-9 _ < > kept."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("-year-old"), F.lit(" years old")), r"[^a-z0-9_<>]+", " "))


def canonical_plain(c: Column) -> Column:
    """The stricter comparison form of loaders: _ < > do not survive."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("-year-old"), F.lit(" years old")), r"[^a-z0-9]+", " "))


def clinical_canonical(c: Column) -> Column:
    """Answer form: 'dr' before white space is 'doctor', milligrams are 'mg'."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\bdr\.?(?=\s)", "doctor"), r"\bmilligrams?\b", "mg")


def normalized(c: Column) -> Column:
    """Profile key: trimmed, lower case, single spaces."""
    return squeeze(F.lower(c))


def strip_plural(c: Column) -> Column:
    """Profile plural fold: every final s goes ('illness' is 'illne')."""
    return F.regexp_replace(normalized(c), "s+$", "")


def singular_token(c: Column) -> Column:
    """Token plural fold: 'ies' is 'y' in words over 4 letters; a last s goes in words over 3 letters, not after s."""
    return (
        F.when((F.length(c) > 4) & c.endswith("ies"), F.concat(F.substring(c, F.lit(1), F.length(c) - 3), F.lit("y")))
        .when((F.length(c) > 3) & c.endswith("s") & ~c.endswith("ss"), F.substring(c, F.lit(1), F.length(c) - 1))
        .otherwise(c)
    )


def singular_words(c: Column) -> Column:
    """Per-word token fold of a phrase."""
    return F.array_join(F.transform(F.split(c, " "), singular_token), " ")


def mined_normal(c: Column) -> Column:
    """Mined-surface form: '&' is 'and', only letters, digits and + - stay."""
    return squeeze(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"[^a-z0-9+-]+", " "))


def coherence_normal(c: Column) -> Column:
    """Level-label form: _ and - are spaces."""
    return squeeze(F.translate(F.lower(c), "_-", "  "))


def noise_normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def noise_type(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(F.lower(c)), F.lit("_"), F.lit("-")), r"[ \t\n\r]+", "-")


def placeholder(type_name: Column, n: Column | None = None) -> Column:
    """<TYPE> or <TYPE_n>; the type in capitals, other characters as single _, OTHER if nothing is left."""
    token = F.regexp_replace(F.regexp_replace(F.upper(type_name), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    token = F.when(F.coalesce(token, F.lit("")) == "", "OTHER").otherwise(token)
    return F.concat(F.lit("<"), token, F.lit(">")) if n is None else F.concat(F.lit("<"), token, F.lit("_"), n.cast("string"), F.lit(">"))


# fixed values: spoken numbers, units and frequencies of a dose
_NUMBER = "(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|half|point|and|a)"
DOSE = (
    rf" +(?:[0-9]+(?:\.[0-9]+)?|{_NUMBER}(?:[ -]{_NUMBER})*) *(?:mg|mcg|milligrams?|micrograms?|grams?|units?)"
    r"(?: +(?:once|twice|three times)? *(?:daily|nightly|weekly|a day|per day|bid|tid|qid|qd|qhs|prn))?$"
)


def strip_dose(c: Column) -> Column:
    """A drug surface without its trailing dose and frequency."""
    return F.trim(F.regexp_replace(c, DOSE, ""))


def without_tokens(c: Column, tokens: list[str]) -> Column:
    """The phrase without the given words (salts of a drug name)."""
    return F.array_join(F.filter(F.split(c, " "), lambda t: ~t.isin(tokens)), " ")


def strip_first_suffix(c: Column, suffixes: list[str]) -> Column:
    """Without the first of the suffixes that matches, in their order."""
    out = F.when(F.lit(False), c)
    for s in suffixes:
        out = out.when(c.endswith(" " + s), F.substring(c, F.lit(1), F.length(c) - len(s) - 1))
    return out.otherwise(c)


def class_label(c: Column) -> Column:
    """A class tag without its ' [EPC]' mark, lower case."""
    return F.lower(F.regexp_replace(c, r" \[EPC\]$", ""))


def words_to_number(c: Column) -> Column:
    """English number words as a double; null if another word stands among them or none is there."""
    words = F.filter(F.split(F.trim(F.lower(c)), r"[ \t\n-]+"), lambda t: ~t.isin("and", "a", "an"))
    small = F.create_map(*[F.lit(x) for p in [*zip(ONES, range(20), strict=True), *TENS.items()] for x in p])
    scale = F.create_map(*[F.lit(x) for p in SCALES.items() for x in p])

    def step(acc: Column, t: Column) -> Column:
        v, s = small[t].cast("double"), scale[t].cast("double")
        cur, total = acc.cur, acc.total
        return F.struct(
            F.when(s.isNotNull(), total + F.greatest(cur, F.lit(1.0)) * s).otherwise(total).alias("total"),
            F.when(v.isNotNull(), cur + v).when(t == "hundred", F.greatest(cur, F.lit(1.0)) * 100).when(s.isNotNull(), 0.0).otherwise(cur).alias("cur"),
            (acc.ok & (v.isNotNull() | s.isNotNull() | (t == "hundred"))).alias("ok"),
        )

    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("cur"), F.lit(True).alias("ok"))
    out = F.aggregate(words, zero, step)
    return F.when((F.size(words) > 0) & out.ok, out.total + out.cur)


def reply_lines(c: Column) -> Column:
    """The first three lines of a reply without list marks; lines of over 8 words or not starting with a letter go."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ ]*(?:[-*]|[0-9]+[.)])[ ]*", "")))
    return F.slice(F.filter(lines, lambda x: x.rlike("^[A-Za-z]") & (F.size(F.split(x, " +")) <= 8)), 1, 3)


def cache_key(text: Column, type_name: Column) -> Column:
    return F.concat_ws("::", type_name, F.lower(F.trim(text)))


def fix_articles(c: Column) -> Column:
    """'a' before a vowel letter is 'an', 'an' before another letter is 'a'; case of the article stays."""
    return F.regexp_replace(F.regexp_replace(c, r"\b([Aa]) (?=[aeiouAEIOU])", "$1n "), r"\b([Aa])n (?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])", "$1 ")


def case_adjust(fill: Column, before: Column) -> Column:
    """A fill capitalised at a sentence start (nothing, . ! ? or newline before it), else with a small first letter."""
    last = F.substring(F.rtrim(before), -1, 1)
    start = (F.length(F.trim(F.coalesce(before, F.lit("")))) == 0) | last.isin(".", "!", "?")
    rest = F.substring(fill, F.lit(2), F.length(fill))
    return F.when(start, F.concat(F.upper(F.substring(fill, 1, 1)), rest)).otherwise(F.concat(F.lower(F.substring(fill, 1, 1)), rest))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def tokens(c: Column, least: int = 1, stop: list[str] | None = None) -> Column:
    """Distinct a-z words of at least `least` letters that are no stop words, in order of appearance."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)")), lambda t: F.length(t) >= least)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(stop)) if stop else found)


def bigram_candidates(c: Column) -> Column:
    """Words over two letters, then pairs of neighbours, each once."""
    w = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"))
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(F.filter(w, lambda t: F.length(t) > 2), pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets, 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def label_overlap(a: Column, b: Column, generic: list[str]) -> Column:
    """Token Jaccard, 0 if the only shared tokens are generic head nouns."""
    shared = F.array_intersect(a, b)
    return F.when(F.forall(shared, lambda t: t.isin(generic)), 0.0).otherwise(jaccard(a, b))


def whole_words_contain(a: Column, b: Column) -> Column:
    """Either token set holds the other; empty sets hold nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def drop_near(anchors: Column, proposed: Column, near: float = 0.5) -> Column:
    """Anchors, then the proposed levels whose words overlap no anchor by `near` or more."""
    words = lambda x: F.array_distinct(F.split(x, " "))
    return F.concat(anchors, F.filter(proposed, lambda p: ~F.exists(anchors, lambda a: jaccard(words(a), words(p)) >= near)))


def source_sentence(text: Column, start: Column, end: Column) -> Column:
    """The stretch between the full stops or newlines around [start, end); offsets are code points from 0."""
    before = F.substring(text, F.lit(1), start)
    after = F.substring(text, end + 1, F.length(text))
    return F.trim(F.concat(F.regexp_extract(before, r"([^.\n]*)$", 1), F.substring(text, start + 1, end - start), F.regexp_extract(after, r"^([^.\n]*)", 1)))


def distance_bucket(d: Column) -> Column:
    """Signed log2 bucket of a distance, -8 to 8."""
    size = F.least(F.lit(8), F.floor(F.log2(F.abs(d).cast("double"))) + 1).cast("int")
    return F.when(d == 0, 0).otherwise(F.signum(d).cast("int") * size)


def fill_key(c: Column) -> Column:
    """Identity of a fill: two that differ in case only are one."""
    return F.lower(c)
