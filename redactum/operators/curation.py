"""Curation: source tables to profiles, label registries, queues, fuzzy scores, assertions and evaluation of predictions."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T


# sources to profiles
def ingredient_index(products: DataFrame) -> DataFrame:
    """products (names array, ingredients array). (name, base): names without digits and of at most four words that lead
    to one ingredient only."""
    rows = products.select(F.explode("names").alias("name"), "ingredients").withColumn("name", F.trim(F.lower("name")))
    rows = rows.where(~F.col("name").rlike("[0-9]") & (F.size(F.split("name", " +")) <= 4)).select("name", F.explode("ingredients").alias("base"))
    return rows.groupBy("name").agg(F.min("base").alias("base"), F.max("base").alias("_b")).where("base = _b").drop("_b")


def counted_surfaces(rows: DataFrame, surface: str, level: str) -> DataFrame:
    """(surface, count, level): rows per surface and the last level in order."""
    return rows.groupBy(F.trim(F.lower(surface)).alias("surface")).agg(F.count("*").alias("count"), F.max(level).alias("level"))


def single_group_titles(rows: DataFrame, title: str, code: str, digits: int = 2) -> DataFrame:
    """(title, group): titles seen under one major group only."""
    g = F.substring(code, 1, digits)
    return rows.groupBy(F.lower(title).alias("title")).agg(F.min(g).alias("group"), F.max(g).alias("_g")).where("group = _g").drop("_g")


def within_length(docs: DataFrame, low: int, high: int, text: str = "text") -> DataFrame:
    return docs.where(F.length(text).between(low, high))


# labels and queues
def label_family(label: Column) -> Column:
    """A detector label in comparable form: lower case, _ and - as single spaces."""
    return F.replace(F.regexp_replace(F.trim(F.lower(label)), r"[ \t_]+", " "), F.lit("-"), F.lit(" "))


def registry_outcomes(labels: DataFrame, registry: DataFrame, default: str = "unmapped") -> DataFrame:
    """labels (label) with outcome and runtime_type of the registry (family, outcome, runtime_type)."""
    f = label_family(F.col("label"))
    r = registry.select(F.col("family").alias("_f"), "outcome", "runtime_type")
    return labels.withColumn("_l", f).join(r, F.col("_l") == F.col("_f"), "left").drop("_l", "_f").fillna({"outcome": default})


def eligible(items: DataFrame, types: list[str]) -> DataFrame:
    """items (surface, runtime_type, levels) with reason, null where an item may enter the queue."""
    s = F.trim("surface")
    return items.withColumn("reason", F.when(F.coalesce(s, F.lit("")) == "", "empty").when(~F.col("runtime_type").isin(types), "type").when(F.size("levels") >= 2, "done").when(s.rlike(r"^[0-9 .,]+$"), "numeric"))


def pending(queue: DataFrame, ledgers: list[DataFrame], key: str) -> DataFrame:
    """Queue rows that no ledger holds: what a resumed run still has to do."""
    out = queue
    for ledger in ledgers:
        out = out.join(ledger.select(key).distinct(), key, "left_anti")
    return out


def requeued(results: DataFrame, limit: int = 1) -> DataFrame:
    """results (item, status, attempt): rejected items whose attempts are not used up, with the next attempt."""
    last = results.groupBy("item").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempt"))
    return last.where((F.col("status") == "rejected") & (F.col("attempt") <= limit)).select("item", (F.col("attempt") + 1).alias("attempt"))


def slotted_order(levels: DataFrame, key: str) -> DataFrame:
    """levels (key, level, slot, rank, baseline) with position: by slot, then rank, then baseline, then name."""
    return levels.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("slot", "rank", "baseline", "level")) - 1)


def median_baseline(levels: DataFrame) -> DataFrame:
    """(type, level, baseline): the median count of a level over all chains."""
    return levels.groupBy("type", "level").agg(F.percentile("count", F.lit(0.5)).alias("baseline"))


def strided_band(rows: DataFrame, by: str, score: str, key: str, n: int) -> DataFrame:
    """n rows of each group at even strides of its score order."""
    w = Window.partitionBy(by)
    r = F.row_number().over(w.orderBy(F.desc(score), key)) - 1
    c = F.count("*").over(w)
    at = F.floor(r * n / c)
    before = F.when(r == 0, -1).otherwise(F.floor((r - 1) * n / c))
    return rows.withColumns({"_a": at, "_b": before}).where("_a <> _b").drop("_a", "_b")


# text pieces
def literal_starts(text: Column, quote: Column) -> Column:
    """Start offsets (from 0) of every place of a literal that does not overlap the one before."""
    gaps = F.split(text, F.concat(F.lit(r"\Q"), quote, F.lit(r"\E")))
    lead = F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0)))
    step = lambda acc, g: F.concat(acc, F.array(F.coalesce(F.element_at(acc, -1) + F.length(quote), F.lit(0)) + F.length(g)))
    empty = F.array().cast("array<int>")
    first = lambda acc, g: F.when(F.size(acc) == 0, F.array(F.length(g))).otherwise(step(acc, g))
    return F.when(F.length(quote) > 0, F.aggregate(lead, empty, first)).otherwise(empty)


def sentence_with(text: Column, entity: Column) -> Column:
    """The first sentence that names the entity; null without one."""
    return F.get(F.filter(F.split(text, r"(?<=[.!?])[ \n]+"), lambda s: F.instr(s, entity) > 0), F.lit(0))


def doubled_word(text: Column) -> Column:
    return text.rlike(r"\b([A-Za-z]{3,}) \1\b")


def word_snap(text: Column, start: Column, end: Column) -> Column:
    """A slice widened to whole words, as struct (start, end)."""
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"([A-Za-z0-9]*)$", 1))
    right = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^([A-Za-z0-9]*)", 1))
    return F.struct((start - left).alias("start"), (end + right).alias("end"))


def fielded(*names: str) -> Column:
    """Columns as 'name: value' lines with each value's span in the text."""
    text, spans = F.lit(""), []
    for i, n in enumerate(names):
        text = F.concat(text, F.lit(("" if i == 0 else "\n") + n + ": "))
        spans.append(F.struct(F.lit(n).alias("field"), F.length(text).alias("start"), (F.length(text) + F.length(n)).alias("end")))
        text = F.concat(text, F.col(n))
    return F.struct(text.alias("text"), F.array(*spans).alias("fields"))


def prose_list(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


# fuzzy scores
#: difflib treats frequent characters of a second text of so many characters or more as junk.
JUNK_FROM = 200
#: Texts of fewer characters are bounded in plain Python, as arrays would cost more, and windows of as short texts kept.
SHORT = 400


def ratio(a: str, b: str) -> float:
    """difflib's ratio, junk heuristic included."""
    if len(a) < JUNK_FROM and len(b) < JUNK_FROM:
        return short_ratio(a, b)
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


@lru_cache(1 << 15)
def short_ratio(a: str, b: str) -> float:
    """difflib's ratio where it knows no junk: the longest common stretch, earliest in a and then in b, and so on to both
    sides of it; found by growing a stretch of a as long as b holds it."""
    if not a and not b:
        return 1.0
    total, rest = 0, [(0, len(a), 0, len(b))]
    while rest:
        i, end, low, high = rest.pop()
        first, size, at, place = i, 0, 0, 0
        while i + size < end:
            j = b.find(a[i : i + size + 1], low, high)
            if j < 0:
                i += 1
            else:
                size, at, place = size + 1, i, j
        if size:
            total += size
            rest += ((first, at, low, place), (at + size, end, place + size, high))
    return 2.0 * total / (len(a) + len(b))


def shared_characters(a: str, b: str) -> list[int] | np.ndarray:
    """For each stretch of b that is as long as a: how many characters it shares with a, in whatever order."""
    n, most = len(a), Counter(a)
    if len(b) < SHORT:
        lack, shared, out = dict(most), 0, []  # lack: what the stretch still lacks of a character, below 0 what it has too many
        for i, c in enumerate(b):
            if c in lack:
                shared += lack[c] > 0
                lack[c] -= 1
            if i >= n and (gone := b[i - n]) in lack:
                lack[gone] += 1
                shared -= lack[gone] > 0
            if i >= n - 1:
                out.append(shared)
        return out
    x = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(b) - n + 1, np.int32)
    for c, m in most.items():
        seen = np.concatenate(([0], np.cumsum(x == ord(c), dtype=np.int32)))
        out += np.minimum(seen[n:] - seen[:-n], m)
    return out


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter text with an equally long stretch of the longer one; `least` if none is above it."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if n == 0:
        return 1.0
    # what a stretch shares bounds what can match
    shared = shared_characters(a, b)
    order = sorted(range(len(shared)), key=shared.__getitem__, reverse=True) if isinstance(shared, list) else np.argsort(-shared, kind="stable").tolist()
    best = least
    for i in order:
        if shared[i] / n <= best:
            break
        best = max(best, ratio(a, b[i : i + n]))
    return best


def contained(a: str, b: str, least: float = 0.0) -> float:
    """containment() of two lower-case texts where it is above `least`, else `least` or less."""
    if a and a in b:
        return 1.0
    x, y = set(re.findall("[a-z0-9]+", a)), set(re.findall("[a-z0-9]+", b))
    shared = " ".join(sorted(x & y))
    token = max(ratio(shared, " ".join(sorted(x))), ratio(shared, " ".join(sorted(y)))) if shared else 0.0
    return max(token, partial_ratio(a, b, max(token, least)))


def containment(surface: pd.Series, text: pd.Series) -> pd.Series:
    """1 for a substring without regard to case, else the better of partial ratio and token set ratio, both over words."""
    return pd.Series([contained((s or "").lower(), (t or "").lower()) for s, t in zip(surface, text, strict=True)], dtype="float64")


def windows_of(phrase: str, words: tuple[str | None, ...], shorter: int, longer: int, keep: int) -> list[tuple[str, float, int, int]]:
    """The `keep` best windows of the words for a phrase: (window, score, words in it, place from 1), best first.

    A window has `shorter` fewer to `longer` more words than the phrase; equal scores go to the shorter, then the earlier
    window. Windows come in that order, so one that cannot pass the last of the best needs no ratio."""
    a, n, best = phrase.lower(), len(phrase.split(" ")), []
    for k in range(max(1, n - shorter), min(n + longer, len(words)) + 1):
        for at in range(len(words) - k + 1):
            least = -best[-1][0] if len(best) == keep else -1.0
            if least >= 1.0:
                return [(w, -s, k, at) for s, k, at, w in best]
            window = " ".join(w for w in words[at : at + k] if w is not None)
            score = contained(a, window.lower(), max(least, 0.0))
            if score > least:
                bisect.insort(best, (-score, k, at + 1, window))
                del best[keep:]
    return [(w, -s, k, at) for s, k, at, w in best]


@lru_cache(1 << 12)
def kept_windows(phrase: str, words: tuple[str | None, ...], shorter: int, longer: int, keep: int) -> list[tuple[str, float, int, int]]:
    return windows_of(phrase, words, shorter, longer, keep)


def best_windows(phrase: Column, words: Column, *, shorter: int = 2, longer: int = 4, keep: int = 12) -> Column:
    """windows_of() as array<struct<window, score, k, at>>, scored as containment(); null where the phrase or the words are,
    and null words are left out of a window's text but hold their place."""

    def run(phrases: pa.Array, texts: pa.Array) -> pa.Array:
        rows, counts = [], []
        for p, w in zip(phrases.to_pylist(), texts.to_pylist(), strict=True):
            if p is None or w is None:
                counts.append(None)
                continue
            f = kept_windows if len(p) + sum(len(x or "") + 1 for x in w) < SHORT else windows_of
            found = f(p, tuple(w), shorter, longer, keep)
            rows += found
            counts.append(len(found))
        ends = np.cumsum([0] + [c or 0 for c in counts])
        offsets = pa.array([None if c is None else o for c, o in zip(counts, ends.tolist())] + [int(ends[-1])], pa.int32())
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["window", "score", "k", "at"]))

    # else the optimizer runs it once more for a filter of its own under the explode
    return F.arrow_udf(run, "array<struct<window:string,score:double,k:int,at:int>>").asNondeterministic()(phrase, words)


def containment_column(surface: Column, text: Column) -> Column:
    return F.pandas_udf(containment, "double")(surface, text)


def best_with_margin(scored: DataFrame, key: str, floor: float, margin: float) -> DataFrame:
    """scored (key, candidate, score): the best candidate of each key at `floor` or more and `margin` ahead of the next."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "candidate")
    rows = scored.withColumns({"_r": F.row_number().over(w), "_n": F.lead("score").over(w)})
    return rows.where((F.col("_r") == 1) & (F.col("score") >= floor) & (F.col("score") - F.coalesce("_n", F.lit(0.0)) >= margin)).select(key, "candidate", "score")


# assertions
def contract_score(kind: Column, text: Column, values: Column) -> Column:
    """contains: all values stand in the text; sections: share of them that do; field: the first value equals the text."""
    t = T.canonical(text)
    has = F.transform(values, lambda v: F.instr(t, T.canonical(v)) > 0)
    share = F.try_divide(F.size(F.filter(has, lambda x: x)), F.size(values))
    return F.when(kind == "contains", F.forall(has, lambda x: x).cast("double")).when(kind == "sections", F.coalesce(share.cast("double"), F.lit(0.0))).otherwise((t == T.canonical(F.get(values, F.lit(0)))).cast("double"))


def reward_role(families: Column, policy: list[str]) -> Column:
    return F.when(F.arrays_overlap(families, F.array(*map(F.lit, policy))), "policy").otherwise("monitoring")


def fact_key(relation: Column, subject: Column, object_: Column, directed: Column) -> Column:
    """Identity of a relation: its sides in order if it is directed, else sorted."""
    sides = F.when(directed, F.array(subject, object_)).otherwise(F.array_sort(F.array(subject, object_)))
    return F.concat_ws("|", relation, F.array_join(sides, "|"))


def competing(surfaces: DataFrame, key: list[str]) -> DataFrame:
    """surfaces (key..., decision, surface). Per decision the sorted surfaces of the other decisions of its group."""
    every = surfaces.groupBy(*key).agg(F.collect_set(F.struct("decision", "surface")).alias("_all"))
    own = surfaces.select(*key, "decision").distinct()
    other = F.array_sort(F.array_distinct(F.transform(F.filter("_all", lambda x: x.decision != F.col("decision")), lambda x: x.surface)))
    return own.join(every, key).select(*key, "decision", other.alias("others"))


def grouped_literals(rows: DataFrame) -> DataFrame:
    """rows (relation, condition, literal). Literals of each relation and condition, for the reverse question."""
    return rows.groupBy("relation", "condition").agg(F.array_sort(F.collect_set("literal")).alias("literals"))


def rejections(candidates: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """candidates with reason: the first rule that holds, null if none does."""
    out = F.when(F.lit(False), "")
    for name, rule in rules:
        out = out.when(rule, name)
    return candidates.withColumn("reason", out)


def review_flags(docs: DataFrame, flags: dict[str, Column], key: str) -> DataFrame:
    """(key, flag) of every flag whose condition holds."""
    arr = F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()]))
    return docs.select(key, F.explode(arr).alias("flag"))


# evaluation of predictions
def pair_accuracy(rows: DataFrame, group: str, truth: str, guess: str) -> DataFrame:
    """(group, accuracy): share of pairs with different truths that the guess orders alike; groups are small menus, folded
    within a row."""
    v = rows.groupBy(group).agg(F.collect_list(F.struct(F.col(truth).cast("double").alias("t"), F.col(guess).cast("double").alias("g"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: a.t < b.t), lambda b: (a.g < b.g).cast("double"))))
    return v.select(group, pairs.alias("p")).where(F.size("p") > 0).select(group, (F.aggregate("p", F.lit(0.0), lambda s, x: s + x) / F.size("p")).alias("accuracy"))


def log_errors(rows: DataFrame, by: str, truth: str, guess: str) -> DataFrame:
    """(by, n, median_error, covered): median absolute log error and the share within a factor of two."""
    e = F.abs(F.ln(F.col(guess) / F.col(truth)))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.percentile(e, F.lit(0.5)).alias("median_error"), F.avg((e <= F.ln(F.lit(2.0))).cast("double")).alias("covered"))


def macro(rows: DataFrame, inner: str, outer: str, value: str) -> DataFrame:
    """(outer, mean): the mean of the inner groups' means, so that large groups do not weigh more."""
    return rows.groupBy(outer, inner).agg(F.avg(value).alias("_m")).groupBy(outer).agg(F.avg("_m").alias("mean"))


def arm_deltas(rows: DataFrame, key: str, arm: str, value: str, a: str, b: str) -> DataFrame:
    """(key, delta): paired difference of two arms, keys with both."""
    pick = lambda x: F.max(F.when(F.col(arm) == x, F.col(value)))
    return rows.groupBy(key).agg((pick(b) - pick(a)).alias("delta")).where("delta IS NOT NULL")


def injective_losses(decisions: DataFrame, key: str) -> DataFrame:
    """decisions (key, position, fill): fills an earlier decision of the document has, and how many decisions lose one."""
    w = Window.partitionBy(key, F.lower("fill")).orderBy("position")
    return decisions.withColumn("_r", F.row_number().over(w)).groupBy(key).agg(F.count_if(F.col("_r") > 1).alias("collisions"), F.count("*").alias("decisions"))


def containment_recall(rows: DataFrame, by: list[str], *, threshold: float = 0.85) -> DataFrame:
    """rows (by..., surface, text). (by..., n, recall): share of surfaces that the text holds by their containment score;
    a null side holds nothing."""
    hit = F.coalesce(containment_column(F.coalesce("surface", F.lit("")), F.coalesce("text", F.lit(""))) >= threshold, F.lit(False))
    return rows.withColumn("_hit", hit.cast("double")).groupBy(*by).agg(F.count("*").alias("n"), F.avg("_hit").alias("recall"))


def sibling_pairs(mentions: DataFrame, key: str, kind: str, at: str, surface: str) -> DataFrame:
    """(key, at, other): pairs of same-type mentions of one document that share their first word, earlier one first: the
    pairs that a similarity model scores, which are the result itself."""
    m = mentions.select(key, kind, at, F.lower(F.split_part(F.col(surface), F.lit(" "), F.lit(1))).alias("_w"))
    other = m.select(key, kind, "_w", F.col(at).alias("other"))
    return m.join(other, [key, kind, "_w"]).where(F.col(at) < F.col("other")).select(key, at, "other")
