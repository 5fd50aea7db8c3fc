"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are sets of word shingles that a document must contain whole, so one necessary shingle is prefix
enough: the window's rarest over all documents. These seeds are looked up at every position of a document; the seed's
place bounds where a window can lie, and the words around it are compared one by one. The documents are read twice,
once to count shingles and once to look up seeds, whatever the size of the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Shingle hashes broadcast whole; of more of them their last FILTER_BITS bits are, at most 2^FILTER_BITS values, and
#: what passes this filter is joined by a shuffle.
BROADCAST_ROWS, FILTER_BITS = 2_000_000, 24
#: Seeds are broadcast with their words up to this many bytes.
BROADCAST_BYTES = 32 << 20
#: Parts of a hot seed in a shuffled join.
SALTS = 16
#: Stands behind a document's shingles, so that documents without any seed keep a row.
END = -1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of ASCII letters, digits and all other characters, A-Z lower-cased; null has none."""
    parts = F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)

    def trimmed(p: Column) -> Column:
        head = F.when(F.element_at(p, 1) == "", 1).otherwise(0)
        tail = F.when(F.element_at(p, -1) == "", 1).otherwise(0)
        return F.slice(p, head + 1, F.greatest(F.size(p) - head - tail, F.lit(0)))

    return _let(parts, trimmed)


def _span(first: Column, last: Column) -> Column:
    """Integers from first to last, none if last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _shingle(w: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, at + j) for j in range(k)])


def benchmark_shingles(items: DataFrame, window: int) -> DataFrame:
    """(item, item_id, n, k, win, pos, h, off, ctx): each item's shingles, shorter items are one shingle of all their
    words; ctx has at most window - 1 words before the shingle, from its word off on, and as many behind its first."""
    base = items.select("item_id", words(F.col("text")).alias("w")).distinct()
    base = base.withColumn("item", F.monotonically_increasing_id())
    base = common.materialize(base.withColumn("n", F.size("w")).where("n > 0"), "items")
    base = base.withColumn("k", F.least(F.lit(SHINGLE), F.col("n"))).withColumn("win", F.least(F.lit(window), F.col("n")))
    rows = base.withColumn("pos", F.explode(_span(F.lit(0), F.col("n") - F.col("k"))))
    h = F.coalesce(*[F.when(F.col("k") == k, _shingle(F.col("w"), F.col("pos"), k)) for k in range(1, SHINGLE + 1)])
    off = F.least(F.col("pos"), F.lit(window - 1))
    return common.materialize(rows.withColumns({"h": h, "off": off, "ctx": F.slice("w", F.col("pos") - off + 1, off + window)}).drop("w"), "shingles")


def _positions(docs: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(keep..., w, pos, h): a row for each shingle of each document, and one with h = END."""
    hashes = lambda k: F.transform(_span(F.lit(0), F.size("w") - k), lambda i: _shingle(F.col("w"), i, k))
    each = [hashes(k) for k in sizes]
    rows = docs.select(*keep, words(F.col("text")).alias("w"))
    rows = rows.select(*keep, "w", F.posexplode(F.concat(*each, F.array(F.lit(END).cast("long")))).alias("i", "h"))
    before, pos = F.lit(0), F.col("i")
    for k in sizes[:-1]:
        before = before + F.greatest(F.lit(0), F.size("w") - k + 1)
        pos = F.when(F.col("i") >= before, F.col("i") - before).otherwise(pos)
    return rows.withColumn("pos", pos).drop("i")


def _among(positions: DataFrame, hashes: DataFrame) -> DataFrame:
    """The positions whose h is among the hashes or END; where these are too many to broadcast, some others too."""
    mask = F.lit(-1 if hashes.count() <= BROADCAST_ROWS else (1 << FILTER_BITS) - 1).cast("long")
    keys = hashes.select("h").unionByName(hashes.sparkSession.range(1).select(F.lit(END).cast("long").alias("h")))
    keys = keys.select(F.col("h").bitwiseAND(mask).alias("key")).distinct()
    return positions.join(F.broadcast(keys), F.col("h").bitwiseAND(mask) == F.col("key"), "left_semi")


def shingle_frequencies(docs: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """(h, freq): occurrences over all documents of the given hashes; counted per task before the shuffle."""
    return _among(_positions(docs, sizes).select("h"), hashes).where(F.col("h") != END).groupBy("h").agg(F.count("*").alias("freq"))


def seeds(shingles: DataFrame, frequencies: DataFrame, window: int) -> DataFrame:
    """The rarest shingle of every window: (seed, h, win, off, ctx, items), a row for each distinct context; ctx has
    the item's words around the shingle, items the ids of all items with this context.

    A window with a shingle that no document holds cannot occur, and has no seed.
    """
    starts = _span(F.greatest(F.lit(0), F.col("pos") + F.col("k") - F.col("win")), F.least(F.col("pos"), F.col("n") - F.col("win")))
    counted = shingles.select("h", "item", "pos", F.explode(starts).alias("start")).join(frequencies, "h", "left").fillna(0, ["freq"])
    rarest = counted.groupBy("item", "start").agg(F.min(F.struct("freq", "h", "pos")).alias("x")).where("x.freq > 0")
    chosen = shingles.join(rarest.select("item", F.col("x.pos").alias("pos")).distinct(), ["item", "pos"])
    return chosen.groupBy("h", "win", "off", "ctx").agg(F.collect_set("item_id").alias("items")).withColumn("seed", F.monotonically_increasing_id())


def _agree(a: Column, at_a: Column, b: Column, at_b: Column, step: int, most: Column) -> Column:
    """How many words in a row agree, from the given places on, to the right (step 1) or to the left (-1)."""
    same = lambda d: F.get(a, at_a + step * d) == F.get(b, at_b + step * d)
    return F.aggregate(_span(F.lit(0), most - 1), F.lit(0), lambda n, d: F.when((n == d) & same(d), d + 1).otherwise(n))


def _covered(ranges: Column) -> Column:
    """Words covered by (start, end) ranges, ends exclusive."""
    def add(acc: Column, r: Column) -> Column:
        fresh = F.greatest(F.lit(0), r.b - F.greatest(r.a, acc.end))
        return F.struct((acc.n + fresh).alias("n"), F.greatest(acc.end, r.b).alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.array_sort(ranges), zero, add).n


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item, or all of a shorter item; a document word inside any occurrence
    of a window is hit; contaminated: n_hit > 0 and share * n_hit >= n_words. Null and wordless texts have no words
    and are clean; wordless items have no windows. Repeated rows stay rows of their own; an item without an id marks
    words but is not listed, repeated items count once; texts of any length are read whole; other columns are ignored,
    whatever their names; either table may be empty.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _by_row(docs.withColumn("row", F.monotonically_increasing_id()), items, item_col, item_text_col, window, share).drop("row")


def _by_row(rows: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int, share: int) -> DataFrame:
    """decontaminate() for rows (row, doc_id, text), with row."""
    items = items.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    shingles = benchmark_shingles(items, window)
    sizes = [r.k for r in shingles.select("k").distinct().orderBy("k").collect()]  # three at most
    frequencies = common.materialize(shingle_frequencies(rows, shingles.select("h").distinct(), sizes), "frequencies")
    chosen = common.materialize(seeds(shingles, frequencies, window), "seeds")
    found = _occurrences(rows, chosen, sizes, window)
    by_row = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("range").alias("ranges"), F.collect_set("seed").alias("seeds"))
    by_row = common.materialize(by_row, "found")
    held = by_row.select("row", F.explode("seeds").alias("seed")).join(chosen.select("seed", F.explode("items").alias("item_id")), "seed")
    listed = held.groupBy("row").agg(F.collect_set("item_id").alias("items"))
    none = F.array().cast("array<string>")
    return _report(by_row.join(listed, "row", "left").withColumn("items", F.coalesce("items", none)), share)


def _occurrences(rows: DataFrame, chosen: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """(row, doc_id, n_words, seed, range): a row for each seed met in a document, seed and range null where the words
    around it do not agree, and at least one for each document."""
    off = F.least(F.col("pos"), F.lit(window - 1))
    met = _among(_positions(rows, sizes, "row", "doc_id"), chosen.select("h").distinct())
    end = F.col("h") == END
    around = F.when(~end, F.slice("w", F.col("pos") - off + 1, off + window))
    met = met.select("row", "doc_id", F.size("w").alias("n_words"), "pos", "h", F.when(~end, off).alias("d_off"), around.alias("d_ctx"))
    size = chosen.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("ctx", " "))).alias("bytes")).first()
    words_of = chosen.select("seed", "h", "win", "off", "ctx")
    if size.n <= BROADCAST_ROWS and (size.bytes or 0) + 64 * size.n <= BROADCAST_BYTES:
        both = met.join(F.broadcast(words_of), "h", "left")
    else:
        met = common.materialize(met.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")), "met")
        salted = words_of.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        both = met.where(~end).join(salted.hint("shuffle_hash"), ["h", "salt"])
        ends = met.where(end).select(*[F.col(c) if c in met.columns else F.lit(None).cast(t).alias(c) for c, t in both.dtypes])
        both = both.unionByName(ends)
    left = _agree(F.col("d_ctx"), F.col("d_off") - 1, F.col("ctx"), F.col("off") - 1, -1, F.least("d_off", "off"))
    right = _agree(F.col("d_ctx"), F.col("d_off"), F.col("ctx"), F.col("off"), 1, F.least(F.size("d_ctx") - F.col("d_off"), F.size("ctx") - F.col("off")))
    both = both.select("row", "doc_id", "n_words", "pos", "seed", "win", left.alias("l"), right.alias("r"))
    hit = F.col("l") + F.col("r") >= F.col("win")
    return both.select("row", "doc_id", "n_words", F.when(hit, F.col("seed")).alias("seed"), F.when(hit, F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))).alias("range"))


def _report(rows: DataFrame, share: int) -> DataFrame:
    hit = F.col("n_hit")
    return rows.select(
        "row", "doc_id", F.col("n_words").cast("long").alias("n_words"), _covered(F.col("ranges")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (hit > 0) & (share * hit >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated; each row for itself, whatever its id.

    Null, empty and wordless texts are clean; long texts are read whole; repeated rows stay or go each for itself;
    other columns are passed on, whatever their names; with an empty benchmark all rows stay.
    """
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = common.materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")  # both sides of the join see the same numbers
    each = rows.select(F.col(number).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    report = _by_row(each, items, "item_id", "text", window, share)
    bad = common.materialize(report.where("contaminated").select(F.col("row").alias("_bad")), "contaminated")
    if bad.count() <= BROADCAST_ROWS:  # row numbers only; beyond that the join shuffles by them, which no key makes hot
        bad = F.broadcast(bad)
    return rows.join(bad, rows[number] == bad["_bad"], "left_anti").drop(number)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every whole text of documents; see decontaminate() for hostile rows."""
    return decontaminate(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, pos.k AS k, item_id FROM pos JOIN win ON pos.k = win.k AND pos.s = win.s),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN per ON dw.doc_id = per.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
