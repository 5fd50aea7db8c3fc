"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import common, tokens

#: Words share this many hash buckets; statistics and their bins have places of their own behind them.
BUCKETS = 1 << 15
STATISTICS = ("length", "words", "word_length", "upper", "digits", "signs", "spaces", "newlines", "non_ascii", "distinct_words", "top_word", "distinct_lines", "line_length", "ends_in_sign", "compressed")
BINS = 8
SIZE = BUCKETS + len(STATISTICS) * (1 + BINS)

_CLASS = np.zeros((256, 6), np.float64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [_b < 128 and _c.isupper(), 48 <= _b < 58, 33 <= _b < 127 and not _c.isalnum(), _b == 32, _b == 10, _b >= 128]


def statistics(text: str, words: list[str], frequencies: Counter) -> np.ndarray:
    """Structure statistics of a whole text and its size, the only metadata used."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / n
    lines = text.split("\n")
    k = max(1, len(words))
    return np.array(
        [
            np.log1p(len(raw)), np.log1p(len(words)), len(raw) / k, *counts, len(frequencies) / k,
            max(frequencies.values(), default=0) / k, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
            sum(c for w, c in frequencies.items() if not w[-1].isalnum()) / k, len(zlib.compress(raw, 1)) / n,
        ]
    )


_BUCKET_OF: dict[str, int] = {}


def hashed_words(frequencies: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's words; the values have norm 1 before words meet in a bucket."""
    if len(_BUCKET_OF) > 500_000:
        _BUCKET_OF.clear()
    get = _BUCKET_OF.get
    at = np.empty(len(frequencies), np.int64)
    for i, w in enumerate(frequencies):
        b = get(w)
        if b is None:
            b = _BUCKET_OF[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        at[i] = b
    value = 1 + np.log(np.fromiter(frequencies.values(), np.float64, len(frequencies)))
    return at, value / max(1e-9, np.sqrt(value @ value))


def raw_features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = text.lower().split()
    frequencies = Counter(words)
    return (*hashed_words(frequencies), statistics(text, words, frequencies))


class FactorisationMachine:
    """w0 + <w, x> + sum over pairs of <v_i, v_j> x_i x_j, scored in linear time as (sum of v x)^2 - sum of (v x)^2."""

    def __init__(self, rank: int = 6, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.w0, self.w = np.zeros(1), np.zeros(SIZE)
        self.v = rng.standard_normal((SIZE, rank)) * 0.02
        self.mean, self.scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
        self.cuts = np.zeros((len(STATISTICS), BINS - 1))

    def place(self, at: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One sparse row: words, standardised statistics, and the bin of each."""
        s = np.arange(len(STATISTICS))
        z = np.clip((stats - self.mean) / self.scale, -4, 4) * 0.3
        bins = (stats[:, None] > self.cuts).sum(axis=1)
        own = BUCKETS + s
        return np.concatenate([at, own, BUCKETS + len(STATISTICS) + s * BINS + bins]), np.concatenate([value, z, np.full(len(STATISTICS), 0.3)])

    def margins(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """at, value: rows one after the other. Margin of each row, and its sums of v x."""
        vx = self.v[at] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[at] * value, starts)
        return self.w0[0] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = 12, least_steps: int = 500, batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> None:
        """Adam on the logistic loss; few rows are gone over more often."""
        epochs = max(epochs, -(-least_steps * batch // len(rows)))
        stats = np.stack([r[2] for r in rows])
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        self.cuts = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        placed = [self.place(*r) for r in rows]
        rng = np.random.default_rng(seed)
        params = [self.w0, self.w, self.v]
        moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.w0[0] = np.log(share / (1 - share))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(placed))
            for a in range(0, len(order), batch):
                rows_at = order[a : a + batch]
                sizes = np.array([len(placed[i][0]) for i in rows_at])
                starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                at = np.concatenate([placed[i][0] for i in rows_at])
                value = np.concatenate([placed[i][1] for i in rows_at])
                margin, sums = self.margins(at, value, starts)
                d = (1 / (1 + np.exp(-margin)) - labels[rows_at]) / len(rows_at)
                each = np.repeat(d, sizes) * value
                g0, gw, gv = np.array([d.sum()]), np.zeros(SIZE), np.zeros_like(self.v)
                np.add.at(gw, at, each)
                np.add.at(gv, at, each[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[at] * value[:, None]))
                step += 1
                lr = rate * (1 - epoch / epochs)
                for p, g, (m, s) in zip(params, (g0, gw + decay * self.w, gv + decay * self.v), moment, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        placed = [self.place(*raw_features(t)) for t in texts]
        rows = np.repeat(np.arange(len(placed)), [len(x) for x, _ in placed])
        # words that meet in a bucket are one feature, as in training
        key, where = np.unique(rows * SIZE + np.concatenate([x for x, _ in placed]), return_inverse=True)
        value = np.bincount(where, np.concatenate([v for _, v in placed]))
        margin, _ = self.margins(key % SIZE, value, np.searchsorted(key, np.arange(len(placed)) * SIZE))
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 8000) -> FactorisationMachine:
    """Fit on labelled rows whose id's crc32 mod 5 is not 0.

    The sample is bounded: the sample_rows labels first by a hash of their id, and at most sample_rows documents of
    them, chosen by a hash of id and text (ids may repeat), so that the fit depends on the rows only. The driver gets
    hashed features in place of texts: at most 6 bytes for each of the BUCKETS buckets and a row of statistics, however
    long a text is. Null ids and labels teach nothing, null texts are empty; without any label (or with empty tables)
    the score is one half; other columns are ignored.
    """
    key = F.col(f"`{id_col}`")
    known = labels.select(key.cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (common.crc_mod5(F.col("doc_id")) != 0))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    rows = docs.select(key.cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def features(batches):
        for batch in batches:
            for a, b, texts in tokens.slices(batch.column(2), 1_000_000):
                found = [raw_features(t) for t in texts]
                at = [np.unique(x[0], return_inverse=True) for x in found]
                value = [np.bincount(i, x[1], minlength=len(u)) for (u, i), x in zip(at, found, strict=True)]
                columns = [[u.astype("<u2").tobytes() for u, _ in at], [v.astype("<f4").tobytes() for v in value], [x[2].astype("<f8").tobytes() for x in found]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *(pa.array(c, pa.binary()) for c in columns)], ["h", "y", "at", "value", "stats"])

    # a bounded number of labels: a broadcast of fixed size
    joined = rows.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), F.col("y").cast("int").alias("y"), "text")
    sample = joined.mapInArrow(features, "h long, y int, at binary, value binary, stats binary").orderBy("h", "y").limit(sample_rows).collect()
    model = FactorisationMachine()
    if sample:
        parts = [(np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.value, "<f4").astype(float), np.frombuffer(r.stats, "<f8")) for r in sample]
        model.fit(parts, np.array([r.y for r in sample], float))
    return model


def score(docs: DataFrame, model: FactorisationMachine, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).

    A null text is scored as an empty one, a long one whole; repeated rows stay and score alike; other columns are
    ignored, whatever their names; a null id is not held out; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tokens.release()
        machine = shared.value
        for batch in batches:
            for a, b, texts in tokens.slices(batch.column(1), 1_000_000):
                s = machine.scores(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    key = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(common.crc_mod5(key) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents as labels.quality marks it; see train() and score() for hostile rows."""
    docs = common.read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read_table(spark, sf_dir, "labels")))
