"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a text, white space included, in windows of WINDOW bytes that overlap. It labels every
position with a distribution over the languages; a position takes its label from the window in which it has at least
CONTEXT bytes on both sides (but at the ends of the text), so that each is labelled once. A document's distribution is
the mean over all its positions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import common, tokens

WINDOW, CONTEXT = 64, 8
#: Windows run through the network together.
LANES = 2048
_ASCII_LETTER = re.compile("[A-Za-z]").search


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes [n, WINDOW], owner [n], owned [n, 2]) of all windows of all texts; owned is the range of positions that
    the window labels. Texts shorter than a window are filled with spaces, which no window owns."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(b.ljust(WINDOW) for b in raw if b), np.uint8)
    starts, owners, owned = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    base, step = 0, WINDOW - 2 * CONTEXT
    for i, b in enumerate(raw):
        n = len(b)
        if not n:
            continue
        at = np.arange(max(1, -(-(n - WINDOW) // step) + 1)) * step
        at[-1] = max(0, min(at[-1], n - WINDOW))
        ends = at + WINDOW - CONTEXT
        ends[-1] = n
        first = np.concatenate(([0], ends[:-1]))
        starts.append(at + base)
        owners.append(np.full(len(at), i))
        owned.append(np.stack([first - at, ends - at], axis=1))
        base += max(n, WINDOW)
    starts = np.concatenate(starts)
    x = data[starts[:, None] + np.arange(WINDOW)] if len(starts) else np.zeros((0, WINDOW), np.uint8)
    return x, np.concatenate(owners), np.concatenate(owned)


def has_letter(text: str) -> bool:
    """A Unicode letter is in the text; numbers, marks and signs are none."""
    return _ASCII_LETTER(text) is not None or (not text.isascii() and any(map(str.isalpha, text)))


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: an S-shaped function without exponentials; its slope is (1 - |y|)^2."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def _slope(y: np.ndarray) -> np.ndarray:
    return (1 - np.abs(y)) ** 2


def _mask(owned: np.ndarray) -> np.ndarray:
    """[time, batch]: 1 where the window labels the position."""
    t = np.arange(WINDOW)[:, None]
    return ((t >= owned[:, 0]) & (t < owned[:, 1])).astype(np.float32)


class BiGru:
    """One gated recurrent layer in each direction and a softmax at every position."""

    def __init__(self, n_out: int, hidden: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.h = hidden
        init = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        # per direction: input table (a byte's row of W and bias), recurrent weights of the gates z, r and of c
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = init(256, 3 * hidden, scale=0.5)
            self.p[f"g{d}"] = init(hidden, 2 * hidden, scale=hidden**-0.5)
            self.p[f"c{d}"] = init(hidden, hidden, scale=hidden**-0.5)
        self.p["o"] = init(2 * hidden, n_out, scale=hidden**-0.5)
        self.p["ob"] = np.zeros(n_out, np.float32)

    def _scan(self, d: str, x: np.ndarray, keep: list | None):
        """x: bytes [time, batch] in reading order. States after each step."""
        table, gates_of, new_of, h = self.p[f"x{d}"], self.p[f"g{d}"], self.p[f"c{d}"], self.h
        state = np.zeros((x.shape[1], h), table.dtype)
        out = np.empty((*x.shape, h), table.dtype)
        for t in range(x.shape[0]):
            row = table[x[t]]
            gates = state @ gates_of
            gates += row[:, : 2 * h]
            _squash(gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            rs = r * state
            c = rs @ new_of
            c += row[:, 2 * h :]
            _squash(c)
            new = np.subtract(c, state, out=out[t])
            new *= z
            new += state
            if keep is not None:
                keep.append((state, z, r, rs, c))
            state = new
        return out

    def probabilities(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: bytes [batch, time]. Distribution at every position [time, batch, languages]."""
        x = np.ascontiguousarray(x.T)
        kf, kb = (None, None) if keep is None else ([], [])
        front, back = self._scan("f", x, kf), self._scan("b", x[::-1], kb)[::-1]
        q = front @ self.p["o"][: self.h]
        q += back @ self.p["o"][self.h :]
        q += self.p["ob"]
        q -= q.max(axis=2, keepdims=True)
        np.exp(q, out=q)
        if keep is not None:
            keep.update(x=x, f=kf, b=kb, both=np.concatenate([front, back], axis=2))
        q /= q.sum(axis=2, keepdims=True)
        return q

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all (or the masked) positions and its gradient, by backpropagation through time."""
        keep: dict = {}
        q = self.probabilities(x, keep)
        steps, batch, h = q.shape[0], q.shape[1], self.h
        weight = (np.ones((steps, batch), q.dtype) if mask is None else mask)[:, :, None]
        weight = weight / weight.sum()
        loss = -(np.log(q[:, np.arange(batch), y] + 1e-9) * weight[:, :, 0]).sum()
        dq = q.copy()
        dq[:, np.arange(batch), y] -= 1
        dq *= weight
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = keep["both"].reshape(-1, 2 * h).T @ dq.reshape(steps * batch, -1)
        g["ob"] = dq.sum(axis=(0, 1))
        dboth = dq @ self.p["o"].T
        for d, order, dstates in (("f", keep["x"], dboth[:, :, :h]), ("b", keep["x"][::-1], dboth[::-1, :, h:])):
            after = np.zeros((batch, h), q.dtype)
            into = np.empty((steps, batch, 3 * h), q.dtype)
            for t in range(steps - 1, -1, -1):
                state, z, r, rs, c = keep[d][t]
                dn = dstates[t] + after
                dc = dn * z * _slope(c)
                drs = dc @ self.p[f"c{d}"].T
                # a gate is (1 + y) / 2 of its squashed sum y
                dz = dn * (c - state) * 0.5 * _slope(2 * z - 1)
                dr = drs * state * 0.5 * _slope(2 * r - 1)
                dgates = np.concatenate([dz, dr], axis=1)
                g[f"c{d}"] += rs.T @ dc
                g[f"g{d}"] += state.T @ dgates
                into[t, :, : 2 * h], into[t, :, 2 * h :] = dgates, dc
                after = dn * (1 - z) + drs * r + dgates @ self.p[f"g{d}"].T
            by_byte = np.argsort(order.ravel(), kind="stable")
            seen, first = np.unique(order.ravel()[by_byte], return_index=True)
            g[f"x{d}"][seen] = np.add.reduceat(into.reshape(-1, 3 * h)[by_byte], first, axis=0)
        return float(loss), g

    def fit(self, windows: np.ndarray, owned: np.ndarray, labels: np.ndarray, *, documents: np.ndarray, steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over batches in which the labels are equally frequent and, within a label, the documents, so that no
        long document outweighs the others. Returns the running mean of the loss."""
        rng = np.random.default_rng(seed)
        weight = 1 / np.bincount(documents)[documents]
        groups = [(g, np.cumsum(weight[g])) for g in (np.flatnonzero(labels == y) for y in np.unique(labels))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            at = np.concatenate([g[np.minimum(np.searchsorted(w, rng.random(-(-batch // len(groups))) * w[-1]), len(g) - 1)] for g, w in groups])
            now, g = self.gradients(windows[at], labels[at], _mask(owned[at]))
            loss = now if step == 1 else 0.95 * loss + 0.05 * now
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return loss

    def documents(self, texts: list[str]) -> np.ndarray:
        """Mean distribution over all positions of each text; zeros where there is none."""
        x, owner, owned = windows_of(texts)
        out = np.zeros((len(texts), len(self.p["ob"])))
        for a in range(0, len(x), LANES):
            part = slice(a, a + LANES)
            sums = np.einsum("tbl,tb->bl", self.probabilities(x[part]), _mask(owned[part]))
            np.add.at(out, owner[part], sums)
        n = out.sum(axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 250, hidden: int = 16, steps: int = 300) -> tuple[list[str], BiGru]:
    """Fit on the text and language of rows whose id's crc32 mod 5 is not 0; returns the languages and the network.

    The sample is bounded in rows: about rows_per_language documents of each language, chosen by a hash of the id;
    every window of them can be drawn, and all documents of a language weigh alike. Rows with a null id, text or language and empty texts teach nothing; repeated
    rows count as often as they stand; without any labelled row (an empty table) no language is known.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.where((common.crc_mod5(F.col("doc_id")) != 0) & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], BiGru(0, hidden)
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, rows_per_language / n))) for x, n in counts.items()])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = rows.where(F.col("text").isNotNull() & (draw < share)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows_per_language * len(langs))
    parts = [(*windows_of([r.text]), langs.index(r.lang)) for r in sample.toLocalIterator()]
    model = BiGru(len(langs), hidden)
    if any(len(x) for x, *_ in parts):
        labels, documents = (np.concatenate([np.full(len(x), v) for v, (x, *_) in zip(values, parts, strict=True)]) for values in ([y for *_, y in parts], range(len(parts))))
        model.fit(np.concatenate([x for x, *_ in parts]), np.concatenate([o for _, _, o, _ in parts]), labels, documents=documents, steps=steps)
    return langs, model


def _predict(names: list[str], net: BiGru, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text; `und` and 0 where it has no letter or nothing was learned."""
    ok = [bool(names) and has_letter(t) for t in texts]
    if not any(ok):
        return ["und"] * len(texts), [0.0] * len(texts)
    q = net.documents([t if good else "" for t, good in zip(texts, ok, strict=True)])
    best = q.argmax(axis=1)
    return [names[best[i]] if good else "und" for i, good in enumerate(ok)], [min(1.0, float(q[i, best[i]])) if good else 0.0 for i, good in enumerate(ok)]


def identify(docs: DataFrame, langs: list[str], model: BiGru, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    lang_pred is the language of the highest mean probability (ties to the first by name), `und` with score 0 where
    the text is null or has no letter (an empty one has none) or nothing was learned. A long text is read whole, in
    windows. Repeated rows stay; other columns are ignored, whatever their names; a null id is not held out; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def run(batches):
        tokens.release()
        names, net = shared.value
        for batch in batches:
            for a, b, texts in tokens.slices(batch.column(1), 2_000_000):
                lang, score = _predict(names, net, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    key = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(common.crc_mod5(key) == 0, F.lit(False)).alias("held_out"))
    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, langs: list[str], model: BiGru, *, text_col: str = "text", wanted: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows of docs, with all their columns, whose predicted language is wanted (None: any that was learned) and
    whose score is min_score or more.

    Null, empty and letterless texts go. Where nothing was learned no language can be told, so that no text with a
    letter is rejected. Each row is decided for itself, repeated ones alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    at = docs.columns.index(text_col)

    def run(batches):
        tokens.release()
        names, net = shared.value
        for batch in batches:
            for a, b, texts in tokens.slices(batch.column(at), 2_000_000):
                if names:
                    lang, score = _predict(names, net, texts)
                    keep = [x != "und" and q >= min_score and (wanted is None or x in wanted) for x, q in zip(lang, score, strict=True)]
                else:
                    keep = [has_letter(t) for t in texts]
                yield batch.slice(a, b - a).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents; see identify() for nulls, empty and long texts and repeated rows."""
    docs = common.read_table(spark, sf_dir, "documents")
    langs, model = train(docs)
    return identify(docs, langs, model)
