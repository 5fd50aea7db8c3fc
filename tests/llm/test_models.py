"""Language identification and quality scores: gradients, held-out accuracy, hostile rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from redactum.llm import language_id, quality
from tests.llm.fixtures import frame, prose, rows

DATA = "/root/testdata/sf0.01"


def test_backpropagation_through_time_gives_the_gradient():
    model = language_id.BiGru(3, 4)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    x, y = np.array([[1, 2, 3], [4, 5, 1]], np.uint8), np.array([0, 2])
    _, g = model.gradients(x, y)
    rng = np.random.default_rng(0)
    for k, p in model.p.items():
        for _ in range(4):
            at = (int(rng.choice([1, 2, 3, 4, 5])), int(rng.integers(p.shape[1]))) if k[0] == "x" else tuple(int(rng.integers(n)) for n in p.shape)
            keep = p[at]
            p[at] = keep + 1e-4
            up, _ = model.gradients(x, y)
            p[at] = keep - 1e-4
            down, _ = model.gradients(x, y)
            p[at] = keep
            assert abs((up - down) / 2e-4 - g[k][at]) < 1e-4


def test_every_position_is_labelled_once():
    texts = ["", "a", "é" * 31, "x" * 64, "one two " * 9, "ab cd\n" * 500, "日本" * 100]
    x, owner, owned = language_id.windows_of(texts)
    for i, t in enumerate(texts):
        raw = t.encode()
        mine = [(w, o) for w, o, k in zip(x, owned, owner, strict=True) if k == i]
        assert b"".join(w[a:b].tobytes() for w, (a, b) in mine) == raw  # in order, without gaps
        for n, (_, (a, b)) in enumerate(mine):
            assert (n == 0 and a == 0) or a >= language_id.CONTEXT
            assert n == len(mine) - 1 or b <= language_id.WINDOW - language_id.CONTEXT


def test_documents_are_means_over_all_positions(monkeypatch):
    model = language_id.BiGru(2, 4)
    texts = ["one twotwo three" + "x" * 70, "", "short", "a b " * 60]
    x, owner, owned = language_id.windows_of(texts)
    want, n = np.zeros((4, 2)), np.zeros(4)
    for w, i, (a, b) in zip(x, owner, owned, strict=True):
        want[i] += model.probabilities(w[None])[a:b, 0].sum(axis=0)
        n[i] += b - a
    got = model.documents(texts)
    assert got[1].sum() == 0 and n.tolist() == [len(t) for t in texts]
    assert np.allclose(got[[0, 2, 3]], want[[0, 2, 3]] / n[[0, 2, 3], None], atol=1e-5)
    monkeypatch.setattr(language_id, "LANES", 2)
    assert np.allclose(model.documents(texts), got, atol=1e-5)


def test_letters():
    assert [language_id.has_letter(t) for t in ("a", "é", "日", "ª", "1 ² ½ Ⅷ", "_ ! \u0301", "", "\U0001f600")] == [True] * 4 + [False] * 4


def test_identify(spark):
    docs = frame(spark)
    langs, model = language_id.train(docs)
    assert langs == ["en", "fr"]
    got = language_id.identify(docs, langs, model).collect()
    assert len(got) == len(rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (0, 1, 2, 4)] == ["und"] * 4
    held = [r for r in got if r.held_out and r.doc_id >= 20]
    assert held and all(by_id[r.doc_id] == ("en", "fr")[r.doc_id % 2] for r in held)
    plain = Counter((r.doc_id, *language_id._predict(langs, model, [r.text or ""])[0]) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.lang_pred) for r in got) == plain
    kept = language_id.keep_identified(docs, langs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in got)
    french = language_id.keep_identified(docs, langs, model, wanted=["fr"], min_score=0.6)
    assert Counter(r.doc_id for r in french.collect()) == Counter(r.doc_id for r in got if r.lang_pred == "fr" and r.score >= 0.6) and 0 < french.count() < kept.count()
    untaught = language_id.keep_identified(docs, *language_id.train(docs.limit(0)))  # nothing learned rejects no letters
    assert untaught.count() == sum(language_id.has_letter(r[1] or "") for r in rows())
    empty = frame(spark, [])
    assert language_id.identify(empty, *language_id.train(empty)).count() == 0
    nothing = language_id.identify(docs, *language_id.train(empty)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(got)


def test_training_sees_all_windows_of_its_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id.BiGru, "fit", lambda self, windows, owned, labels, **_: seen.append((windows, labels)))
    texts = ["".join(chr(0x4E00 + (i * 37 + k) % 900) for k in range(200)) for i in range(40)] + ["kurz und " + "x" * 70, "", None]
    docs = frame(spark, [(i, t, "zh", "s", 1, *["x"] * 7) for i, t in enumerate(texts)])
    language_id.train(docs)
    want = Counter(w.tobytes() for w in language_id.windows_of([t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5])[0])
    windows, labels = seen[0]
    assert Counter(w.tobytes() for w in windows) == want and len(labels) == len(windows)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.identify(docs, *language_id.train(docs)).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.97


def test_interactions_in_linear_time_equal_all_pairs():
    fm = quality.FactorisationMachine(rank=3)
    rng = np.random.default_rng(1)
    fm.w[:] = rng.standard_normal(quality.SIZE)
    at, x = rng.choice(quality.SIZE, 12, replace=False), rng.standard_normal(12)
    want = fm.w[at] @ x + sum(fm.v[at[i]] @ fm.v[at[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    got, _ = fm.margins(np.concatenate([at, at[:1]]), np.concatenate([x, x[:1]]), np.array([0, 12]))
    assert np.isclose(got[0], want)


def test_score_of_a_text_by_all_pairs():
    fm = quality.FactorisationMachine(rank=2)
    rng = np.random.default_rng(3)
    fm.w[:], fm.v[:] = rng.standard_normal(quality.SIZE) * 0.1, rng.standard_normal(fm.v.shape) * 0.1
    for text in ("", "one word and one more word", prose("fr", 40), prose("en", 3000)):
        at, value = fm.place(*quality.raw_features(text))
        x: dict = {}
        for a, v in zip(at.tolist(), value.tolist(), strict=True):
            x[a] = x.get(a, 0) + v
        keys = sorted(x)
        margin = fm.w0[0] + sum(fm.w[a] * x[a] for a in keys) + sum(fm.v[a] @ fm.v[b] * x[a] * x[b] for i, a in enumerate(keys) for b in keys[:i])
        assert np.isclose(fm.scores([text, "other text"])[0], 1 / (1 + np.exp(-margin)))


def test_training_does_not_depend_on_the_order_of_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20, 90)] + [(5, 1), (8, 0)], "doc_id long, quality int")
    a, b = quality.train(docs, labels, sample_rows=40), quality.train(docs.repartition(3), labels.repartition(2), sample_rows=40)
    assert np.array_equal(a.v, b.v) and np.array_equal(a.w, b.w)


def test_compression_reads_the_whole_text():
    text = prose("en", 40_000)
    for n in (0, 1, 8191, 8192, 120_000, len(text)):
        got = quality.raw_features(text[:n])[2][quality.STATISTICS.index("compressed")]
        assert got == len(zlib.compress(text[:n].encode(), 1)) / max(1, n)


def test_quality_hostile_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(20, 90)] + [(None, 1, 0, "x"), (21, None, None, None), (21, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = quality.score(docs, quality.train(docs, labels.limit(0))).collect()
    assert {r.score for r in none if r.doc_id == 0} and len(none) == len(got)
    assert quality.score(frame(spark, []), quality.FactorisationMachine()).count() == 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_quality_held_out_accuracy(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.score(docs, quality.train(docs, labels)).collect() if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in got) / len(got)
    bad = [r for r in got if truth[r.doc_id] == 0]
    assert right > 0.95 and sum(r.predicted == 0 for r in bad) / len(bad) > 0.8


def test_prose_is_two_languages():
    assert prose("en", 5) != prose("fr", 5)
