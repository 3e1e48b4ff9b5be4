"""The conditional random field against sums over all labellings, and against held-out labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import line_crf as C


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(3)
    x, text, _ = C.line_features(pa.array(["Good line.\nBAD!! LINE!!\nabc | def |", "one", None, "a\n\nb\nb\nb 1\nx$$$"], pa.string()))
    own = C.Crf(np.zeros(x.shape[1]), np.ones(x.shape[1]), rng.normal(size=x.shape[1] + 1), rng.normal(size=(2, 2)))
    p, e = own.marginals(x, text), own.scores(x)
    for t in np.unique(text):
        at = np.flatnonzero(text == t)
        total, good = 0.0, np.zeros(at.size)
        for y in itertools.product((0, 1), repeat=at.size):
            s = np.exp(sum(e[i] * v for i, v in zip(at, y, strict=True)) + sum(own.a[a, b] for a, b in itertools.pairwise(y)))
            total, good = total + s, good + s * np.array(y)
        assert np.allclose(good / total, p[at])


def test_gradient_is_the_likelihoods():
    rng = np.random.default_rng(4)
    z, y, text = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float), np.array([0, 0, 0, 1, 1, 1, 2])
    link = np.flatnonzero(np.append(False, text[1:] == text[:-1]))

    def likelihood(w, a):
        out = 0.0
        for t in range(3):
            at = np.flatnonzero(text == t)
            e = w[0] + z[at] @ w[1:]
            s = lambda v: sum(e * v) + sum(a[int(p), int(q)] for p, q in itertools.pairwise(v))
            out += s(y[at]) - np.log(sum(np.exp(s(np.array(v))) for v in itertools.product((0, 1), repeat=at.size)))
        return out

    w, a = rng.normal(size=4), rng.normal(size=(2, 2))
    gw, ga = C._gradient(w, a, z, y, C.Layout(text), link, True)
    for i in range(4):
        d = np.zeros(4)
        d[i] = 1e-6
        assert abs((likelihood(w + d, a) - likelihood(w - d, a)) / 2e-6 - gw[i]) < 1e-4
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-6
        assert abs((likelihood(w, a + d) - likelihood(w, a - d)) / 2e-6 - ga[i, j]) < 1e-4


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_labels(labelled):
    docs, labels = labelled
    rows = labels.join(docs, "doc_id").orderBy("doc_id").collect()
    fit, held = rows[::2], rows[1::2]
    own = C.fit([r.text for r in fit if len(r.text) < 20_000][:1200], [r.quality for r in fit if len(r.text) < 20_000][:1200])
    _, n_bad, quality, keep, _ = C.score_batch(pa.array([r.text for r in held]), own, C.THRESHOLD)
    keep, good = np.array(keep.to_pylist()), np.array([r.quality for r in held]) == 1
    assert (keep[good]).mean() > 0.995 and (~keep[~good]).mean() > 0.95


def test_the_sample_is_of_whole_texts_and_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (50_000 if i % 10 == 0 else 10)) for i in range(100)] + [(3, "y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, quality int")
    texts, q = C.sample(docs, labels, per_label=30)
    assert q == [0] * 30 + [1] * 30 and any(len(t) == 50_000 for t in texts)
    order = [r.doc_id for r in labels.selectExpr("doc_id").orderBy("doc_id").collect()]
    assert C.sample(docs, labels, per_label=30) == (texts, q) and len(order) == 120
    few, _ = C.sample(docs, labels, per_label=30, sample_chars=100)
    assert 0 < len(few) < 60 and sum(len(t) for t in few) <= 200
    plan = labels.groupBy("doc_id").count()._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_the_whole_table_against_one_text_at_a_time(spark):
    """Batches and layouts change nothing: each document scored alone, by plain sums over its lines."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    own = C.fit(*C.sample(docs, labels))
    got = {r.doc_id: r for r in C.query(spark, sf).collect()}
    for r in docs.collect():
        x, text, size = C.line_features(pa.array([r.text]))
        e = own.scores(x)
        f = np.zeros((len(e), 2))
        b = np.zeros((len(e), 2))
        for t in range(len(e)):
            f[t] = np.array([0, e[t]]) + (np.logaddexp(f[t - 1, 0] + own.a[0], f[t - 1, 1] + own.a[1]) if t else 0)
        for t in range(len(e) - 2, -1, -1):
            b[t] = np.logaddexp(own.a[:, 0] + b[t + 1, 0], own.a[:, 1] + e[t + 1] + b[t + 1, 1])
        p = 1 / (1 + np.exp((f + b)[:, 0] - (f + b)[:, 1]))
        if len(e):
            assert abs(got[r.doc_id].quality - (p * size).sum() / size.sum()) < 1e-6
        else:
            assert got[r.doc_id].quality is None


def test_rough_rows(spark, rough, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (2, 0), (None, 1), (3, None), (5, 1), (5, 0)], "doc_id bigint, quality int")
    got = C.classify(rough, labels, per_label=5).collect()
    assert [r.doc_id for r in got] == [1, 1, 2, 3, None, 4, 5, 6, 7]
    assert [r.quality is None for r in got] == [False, False, True, True, False, True, False, False, False]
    assert [len(r.good_lines) for r in got] == [2, 2, 0, 0, 1, 0, 1, 1, 1] and got[0] == got[1]
    assert not got[2].keep and got[0].keep and not got[8].keep
    assert C.classify(none, labels).collect() == []


def test_without_both_labels_nothing_is_bad(spark, rough):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    got = C.classify(rough, labels).collect()
    assert all(r.quality is None and r.n_bad == 0 and r.keep == (r.n_lines > 0) for r in got)
