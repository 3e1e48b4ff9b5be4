"""DartMinHash: signatures against weighted Jaccard similarity, groups against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import dart_minhash as M


def test_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    n, k = 40, 1024
    a = rng.integers(0, 6, (n, 60)).astype(float)
    b = np.where(rng.random((n, 60)) < rng.random((n, 1)), a, rng.integers(0, 6, (n, 60)))
    element = rng.integers(0, 1 << 63, 60).astype(np.uint64)

    def sign(w):
        own, at = np.nonzero(w)
        return M.signatures(own, element[at], w[own, at], n, k)

    same = (sign(a) == sign(b)).mean(1)
    jaccard = np.minimum(a, b).sum(1) / np.maximum(a, b).sum(1)
    assert np.abs(same - jaccard).max() < 0.08 and abs((same - jaccard).mean()) < 0.015


def test_signatures_dont_depend_on_the_batch():
    rng = np.random.default_rng(6)
    w = rng.integers(0, 4, (9, 30)).astype(float)
    element = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    own, at = np.nonzero(w)
    whole = M.signatures(own, element[at], w[own, at], 9)
    for i in range(9):
        at = np.flatnonzero(w[i])
        if at.size:
            assert (M.signatures(np.zeros(at.size, int), element[at], w[i, at], 1)[0] == whole[i]).all()


def test_shingles_count_word_pairs():
    own, h, n = M.shingles(pa.array(["a b a b", "A B", "a", "", None], pa.string()))
    assert np.bincount(own, n, 5).tolist() == [3, 1, 1, 0, 0]
    assert h[own == 1][0] in h[own == 0] and n[own == 0].max() == 2


@pytest.fixture(scope="module")
def planted(spark):
    """Texts of 120 words, with copies of which so many words are changed."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, groups = [], {}
    for g in range(30):
        base = rng.choice(vocabulary, 120)
        for j in range(1 + g % 5):
            copy = base.copy()
            copy[rng.choice(120, j, replace=False)] = "changed"
            rows.append((g * 100 + j, " ".join(copy)))
            groups[g * 100 + j] = g * 100
    return spark.createDataFrame(rows, "doc_id bigint, text string"), groups


def test_groups_are_the_planted_ones(planted):
    docs, groups = planted
    got = {r.doc_id: r.kept_doc_id for r in M.near_duplicates(docs).collect()}
    assert got == {d: g for d, g in groups.items() if d != g}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a bigint, b bigint")
    got = {r.node: r.root for r in M.components(edges)[0].collect()}
    assert got == {i: 0 for i in range(1, 61)} | {150: 100, 200: 100}


def test_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    own, h, n = M.shingles(pa.array([r.text for r in docs]))
    bags = [dict(zip(h[own == i].tolist(), n[own == i].tolist(), strict=True)) for i in range(len(docs))]
    pairs = set()
    for i in range(len(docs)):
        for j in range(i):
            if len(bags[i].keys() & bags[j].keys()) > 2:
                keys = bags[i].keys() | bags[j].keys()
                low = sum(min(bags[i].get(x, 0), bags[j].get(x, 0)) for x in keys)
                if low / sum(max(bags[i].get(x, 0), bags[j].get(x, 0)) for x in keys) >= 0.7:
                    pairs.add((docs[i].doc_id, docs[j].doc_id))
    root = {r.doc_id: r.kept_doc_id for r in M.query(spark, "/root/testdata/sf0.001").collect()}
    found = sum(root.get(a, a) == root.get(b, b) for a, b in pairs)
    assert pairs and found >= 0.9 * len(pairs)


def brute(texts, threshold=M.THRESHOLD):
    """The components of all pairs whose signatures agree, among those that share a band."""
    b = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text_key", "text"])
    out = M.sign_batch(b, M.COORDINATES, M.BANDS)
    sig = np.frombuffer(b"".join(out.column("sig").to_pylist()), "<u2").reshape(len(texts), -1)
    bands = np.array(out.column("bands").to_pylist())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = 0
    for i in range(len(texts)):
        near = np.flatnonzero((bands[:i] == bands[i]).any(1))
        shared += near.size
        for j in near[(sig[near] == sig[i]).mean(1) >= threshold].tolist():
            a, z = sorted((find(i), find(j)))
            root[z] = a
    return {i: find(i) for i in range(len(texts)) if find(i) != i}, shared


def unlike(n, seed, share=40):
    """Texts of which each has one passage in common with all others and words of its own; every hundredth is like another one."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(share)]
    out = []
    for i in range(n):
        own = [f"w{x}" for x in rng.integers(0, 1 << 40, 60)]
        out.append(" ".join(passage + own))
        if i % 100 == 99:
            out[-1] = out[-50].rsplit(" ", 3)[0] + " changed"
    return out


def test_every_pair_that_shares_a_bucket_is_compared_or_in_one_group(spark):
    texts = unlike(2500, 8)
    want, shared = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.kept_doc_id for r in M.near_duplicates(docs).collect()}
    assert shared > 300_000 and 20 < len(want) < 60  # the buckets' pairs are many, those that are alike are few
    assert got.items() >= want.items()
    extra = {a: b for a, b in got.items() if want.get(a) != b}
    assert len(extra) <= 2  # pairs that share no band may be found besides


def test_a_bucket_of_unlike_texts_is_linear(spark, monkeypatch):
    seen = []
    plain = M._rest
    monkeypatch.setattr(M, "_rest", lambda *a: seen.append(plain(*a).count()) or plain(*a))
    texts = unlike(20_000, 9)
    got = M.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)).collect()
    assert 195 <= len(got) <= 210 and seen and seen[0] < 20_000  # of 200 million pairs


def test_the_stage_keeps_texts_that_have_no_copy(spark):
    a, u = "one text of several words that has a copy", "another text which none else has at all"
    rows = [(3, a, 1), (5, a, 2), (5, u, 3), (6, u + " x y z w v q r s t more words of its own", 4), (7, None, 5), (7, None, 5), (None, a, 6), (8, u, 7), (8, u, 8), (5, u, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = sorted((tuple(r) for r in M.stage(docs).collect()), key=str)
    assert got == sorted([(3, a, 1), (5, u, 3), rows[3], (7, None, 5), (7, None, 5), (None, a, 6)], key=str)
    text = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert sorted((tuple(r) for r in M.stage(text).collect()), key=str) == sorted([("3", a, 1), ("5", u, 3), ("6", *rows[3][1:]), ("7", None, 5), ("7", None, 5), (None, a, 6)], key=str)


def test_recall_at_the_threshold_itself(spark):
    """All pairs of texts of 150 words and a copy with 0 to 18 % of the words changed, against exact weighted Jaccard similarity."""
    rng = np.random.default_rng(11)
    rows, pairs = [], []
    for i in range(900):
        base = [f"w{x}" for x in rng.integers(0, 1 << 30, 150)]
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(0, 28)), replace=False):
            copy[at] = f"x{rng.integers(0, 1 << 30)}"
        a, b = ({(p, q): 1 for p, q in zip(x, x[1:])} for x in (base, copy))
        pairs.append((2 * i, 2 * i + 1, len(a.keys() & b.keys()) / len(a.keys() | b.keys())))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    root = {r.doc_id: r.kept_doc_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = [(j, root.get(b) == a) for a, b, j in pairs]
    above = [f for j, f in found if j >= M.THRESHOLD]
    assert len(above) > 700 and np.mean(above) > 0.9
    assert np.mean([f for j, f in found if j >= 0.6]) > 0.97 and not any(f for j, f in found if j < 0.33)


def test_rough_rows(rough, none):
    assert M.near_duplicates(rough).collect() == [] and M.near_duplicates(none).collect() == []
    kept = M.stage(rough)
    assert kept.columns == rough.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 6, 7, None]
    assert M.stage(none).collect() == []
