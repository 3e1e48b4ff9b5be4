"""Top-k search against scoring every document."""

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import impact_search as S


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 12), st.integers(1, 12))
def test_a_shard_finds_what_a_full_scan_does(seed, n_docs, n_terms, k):
    rng = np.random.default_rng(seed)
    counts = rng.poisson(rng.gamma(0.5, 2, n_terms), (n_docs, n_terms))
    doc, term = np.nonzero(counts)
    lengths = counts.sum(1) + rng.integers(0, 50, n_docs)
    ids = rng.permutation(n_docs) * 3
    idf = rng.random(n_terms) + 0.01
    average = max(1.0, float(lengths.mean()))
    index = S.Index(ids, lengths, doc, term, counts[doc, term], idf, average, float(idf.max()) * (S.K1 + 1) / S.LEVELS)
    terms = np.unique(rng.integers(0, n_terms, 5))
    times = rng.integers(1, 4, terms.size)
    weight = idf * (counts * (S.K1 + 1) / (counts + (S.K1 * (1 - S.B + S.B * lengths / average))[:, None]))
    score = np.round(weight[:, terms] @ times, 6)
    want = sorted(((-s, i) for s, i in zip(score, ids, strict=True) if s > 0))[:k]
    places, got = index.search(terms, times, k)
    got_ids = ids[places]
    assert np.allclose([-s for s, _ in want], got, atol=2e-6)
    if len({s for s, _ in want}) == len(want):
        assert got_ids.tolist() == [i for _, i in want]
    assert (index.acc.size, index.wanted.any()) == (n_docs, False)


def test_rare_terms_stop_before_all_segments():
    n = 200_000
    rng = np.random.default_rng(1)
    common = np.arange(n)
    rare = np.sort(rng.choice(n, 40, replace=False))
    doc = np.concatenate([common, rare])
    term = np.concatenate([np.zeros(n, int), np.ones(40, int)])
    order = np.lexsort((term, doc))
    idf = np.array([0.01, 9.0])
    index = S.Index(np.arange(n), rng.integers(50, 150, n), doc[order], term[order], np.ones(n + 40, int), idf, 100.0, 9.0 * 2.2 / S.LEVELS)
    got, _ = index.search(np.array([0, 1]), np.array([1, 1]), 10)
    assert set(got) <= set(rare) and index.processed < n / 2


def test_shards_keep_all_documents(monkeypatch, spark):
    monkeypatch.setattr(S, "SHARD_POSTINGS", 3)
    batches = S.postings(spark.createDataFrame([(i, "a b c d"[: i % 8]) for i in range(30)], "doc_id bigint, text string"), S.Queries(["a b c d"]).words).toArrow().to_batches()
    cut = list(S.shards(batches))
    assert sum(b.num_rows for held in cut for b in held) == 30 and len(cut) > 5


def test_rough_rows(spark, rough, none):
    queries = spark.createDataFrame([(1, "sea wind"), (1, "sea wind"), (2, None), (3, ""), (4, "unheard"), (None, "identifier"), (5, "lazy")], "item_id bigint, text string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in S.search(rough, queries).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1), (1, 2, 1), (5, 1, 5)], key=str)
    assert S.search(none, queries).collect() == [] and S.search(rough, queries.limit(0)).collect() == []


def test_ties_go_by_identifier(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (9, 4, 7, 1)] + [(2, "other")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "words")], "item_id bigint, text string")
    assert [r.doc_id for r in S.search(docs, queries, k=3).orderBy("rank").collect()] == [1, 4, 7]


def test_whole_table_equals_the_sql(spark):
    for t in ("documents", "benchmark"):
        duckdb.execute(f"create or replace view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    want = sorted(duckdb.execute(S.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in S.query(spark, "/root/testdata/sf0.01").collect()) == want


def test_blocks_of_queries_find_what_one_does(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    one = sorted(tuple(r) for r in S.query(spark, sf).collect())
    monkeypatch.setattr(S, "BLOCK_CHARS", 3000)
    assert len(list(S.blocks(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", 3000))) > 2
    assert sorted(tuple(r) for r in S.query(spark, sf).collect()) == one


def test_identifiers_may_be_strings(spark):
    docs = spark.createDataFrame([(f"d{i}", "same words here") for i in (9, 4, 10, 1)] + [("z", "other"), (None, "words"), ("é", None)], "doc_id string, text string")
    queries = spark.createDataFrame([("q", "words")], "item_id string, text string")
    assert [(r.item_id, r.doc_id) for r in S.search(docs, queries, k=3).orderBy("rank").collect()] == [("q", "d1"), ("q", "d10"), ("q", "d4")]
