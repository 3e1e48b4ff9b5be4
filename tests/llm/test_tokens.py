"""Token counts and shards against the public encoder, and lookups against a dictionary."""

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import bpe, sstable, token_counts
from foliospark.llm import kernels as K

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXTS = st.text(alphabet=st.sampled_from(list(" \n\t'abcdeREstlvmzé日12½-! ́\U0001f600")), max_size=40)


@pytest.fixture(scope="session")
def encoder():
    import tiktoken

    ranks, whole = bpe.loaded(bpe.default_vocabulary())
    return bpe.Bpe(ranks, whole), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_pre_tokens_are_those_of_the_pattern(texts):
    _, buf, offsets = K.texts_of(pa.array(texts, pa.string()))
    ends = K.pre_tokens(buf, offsets)
    own = [bytes(buf[a:b]).decode() for a, b in zip(np.append(0, ends)[:-1], ends, strict=True)]
    assert own == [m[0] for t in texts for m in regex.finditer(PATTERN, t)]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_ids_are_the_encoders(encoder, texts):
    own, public = encoder
    ids, cut = own.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)] == [public.encode_ordinary(t) for t in texts]


def test_whole_strings_are_proved(encoder):
    own, public = encoder
    for i in range(0, len(own.whole), 97):
        assert public.encode_ordinary(own.whole[i].as_py().decode()) == [own.whole_ids[i]]


def test_counts_of_rough_rows(spark, rough, none, encoder):
    got = token_counts.token_counts(rough).collect()
    assert [r.n_tokens for r in got] == [len(encoder[1].encode_ordinary(r[1] or "")) for r in rough.collect()]
    assert [r.doc_id for r in got] == [1, 1, 2, 3, None, 4, 5, 6, 7]
    assert all(0 <= r.n_whole <= r.n_pre_tokens <= r.n_tokens for r in got)
    assert token_counts.token_counts(none).collect() == []


def test_shards_answer_lookups(rough, none, encoder):
    shards = sstable.sstable_shards(rough, shard_bytes=1 << 12, block_bytes=64).orderBy("first_doc_id").collect()
    assert sum(r.n_docs for r in shards) == 9
    tables = [sstable.SSTable(r.sst) for r in shards]
    got = sorted(((i, m, ids) for t in tables for i, m, ids in t.scan()), key=str)
    want = sorted(((r[0], (r[2], r[3]), None if r[1] is None else encoder[1].encode_ordinary(r[1])) for r in rough.collect()), key=str)
    assert got == want
    for i in (1, 2, 3, 4, 5, 6, 7, None):
        assert sum(len(t.get(i)) for t in tables) == (2 if i == 1 else 1)
    assert all(t.get(99) == [] and t.get(-5) == [] for t in tables)
    assert sstable.sstable_shards(none).collect() == []


def test_rows_of_one_identifier_are_parted_and_found(spark, encoder):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} " * 20) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("doc_id", "text", "'x' as lang", "cast(null as string) as source")
    shards = sstable.sstable_shards(docs, shard_bytes=1 << 12).cache()
    ends = sorted((r.first_doc_id if r.first_doc_id is not None else -1, r.last_doc_id if r.last_doc_id is not None else -1) for r in shards.collect())
    assert sum(a == b == -1 for a, b in ends) > 3 and sum(a == b == 7 for a, b in ends) > 3
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    decode = lambda d: sorted(encoder[1].decode(r.token_ids) for r in d.collect())
    assert decode(sstable.entries(shards)) == sorted(t for _, t in rows)
    for ids in ([7], [None], [5, 2, 999, 5], [None, 7, 599], []):
        assert decode(sstable.lookup(shards, ids)) == sorted(t for i, t in rows if i in ids), ids
    assert sstable.lookup(shards, [5]).first().meta == ["x", None]
    with pytest.raises(ValueError):
        sstable.lookup(shards, range(sstable.MOST_IDS + 1))


def test_identifiers_may_be_strings(spark, encoder):
    rows = [(i, f"text of {i}") for i in ("", "b", "a", "ab", "é", "Z", None, "a")]
    shards = sstable.sstable_shards(spark.createDataFrame(rows, "doc_id string, text string"), meta=(), shard_bytes=20).cache()
    got = [(r.doc_id, encoder[1].decode(r.token_ids)) for r in sstable.entries(shards).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    assert sorted(r.doc_id for r in sstable.lookup(shards, ["a", "é", "none"]).collect()) == ["a", "a", "é"]
    assert [r.doc_id for r in sstable.lookup(shards, [""]).collect()] == [""] and [r.doc_id for r in sstable.lookup(shards, [None]).collect()] == [None]


def test_the_bloom_filters_rate_is_as_computed():
    w = sstable.Writer(1 << 16, 2)
    for i in range(20_000):
        w.add(sstable.key_of(i * 3), b"")
    own = sstable.SSTable(w.finish())
    assert all(own.may_have(i * 3) for i in range(20_000))
    assert sum(own.may_have(i * 3 + 1) for i in range(50_000)) < 0.011 * 50_000  # 0.82 % for 7 probes of 10 bits a key


def test_a_proof_is_kept_offline(tmp_path):
    path = bpe.default_vocabulary()
    where = str(tmp_path / "proof")
    bpe.save_proof(path, where)
    assert bpe.loaded(path, where) == bpe.loaded(path)
    other = tmp_path / "other.tiktoken"
    other.write_bytes(b"IQ== 0\n")
    with pytest.raises(ValueError):
        bpe.loaded(str(other), where)


def test_a_damaged_shard_is_refused(rough):
    data = bytearray(sstable.sstable_shards(rough).first().sst)
    data[10] ^= 1
    with pytest.raises(ValueError):
        sstable.SSTable(bytes(data))
