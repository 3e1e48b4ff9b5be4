"""The pipeline: its stages' contract, each stage's decisions, and its shards against the stages done by hand."""

import os

import pytest

import corpus_pipeline
from foliospark.llm import dart_minhash, decontaminate, language_id, pfair_mix, sstable
from foliospark.llm import registry


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], sf).cache())
        assert seen[-1].columns == columns, name
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    rejected = {r.doc_id for r in language_id.identify(docs).where("not lang_keep").collect()}
    assert ids[1] == ids[0] - rejected
    gone = {r.doc_id for r in dart_minhash.near_duplicates(seen[1]).collect()}
    assert gone and ids[2] == ids[1] - gone
    assert decontaminate.decontaminate(seen[2], items).where("n_removed > 0").count() > 0
    assert decontaminate.decontaminate(seen[3], items).where("n_removed > 0").count() == 0
    assert ids[4] == ids[3] and seen[4].count() == pfair_mix.mix(seen[3]).count() > seen[3].count()
    want = sorted((r.doc_id, r.lang, r.source, r.text) for r in seen[4].collect())
    in_order = [(r.doc_id, r.source) for r in pfair_mix.stage(seen[3]).collect()]
    shards = corpus_pipeline.run(spark, sf).collect()
    import tiktoken

    from foliospark.llm import bpe

    ranks = bpe.loaded(bpe.default_vocabulary())[0]
    decode = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).decode
    entries = [(i, m, decode(t)) for s in shards for i, m, t in sstable.SSTable(s.sst).scan()]
    assert sorted((i, *m[:2], t) for i, m, t in entries) == want
    # The mix can be read again from the shards: its order is in the entries.
    assert [(i, m[1]) for i, m, _ in sorted(entries, key=lambda e: int(e[1][2]))] == in_order and len({m[2] for _, m, _ in entries}) == len(entries)


def test_the_pipeline_over_rough_and_empty_tables(spark, rough, none, tmp_path):
    from foliospark.llm import common

    for name, docs in (("rough", rough), ("none", none)):
        sf = str(tmp_path / name)
        plain = docs.toDF("doc_id", "text", "lang", "source", "n_chars", *(f"x{i}" for i in range(4)))
        plain.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, None), (2, ""), (3, "plain text about")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
        kept = [i for s in corpus_pipeline.run(spark, sf).collect() for i, _, _ in sstable.SSTable(s.sst).scan()]
        assert set(kept) == ({1, 5, 6, 7, None} if name == "rough" else set()), kept
    assert corpus_pipeline.in_file_order(rough.drop("Text")).where("place is not null").count() == 0
    common.release(spark)
    assert not common._made[0]


def test_what_stages_write_is_removed(spark):
    import os

    from foliospark.llm import common

    common.release(spark)
    where = common.shared_dir(spark)
    before = set(os.listdir(where))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(set(os.listdir(where)) - before) == 1 and out.count() > 0
    common.release(spark)
    assert set(os.listdir(where)) == before


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace as N

    from foliospark.llm import common

    none = N(isDefined=lambda: False)

    def session(master, folder=None):
        return N(sparkContext=N(getConf=lambda: N(get=lambda _: folder), master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none))), conf=N(get=lambda *_: None))

    assert common.shared_dir(session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
    assert os.path.isdir(common.shared_dir(session("local[4]")))
