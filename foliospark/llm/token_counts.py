"""Token counts of documents under a public byte-level BPE, by the whole-token shortcut (see bpe.py)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import bpe
from foliospark.llm.common import chunks, only, table


def token_counts(docs: DataFrame, ranks_path: str | None = None, proof_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pre_tokens and n_whole (pre-tokens counted by the shortcut) for every row of docs.

    The vocabulary's proof is read from ``proof_path``, which ``python -m foliospark.llm.bpe RANKS PROOF`` writes, or made once
    on the driver; ranks and proof are broadcast, and their size is the rank file's, whatever the data.
    One narrow Arrow pass, no shuffle; only doc_id and text are read. A null or empty text has 0 of each; a
    null doc_id stays null; repeated rows are counted each; no rows give no rows; other columns, whatever
    their names, are ignored; a text of any length is one unit of work and is counted whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bpe.loaded(ranks_path or bpe.default_vocabulary(), proof_path))

    def run(batches):
        own = bpe.on_worker(shared)
        for b in chunks(batches, "text"):
            tokens, pre, whole = own.counts(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(tokens), pa.array(pre), pa.array(whole)], names=["doc_id", "n_tokens", "n_pre_tokens", "n_whole"])

    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_pre_tokens bigint, n_whole bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
