"""The corpus pipeline: five stages of the llm operators over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import dart_minhash, decontaminate, language_id, pfair_mix
from foliospark.llm.common import cut, remove, scratch, table
from foliospark.llm.sstable import sstable_shards


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language stands; lang becomes the language found.

    Null, empty and blank texts and ties are rejected and go; without any label, all. Repeated rows are judged alike, long texts
    whole; no rows give no rows; extra columns are kept, but those named like the operator's new ones.
    """
    return language_id.stage(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least identifier.

    Rows without an identifier, a text or a word all stay; an identifier's other texts stay; of rows that repeat an identifier
    and a text one stays. Long texts count whole; no rows give no rows; extra columns are kept.
    """
    return dart_minhash.stage(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with the benchmark; those of which no word is left go.

    Null, empty and wordless texts stay as they are; repeated rows are treated alike, long texts whole; no benchmark removes nothing, no
    rows give no rows; extra columns are kept, but those named like the operator's new ones.
    """
    return decontaminate.stage(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources interleaved by their target weights; small ones come again.

    A null source is one like others; null and empty texts count no characters and stay; repeated rows are each kept and long
    texts whole; no rows give no rows; extra columns are kept, but those named like the operator's new ones.
    """
    return pfair_mix.stage(docs)


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs, which are files that the stage before wrote in its order, with ``place``: a number that grows with that order.

    It has the file's number and the row's in the file. Where docs aren't files, place is null.
    """
    place = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint") * (1 << 40) + F.col("_metadata.row_index")
    clash = [c for c in docs.columns if c.lower() in ("place", "_metadata")]
    if not clash and docs.inputFiles():
        return docs.select("*", place.alias("place"))
    kept = docs.drop(*clash) if clash else docs
    return kept.withColumn("place", F.lit(None).cast("bigint"))


def binary_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids; beside language and source, an entry has its place in the mix.

    Null texts are stored as null, rows without identifier under the empty key; repeated rows are each kept, long texts whole; no rows give
    no shards; extra columns are left out.
    """
    return sstable_shards(in_file_order(docs), meta=("lang", "source", "place"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmarks),
    ("mixing sources", mix_sources),
    ("binary output", binary_output),
]

#: Compression, signatures, automata and token ids can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents. What a stage writes for itself goes when its result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scratch(spark):
            docs, path = cut(stage(spark, docs, sf_dir), keep=True)
        if before:
            remove(spark, before)
        before = path
    return docs
