"""What the operators of this subpackage share: tables, lineage cuts, schemas and Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that one vectorised step takes at a time; it bounds a Python worker's memory, not what is processed.
CHUNK_BYTES = (2 << 20) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or what setCheckpointDir() named.

    Where neither is set, a local session, whose tasks all run on this machine, gets a temporary folder; on a cluster,
    where such a folder would be another one on each machine, this is an error.
    """
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found
    if (named := sc._jsc.sc().getCheckpointDir()).isDefined():
        return named.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError(f"spark.checkpoint.dir isn't set, and on {sc.master} there is no other folder that all executors share")
    kept = getattr(sc, "_foliospark_dir", None)
    if kept is None:
        kept = sc._foliospark_dir = tempfile.mkdtemp(prefix="foliospark-")
    return kept


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that cut() wrote; a session that has ended leaves nothing to do."""
    for made in _made:
        if path in made:
            made.remove(path)
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Folders that cut() wrote and nothing has removed: those of the session, then those of each scratch() within the one before.
_made: list[list[str]] = [[]]


def release(spark: SparkSession) -> None:
    """Removes what operators have written to the shared folder so far, for a long session whose results have been written."""
    for path in list(_made[0]):
        remove(spark, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes at its end what is cut within: for a result that has been written by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in list(_made[-1]):
            remove(spark, path)
        _made.pop()


def cut(df: DataFrame, keep: bool = False) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it again, which cuts its lineage and survives lost executors.

    Also gives the folder, for remove(). What is left goes at the end of the scratch() around it (unless ``keep``), with
    release(), or when the session's process ends.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if not any(_made):
        atexit.unregister(release)
        atexit.register(release, spark)
    _made[0 if keep else -1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def row_key(df: DataFrame) -> Column:
    """A hash of the whole row, of all that can be hashed."""
    return F.xxhash64(*(f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, (T.VariantType, T.NullType))))


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    """The type that identifiers are kept as: bigint for whole numbers, else string."""
    return "bigint" if isinstance(only(df, name).schema[0].dataType, T.IntegralType) else "string"


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns in the exact spelling, each once, whatever clashing names df has beside them."""
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    if missing := [n for n in names if n not in at]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    inner = [f"_{i}" for i in range(len(df.columns))]
    flat = df.toDF(*inner)
    return flat.select(*(F.col(inner[at[n]]).alias(n) for n in names))


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``most`` bytes, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def inner(docs: DataFrame, *without: str) -> tuple[DataFrame, list[str]]:
    """docs under the names _0, _1, ..., which nothing clashes with, and their own names; ``without`` leaves out columns of these names in any case."""
    docs = only(docs, *dict.fromkeys(c for c in docs.columns if c.lower() not in without))
    return docs.toDF(*(f"_{i}" for i in range(len(docs.columns)))), docs.columns


def offsets_array(cuts: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of the values between consecutive cuts."""
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
