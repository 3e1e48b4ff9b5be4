"""Mixing sources to target weights by Pfair scheduling of source blocks.

A source of weight w has its block j released at slot floor(j / w), due by slot ceil((j + 1) / w): the Pfair windows of
Baruah et al., "Proportionate Progress" (1996). One block goes into a slot; of the released ones the earliest deadline
is next (ties by the source's place), which for weights that sum to 1 meets every deadline, so after any number of
slots t each source has had w * t blocks give or take less than one. Blocks are cut from a source's running total of
characters, so this holds for characters too.

Weights are exact: the floating-point numbers as fractions over a common denominator. One task goes through the slots, a
few heap operations each, and writes the slot of every block: a row for each ``block_chars`` of the mix, a millionth of it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.llm.common import chunks, cut, inner, only, row_key, table

#: Characters of a block, and the power of a source's size that its weight follows.
BLOCK_CHARS, POWER = 1 << 20, 0.7
#: Characters and rows, about, over which one group of rows is added up.
BUCKET_CHARS, BUCKET_ROWS = 1 << 22, 1 << 16


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*(x.denominator for x in exact))
    whole = [int(x * common) for x in exact]
    least = math.gcd(*whole)
    return [x // least for x in whole]


def schedule(weights: list[int], n_slots: int) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot, by earliest deadline among the released blocks."""
    total = sum(weights)
    waiting = [(0, i, 0) for i in range(len(weights))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    for t in range(n_slots):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j))
        deadline, i, j = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline is missed")
        yield i, j
        heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))


def target_weights(sizes: dict, weights: dict | None, power: float) -> dict:
    """The given weights of the sources there are, or each source's size to the power; those of 0 are left out."""
    if weights is None:
        return {s: float(max(1, n)) ** power for s, n in sizes.items()}
    if bad := [s for s, w in weights.items() if not (w >= 0 and math.isfinite(w))]:
        raise ValueError(f"weights must be finite and not negative: {bad}")
    return {s: weights[s] for s in sizes if weights.get(s, 0) > 0}


def plan(docs: DataFrame, weights: dict | None, block_chars: int, power: float) -> tuple[DataFrame, list[int], int] | None:
    """A row a source (its number, characters, buckets, and characters that it has in the mix), the exact weights of those with
    characters, in the numbers' order, and the mix's slots. None without a source.

    The mix is as long as the source that lasts longest at its weight, which is in it once; so all others are in it whole.
    """
    spark = docs.sparkSession
    length = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    sizes = {r[0]: (r[1], r[2]) for r in only(docs, "source", "text").groupBy("source").agg(F.sum(length), F.count("*")).collect()}
    wanted = target_weights({s: n for s, (n, _) in sizes.items()}, weights, power)
    if not wanted:
        return None
    order = sorted(wanted, key=lambda s: (not sizes[s][0], str(s), s is None))
    mixed = [s for s in order if sizes[s][0]]
    exact = whole_weights([wanted[s] for s in mixed]) if mixed else []
    longest = max(((sizes[s][0], w) for s, w in zip(mixed, exact, strict=True)), key=lambda x: Fraction(*x), default=(0, 1))
    share = [max(sizes[s][0], w * longest[0] // longest[1]) for s, w in zip(mixed, exact, strict=True)] + [0] * (len(order) - len(mixed))
    slots = max(1, -(-sum(exact) * longest[0] // (longest[1] * block_chars)))
    rows = [(s, i, sizes[s][0], max(1, -(-sizes[s][0] // BUCKET_CHARS), -(-sizes[s][1] // BUCKET_ROWS)), share[i]) for i, s in enumerate(order)]
    made, _ = cut(spark.createDataFrame(rows, f"mix_source {docs.schema['source'].dataType.simpleString()}, mix_number int, n_chars bigint, n_buckets bigint, mix_chars bigint").coalesce(1))
    return made, exact, slots


def slots_table(spark: SparkSession, weights: list[int], n_slots: int) -> DataFrame:
    """mix_number, mix_block and mix_slot of every block that has a slot, made by one task and written."""

    def run(batches):
        for _ in batches:
            held: list[tuple[int, int]] = []
            done = 0
            for found in schedule(weights, n_slots):
                held.append(found)
                if len(held) == 1 << 16:
                    yield batch(held, done)
                    done, held = done + len(held), []
            yield batch(held, done)

    def batch(held: list[tuple[int, int]], done: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.int64()), pa.array(range(done, done + len(held)), pa.int64())], names=["mix_number", "mix_block", "mix_slot"])

    one = spark.range(1, numPartitions=1) if weights else spark.range(0)
    return cut(one.mapInArrow(run, "mix_number int, mix_block bigint, mix_slot bigint"))[0]


def _recoded(docs: DataFrame, text: str, kind: T.DataType, each: Callable[[bytes], bytes]) -> DataFrame:
    """docs with the text column, as bytes, recoded; null stays null."""
    schema = T.StructType([T.StructField(f.name, kind if f.name == text else f.dataType) for f in docs.schema.fields])
    at = docs.columns.index(text)

    def run(batches):
        for b in chunks(batches, at):
            columns = list(b.columns)
            made = [None if x is None else each(x) for x in columns[at].cast(pa.binary()).to_pylist()]
            columns[at] = pa.array(made, pa.binary()).cast(pa.string() if isinstance(kind, T.StringType) else pa.binary())
            yield pa.record_batch(columns, names=b.schema.names)

    return docs.mapInArrow(run, schema)


def packed(docs: DataFrame, text: str) -> DataFrame:
    """docs with compressed texts, which is how they go through the exchanges."""
    return _recoded(docs, text, T.BinaryType(), lambda x: zstandard.compress(x, 3))


def unpacked(docs: DataFrame, text: str) -> DataFrame:
    return _recoded(docs, text, T.StringType(), zstandard.decompress)


def starts(own: DataFrame, made: DataFrame, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The rows of own, texts packed, with their source's plan, their bucket, mix_length and mix_inside, the characters of
    their bucket before them; and (mix_number, n_chars, mix_chars, mix_bucket, mix_sum, mix_before) of every bucket.

    A source's rows stand in the order of buckets by the row's hash, then hash. So the characters before a bucket come from
    one aggregation with a row a bucket, and no task adds up more than a bucket and rows alike in all columns.
    """
    keyed = own.withColumn("mix_length", F.coalesce(F.length(text), F.lit(0)).cast("bigint")).withColumn("mix_key", row_key(own))
    planned = lambda df: df.join(made, F.col(source).eqNullSafe(F.col("mix_source"))).withColumn("mix_bucket", F.pmod("mix_key", F.col("n_buckets")))
    sums = planned(keyed).groupBy("mix_number", "n_chars", "mix_chars", "mix_bucket").agg(F.sum("mix_length").alias("mix_sum"))
    before = Window.partitionBy("mix_number").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets, _ = cut(sums.withColumn("mix_before", F.coalesce(F.sum("mix_sum").over(before), F.lit(0).cast("bigint"))))
    inside = Window.partitionBy("mix_number", "mix_bucket").orderBy("mix_key", text).rowsBetween(Window.unboundedPreceding, -1)
    return planned(packed(keyed, text)).withColumn("mix_inside", F.coalesce(F.sum("mix_length").over(inside), F.lit(0).cast("bigint"))), buckets


NEW = ("mix_block", "mix_epoch", "mix_slot")


def _mixed(docs: DataFrame, weights: dict | None, block_chars: int, power: float) -> tuple[DataFrame, list[str]]:
    """The mix under inner names, then NEW; and the columns' own names."""
    found = plan(docs, weights, block_chars, power)
    own, names = inner(docs, *NEW)
    if found is None:
        return own.limit(0).select("*", *(F.lit(None).cast("bigint").alias(c) for c in NEW)), names
    made, exact, n_slots = found
    text, source = (f"_{names.index(c)}" for c in ("text", "source"))
    ordered, buckets = starts(own, made, text, source)
    slots = slots_table(docs.sparkSession, exact, n_slots)
    # For each bucket and each time that it comes, the slots of the blocks that it is in. A block without a slot goes into the last one.
    times = buckets.withColumn("mix_epoch", F.explode(F.expr("sequence(0L, if(mix_chars = 0, 0L, greatest(0L, (mix_chars - 1 - mix_before) div n_chars)))")))
    first, last = ("(mix_epoch * n_chars + {}) div {}".format(x, block_chars) for x in ("mix_before", "greatest(0L, least(mix_before + mix_sum, n_chars - 1))"))
    each = times.withColumn("mix_block", F.explode(F.expr(f"sequence({first}, {last})"))).join(slots, ["mix_number", "mix_block"], "left")
    by_time = each.groupBy("mix_number", "mix_bucket", "mix_before", "mix_epoch").agg(
        F.min("mix_block").alias("at_block"), F.array_sort(F.collect_list(F.struct("mix_block", F.coalesce("mix_slot", F.when(F.col("n_chars") == 0, F.lit(0).cast("bigint")).otherwise(n_slots - 1)).alias("slot")))).alias("slots")
    )
    spans, _ = cut(by_time.groupBy("mix_number", "mix_bucket", "mix_before").agg(F.collect_list(F.struct("mix_epoch", "at_block", F.col("slots.slot").alias("slots"))).alias("mix_spans")))
    placed = (
        ordered.join(spans, ["mix_number", "mix_bucket"])
        # An empty text after a source's last character belongs to the last block.
        .withColumn("mix_from", F.expr("least(mix_before + mix_inside, greatest(n_chars - 1, 0))"))
        .withColumn("mix_span", F.explode("mix_spans"))
        .withColumn("mix_epoch", F.col("mix_span.mix_epoch"))
        .where("mix_epoch = 0 or mix_epoch * n_chars + mix_from < mix_chars")
        .withColumn("mix_block", F.expr(f"(mix_epoch * n_chars + mix_from) div {block_chars}"))
        .withColumn("mix_slot", F.expr("get(mix_span.slots, cast(mix_block - mix_span.at_block as int))"))
    )
    order = ["mix_slot", f"_{names.index('doc_id')}", "mix_epoch"]
    return unpacked(placed.select(*own.columns, *NEW).repartitionByRange(*order).sortWithinPartitions(*order), text), names


def mix(docs: DataFrame, weights: dict | None = None, block_chars: int = BLOCK_CHARS, power: float = POWER) -> DataFrame:
    """All columns of docs, then mix_block, mix_epoch and mix_slot, ordered by slot: the mix is read from top to bottom.

    ``weights`` gives the share of each source in characters; without it a source's weight is its characters to the
    ``power``, over all rows. A source's rows, ordered by a hash of the row, are one run of characters, started over as often
    as the mix needs, each time an epoch. Every ``block_chars`` of that run are a block (mix_block) and have a slot; a row
    stands in the slot of its first character. The mix is as long as lets the source that lasts longest at its weight appear
    whole; it is in the mix once, and every other source as often as its weight asks, the last time partly, but once at least.
    So no row is lost, and after any slot a source has had its weight's share of the characters give or take less than a
    block and its longest text. What is left of blocks that the last slot cuts off stands in the last slot.

    Two aggregations, with a row a source (these come to the driver) and a row a bucket of about 4 Mi characters; the table
    of slots; an exchange of the rows by bucket for the running totals, then one of the mix by ranges of slots, through both
    of which texts go compressed. Tables by source and bucket are written, so their size decides how they are joined.

    Null sources are a source of their own. A source with no or weight 0 in ``weights`` isn't part of the mix. A source without
    a character can have no share: its rows come once, in the first slot. A null text counts no characters, rows without
    identifier are rows like others, repeated rows are each kept and follow each other; a text of more than a block stays
    whole, and its source's next slots are those that it fills. Columns that have the new names are replaced. No rows, or
    no weight, give no rows.
    """
    found, names = _mixed(docs, weights, block_chars, power)
    return found.toDF(*names, *NEW)


def stage(docs: DataFrame) -> DataFrame:
    """The mix with the columns of docs: in the order of the slots, the rows of sources that start over repeated.

    Nulls, empty and long texts, repeated rows and empty tables: as in mix. Columns named like its new ones aren't kept.
    """
    found, names = _mixed(docs, None, BLOCK_CHARS, POWER)
    return found.drop(*NEW).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
