"""Near-duplicate groups by DartMinHash signatures, banded joining and connected components.

A text's word pairs, weighted by how often they occur, are sampled as DartMinHash does (Christiani, "DartMinHash:
Fast Sketching for Weighted Sets", 2020): each element owns a quadrant of weight by rank into which darts are
thrown by hashing, area by area, as a Poisson process of intensity 1. A set of total weight W sees the darts below
its elements' weights with rank up to t / W, about t = k ln k + 2k of them; each dart falls on one of the k
coordinates, and a coordinate keeps its earliest, that is its least rank. Two sets keep the same dart with their
weighted Jaccard similarity as the probability. Ranks go up twofold for sets that left a coordinate empty.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm import kernels as K
from foliospark.llm.common import chunks, cut, id_type, inner, only, remove, row_key, table

#: Coordinates, bands of ROWS coordinates, and the estimated similarity from which two texts are near duplicates.
COORDINATES, BANDS, ROWS, THRESHOLD = 128, 48, 4, 0.5
#: Width of the first area on the rank axis; later ones double.
FIRST_RANK = 1 / 16
_U = np.uint64


@functools.lru_cache(64)
def poisson_cdf(exponent: int) -> np.ndarray:
    """P(X <= i) for a Poisson number of mean FIRST_RANK * 2**exponent, as far as doubles tell it from 1."""
    mean = FIRST_RANK * 2.0**exponent
    most = int(mean + 12 * math.sqrt(mean) + 24)
    logs = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(most)]
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def _unit(h: np.ndarray) -> np.ndarray:
    """[0, 1) from the top 53 bits."""
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def _throw(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, sig: np.ndarray, k: int) -> None:
    """Lowers sig[owner * k + coordinate] to the ranks of the darts of each element up to its owner's limit."""
    low, area_w = 0.0, 0
    heaviest = float(weight.max(initial=0))
    while low < heaviest:  # weight areas [2**v - 1, 2**(v + 1) - 1)
        on_w = weight > low
        own, el, w, lim = (x[on_w] for x in (owner, element, weight, limit)) if not on_w.all() else (owner, element, weight, limit)
        furthest, rank_low, area_r = float(lim.max(initial=0)), 0.0, 0
        while rank_low < furthest:  # rank areas [0, f), [f, 2f), [2f, 4f), ...
            on_r = lim > rank_low
            if not on_r.all():
                own, el, w, lim = (x[on_r] for x in (own, el, w, lim))
            width = FIRST_RANK * 2.0 ** max(0, area_r - 1)
            seed = K.mix(el ^ _U(((area_w << 8 | area_r) * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & (1 << 64) - 1))
            n = np.searchsorted(poisson_cdf(area_w + max(0, area_r - 1)), _unit(seed), "right")
            some = np.flatnonzero(n)
            if some.size:
                count = n[some]
                each = np.repeat(some, count)
                j = np.arange(each.size, dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)
                dart = K.mix(seed[each] + (j.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
                more = K.mix(dart ^ _U(0xA0761D6478BD642F))
                rank = rank_low + _unit(dart) * width
                hit = rank <= lim[each]
                top = low + (more >> _U(32)).astype(np.float64) * 2.0**-32 * 2.0**area_w
                hit &= top < w[each]
                each = each[hit]
                np.minimum.at(sig, own[each] * k + ((more[hit] & _U(0xFFFFFFFF)) * _U(k) >> _U(32)).astype(np.int64), rank[hit])
            rank_low, area_r = rank_low + width, area_r + 1
        low, area_w = low * 2 + 1, area_w + 1


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """(n, k) least ranks of weighted sets given as (set, element hash, weight > 0) rows; sets without rows keep infinity."""
    sig = np.full(n * k, np.inf)
    total = np.bincount(owner, weight, n)
    most = (k * math.log(k) + 2 * k) / np.where(total > 0, total, 1)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        own = owner[mine]
        _throw(own, element[mine], weight[mine], most[own], sig, k)
        todo &= np.isinf(sig.reshape(n, k)).any(1)
        most *= 2
    return sig.reshape(n, k)


def shingles(column: pa.Array, size: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, occurrences) of the runs of ``size`` words of each text, lower-cased; a shorter text is one run."""
    column, buf, offsets = K.texts_of(column)
    low = K.texts_of(K.lower(column))[1]
    start, end, owner = K.words(K.classes(buf), offsets, buf)
    h = K.span_hashes(low, start, end)
    count = np.bincount(owner, minlength=len(column))
    left = np.repeat(np.cumsum(count), count) - np.arange(h.size)  # words from this one to its text's end
    out = h
    for i in range(1, size):
        nxt = np.zeros_like(h)
        nxt[: max(0, h.size - i)] = h[i:]
        out = K.mix(out * _U(0x9E3779B97F4A7C15) + np.where(left > i, nxt, _U(0)))
    whole = (left >= size) | ((count[owner] < size) & (left == count[owner]))
    owner, out = owner[whole], out[whole]
    keys = np.sort(owner.astype(_U) << _U(44) | out >> _U(20))
    first = np.ones(keys.size, bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return (keys[at] >> _U(44)).astype(np.int64), K.mix(keys[at] & _U((1 << 44) - 1)), np.diff(np.append(at, keys.size)).astype(np.float64)


def band_coordinates(k: int, bands: int) -> np.ndarray:
    """(bands, ROWS) coordinates: consecutive ones first, then ones k / ROWS apart, so that no two are in an earlier band together."""
    runs = np.arange(k).reshape(-1, ROWS)
    return np.concatenate([runs, np.arange(k).reshape(ROWS, -1).T])[:bands]


def sign_batch(b: pa.RecordBatch, k: int, bands: int) -> pa.RecordBatch:
    """doc_id, text_key, a 64-bit hash of the signature, 16 bits a coordinate, and a 64-bit key a band; rows without words are left out."""
    owner, element, weight = shingles(b.column("text"))
    sig = signatures(owner, element, weight, b.num_rows, k)
    full = np.flatnonzero(np.isfinite(sig[:, 0]))
    bits = K.mix(sig[full].view(_U))
    which = band_coordinates(k, bands)
    band = np.repeat(np.arange(len(which), dtype=_U)[None] * _U(0x9E3779B97F4A7C15), full.size, 0)
    for i in range(ROWS):
        band = K.mix(band ^ bits[:, which[:, i]])
    node = np.zeros(full.size, _U)
    for i in range(k):
        node = K.mix(node * _U(0x9E3779B97F4A7C15) + bits[:, i])
    short = np.ascontiguousarray((bits >> _U(48)).astype("<u2"))
    rows = pa.array(full)
    return pa.record_batch(
        [
            b.column("doc_id").take(rows),
            b.column("text_key").take(rows),
            pa.array(node.view(np.int64)),
            pa.Array.from_buffers(pa.binary(), full.size, [None, pa.py_buffer((np.arange(full.size + 1) * 2 * k).astype(np.int32)), pa.py_buffer(short)]),
            pa.ListArray.from_arrays(pa.array((np.arange(full.size + 1) * len(which)).astype(np.int32)), pa.array(band.reshape(-1).view(np.int64))),
        ],
        names=["doc_id", "text_key", "node", "sig", "bands"],
    )


def sign(docs: DataFrame, k: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """doc_id, text_key (the text's hash), node (the signature's), sig and bands of every row of docs that has an identifier and a word, in one narrow Arrow pass."""

    def run(batches):
        for b in chunks(batches, "text"):
            yield sign_batch(b, k, bands)

    kind = id_type(docs)
    docs = only(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key bigint, node bigint, sig binary, bands array<bigint>")


@F.pandas_udf(T.DoubleType())
def agreement(a, b):
    """The share of equal coordinates of two columns of signatures."""
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(1))


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for every node of the edges (a, b) but the roots, root being its component's least node; and the folder it is in.

    Alternates large-star and small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). A node's least
    neighbour comes from an aggregation with partial sums and is joined to its edges, so the edges of one node, however many,
    are never in one task: aggregations reduce them where they are, and joins are split where they are skewed. Each
    round is cut to the shared folder, and the one before is removed. It ends when a round changes nothing.
    """
    spark = edges.sparkSession
    pairs, path = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct())
    before = None
    while True:
        both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(pairs.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = pairs.join(least.withColumnRenamed("x", "u"), "u").select("v", F.col("m").alias("u")).distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(lowest.select("v", F.col("m").alias("u"))).distinct()
        after_pairs, after_path = cut(small)
        row = after_pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        remove(spark, path)
        pairs, path = after_pairs, after_path
        if tuple(row) == before:
            break
        before = tuple(row)
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")), path


def _close(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose signatures agree in at least ``threshold`` of the coordinates."""
    left, right = (signed.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(agreement("sig_a", "sig_b") >= threshold).select("a", "b")


def _tokens(nodes: DataFrame, k: int) -> DataFrame:
    """A row for each coordinate and its 16 bits of the signatures in (node, sig)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                own = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(b.num_rows, k)
                yield pa.record_batch([pa.array(np.repeat(b.column("node").to_numpy(), k)), pa.array((own.astype(np.int32) + (np.arange(k, dtype=np.int32) << 16)).reshape(-1))], names=["node", "token"])

    return nodes.select("node", "sig").mapInArrow(run, "node bigint, token int")


def _rest(near: DataFrame, others: DataFrame, groups: DataFrame, signed: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) left to compare: of those others that aren't like their bucket's least, with members of such buckets that aren't in one group with them.

    Two signatures that agree in t of k coordinates share one of their k - t + 1 rarest tokens each (the prefix filter of
    set similarity joins, Chaudhuri et al., 2006). What brings unlike texts into one bucket is what many have in common; these
    tokens are frequent, and no texts that share fewer than t of them have one among their rarest. So a bucket of
    texts that aren't alike gives hardly any pair, however many they are.
    """
    asked = others.select("node").distinct().withColumn("asked", F.lit(True))
    members = near.join(others.select("key").distinct(), "key", "left_semi").select("node").distinct()
    tokens = _tokens(members.join(signed.select("node", "sig"), "node"), k)
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    known = tokens.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))  # k tokens at most
    rarest = k - math.ceil(threshold * k) + 1
    spare = F.greatest(F.lit(0), F.lit(rarest - k) + F.size("own"))  # of the rarest, those that no other has are left out already
    prefix = known.select("node", F.explode(F.slice("own", F.lit(1), spare)).alias("t")).select("node", F.col("t.token").alias("token"))
    prefix = prefix.join(groups, "node", "left").join(asked, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"), F.coalesce("asked", F.lit(False)).alias("asked"))
    x, y = (prefix.select(*(F.col(c).alias(c if c == "token" else f"{c}_{s}") for c in prefix.columns)) for s in "ab")
    found = x.join(y, "token").where("asked_a and root_a != root_b and (node_a < node_b or not asked_b)")
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _classes(docs: DataFrame, threshold: float, k: int, bands: int) -> DataFrame:
    """doc_id, text_key, and class (a node that stands for the group) of every row that has an identifier and a word."""
    spark = docs.sparkSession
    rows, rows_path = cut(sign(docs, k, bands))
    signed, signed_path = cut(rows.groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    banded = signed.select("node", F.explode("bands").alias("key"))
    ends = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    near, near_path = cut(banded.join(ends.drop("most"), "key").where("node != least"))
    links, links_path = cut(_close(near.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), signed, threshold))
    others, others_path = cut(near.join(links, (near["least"] == links["a"]) & (near["node"] == links["b"]), "left_anti"))
    groups, groups_path = components(links)
    paths = [signed_path, near_path, links_path, others_path]
    if not others.isEmpty():
        more, more_path = cut(_close(_rest(near, others, groups, signed, threshold, k), signed, threshold))
        paths.append(more_path)
        if not more.isEmpty():
            paths.append(groups_path)
            groups, _ = components(links.unionByName(more))
    for path in paths:
        remove(spark, path)
    return rows.select("doc_id", "text_key", "node").join(groups, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("class"))


def _members(classes: DataFrame) -> DataFrame:
    """The rows of classes with several, and kept: the least (doc_id, text_key) of the class."""
    row = F.struct("doc_id", "text_key")
    several = classes.groupBy("class").agg(F.min(row).alias("kept"), F.max(row).alias("most")).where("kept < most").drop("most")
    return classes.join(several, "class")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """(doc_id, kept_doc_id) for every document that has a near duplicate of a lesser identifier; kept_doc_id is its group's least.

    1. Signatures, in one Arrow pass, are written to the shared folder: 256 bytes a document, and 384 of band keys. Rows with
       the same signature, however many, become one node by an aggregation, and only it is banded.
    2. Within a band's bucket each node is compared with the bucket's least; those that are like it are in one group
       whatever they are to each other. Pairs of the others with each other or with the rest, unless in one group by now,
       are found by the rarest of their coordinates (see _rest). So every two nodes that share a bucket are compared, or proved
       unlike, or in one group, without a cap; a bucket is linear if it is one group or if its texts aren't alike.
    3. Two nodes are alike where the signatures agree in at least ``threshold`` of the coordinates; the components of the
       pairs that are alike are the groups.

    No window and no group is held in one task: bucket's leasts and roots are aggregated with partial results and joined
    back, where a hot key is split; no side is broadcast by this code. Identifiers are compared as bigint if they are whole
    numbers, else as strings. Texts without a word, null texts and null identifiers are never duplicates. Rows that repeat an
    identifier with one text are one document; with several texts, the identifier is in the group of each. Ties have no
    effect: the least identifier stands. No rows give no rows, extra columns are ignored, a long text counts whole.
    """
    members = _members(_classes(docs, threshold, k, bands))
    return members.where("doc_id != kept.doc_id").select("doc_id", F.col("kept.doc_id").alias("kept_doc_id")).distinct()


def stage(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least identifier (of several texts of it, that of the least hash).

    Only rows whose own text is in a group go: an identifier that has other texts keeps them. Rows without an identifier, a
    text or a word all stay. Of rows that repeat an identifier and a text with a word one stays, the one with the least hash of all columns.
    """
    own, names = inner(docs)
    classes, _ = cut(_classes(docs, THRESHOLD, COORDINATES, BANDS))
    members = _members(classes)
    gone = members.where("doc_id != kept.doc_id or text_key != kept.text_key").select("doc_id", "text_key").distinct()
    again = classes.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n").join(gone, ["doc_id", "text_key"], "left_anti")
    gone, _ = cut(gone)
    again, _ = cut(again)
    key, text = (own[f"_{names.index(c)}"] for c in ("doc_id", "text"))
    same = lambda df: (key.cast(df.schema["doc_id"].dataType) == df["doc_id"]) & (F.xxhash64(text) == df["text_key"]) & text.isNotNull()
    if again.isEmpty():
        return own.join(gone, same(gone), "left_anti").toDF(*names)
    away, _ = cut(gone.unionByName(again))
    once = own.join(again, same(again), "left_semi").withColumn("row_key", row_key(own))
    once = once.groupBy(key.alias("key"), F.xxhash64(text).alias("text_key")).agg(F.min_by(F.struct(*own.columns), "row_key").alias("row")).select("row.*")
    return own.join(away, same(away), "left_anti").unionByName(once).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
