"""Exact top-k search by BM25 over an impact-ordered index, a score at a time.

Documents are cut into shards. In a shard's index the postings of a term are ordered by descending quantised impact,
and those of equal impact form a segment. A query takes the segments of its terms by descending impact and adds them to
accumulators. An accumulator is a lower bound of its document's score; with what each term can still bring and the
quantisation error it gives an upper bound. Once no document without an accumulator can reach the k-th best lower bound,
and few enough others can (which sets what is saved, not what is found), the rest is left; those that can
are scored exactly. A query whose bounds don't prove that early takes all its segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm import kernels as K
from foliospark.llm.common import chunks, cut, id_type, offsets_array, only, table

TOP, K1, B = 10, 1.2, 0.75
LEVELS = 1024
#: Postings of a shard at most (a document is never split), and those that a query takes between two attempts at a proof.
SHARD_POSTINGS, STEP = 4_000_000, 4096
#: Characters of the queries that go to the tasks at a time, or one query; more queries are more blocks, each with a pass of its own.
BLOCK_CHARS = 32 << 20


class Index:
    """A shard: its documents (by numbers that order them as their identifiers do) with their lengths, and (document, term, occurrences) postings in document order."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, average: float, scale: float):
        self.ids, self.term = ids, term
        norm = K1 * (1 - B + B * lengths / average)
        self.weight = idf[term] * (tf * (K1 + 1) / (tf + norm[doc]))
        self.begin = np.searchsorted(doc, np.arange(ids.size + 1))
        impact = np.minimum((self.weight / scale).astype(np.int64), LEVELS - 1)
        order = np.argsort(term.astype(np.int64) * LEVELS + (LEVELS - 1 - impact), kind="stable")
        self.docs = doc[order]
        key = (term.astype(np.int64) * LEVELS + impact)[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if key.size else np.zeros(0, np.int64)
        self.segment = np.append(edge, key.size)
        self.segment_term, self.segment_impact = key[edge] // LEVELS, key[edge] % LEVELS
        self.of_term = np.searchsorted(self.segment_term, np.arange(idf.size + 1))
        self.acc = np.zeros(ids.size, np.int64)
        self.wanted = np.zeros(idf.size)
        self.processed = 0

    def search(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the best k documents with a term of the query and their scores, by score and identifier."""
        have = self.of_term[terms + 1] > self.of_term[terms]
        terms, times = terms[have], times[have]
        if not terms.size:
            return np.zeros(0, np.int64), np.zeros(0)
        counts = self.of_term[terms + 1] - self.of_term[terms]
        segments = np.repeat(self.of_term[terms] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        which = np.repeat(np.arange(terms.size), counts)
        impact = self.segment_impact[segments] * times[which]
        order = np.argsort(-impact, kind="stable")
        segments, which, impact = segments[order], which[order], impact[order]
        sizes = self.segment[segments + 1] - self.segment[segments]
        done = np.cumsum(sizes)
        error = int(times.sum()) + 1  # each quantised impact is less than one level short
        acc, at, step = self.acc, 0, STEP
        acc[:] = 0
        while True:
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + step, "right")))
            n = sizes[at:stop]
            place = np.repeat(self.segment[segments[at:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            np.add.at(acc, self.docs[place], np.repeat(impact[at:stop], n))
            at, step = stop, step * 2
            rest = 0
            if at < segments.size:
                left, first = np.unique(which[at:], return_index=True)
                rest = int(impact[at:][first].sum())  # a term's next segment is its highest left
            least = int(np.partition(acc, -k)[-k]) if acc.size > k else 0
            reach = least - rest - error
            if at == segments.size:
                able = np.flatnonzero(acc >= max(reach, 0))
                break
            if reach > 0:
                able = np.flatnonzero(acc >= reach)
                if able.size * 8 <= acc.size or able.size <= 4 * k:
                    break
        self.processed += int(done[at - 1])
        self.wanted[terms] = times
        n = self.begin[able + 1] - self.begin[able]
        place = np.repeat(self.begin[able] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(np.repeat(np.arange(able.size), n), self.weight[place] * self.wanted[self.term[place]], able.size)
        self.wanted[terms] = 0
        score, able = np.round(score[score > 0], 6), able[score > 0]
        best = np.lexsort((self.ids[able], -score))[:k]
        return able[best], score[best]


class Queries:
    """Terms and times of each query, as numbers of the distinct words of all."""

    def __init__(self, texts: list[str]):
        _, _, _, owner, h = K.hashed_words(pa.array(texts, pa.string()), True)
        self.words, code = np.unique(h, return_inverse=True)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.each = [np.unique(code[a:b], return_counts=True) for a, b in zip(cuts, cuts[1:], strict=False)]


def postings(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id, length, terms and times of every document with an identifier and a text: the forward index of the queries' words."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        values = shared.value
        known = K.HashSet(values)
        for b in chunks(batches, "text"):
            n = b.num_rows
            _, _, _, owner, h = K.hashed_words(b.column("text"), True)
            at = known.find(h)
            key = owner[at] * np.int64(max(1, values.size)) + np.searchsorted(values, h[at])
            key, tf = np.unique(key, return_counts=True)
            doc, term = np.divmod(key, max(1, values.size))
            cuts = np.searchsorted(doc, np.arange(n + 1))
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(np.bincount(owner, minlength=n).astype(np.int64)), offsets_array(cuts, pa.array(term.astype(np.int32))), offsets_array(cuts, pa.array(tf.astype(np.int32)))],
                names=["doc_id", "length", "terms", "times"],
            )

    kind = id_type(docs)
    docs = only(docs, "doc_id", "text").where("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast(kind))
    return docs.mapInArrow(run, f"doc_id {kind}, length bigint, terms array<int>, times array<int>")


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def shards(batches) -> Iterator[list[pa.RecordBatch]]:
    """Batches, cut so that a shard has at most SHARD_POSTINGS postings or one document."""
    held, size = [], 0
    for b in batches:
        sizes = np.diff(b.column("terms").offsets.to_numpy())
        total, start = np.cumsum(sizes), 0
        while start < b.num_rows:
            used = int(total[start - 1]) if start else 0
            stop = max(int(np.searchsorted(total, used + SHARD_POSTINGS - size, "right")), start + (not held))
            if stop > start:
                held.append(b.slice(start, stop - start))
                size += int(total[stop - 1]) - used
                start = stop
            if start < b.num_rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def index_of(held: list[pa.RecordBatch], idf: np.ndarray, average: float, scale: float) -> tuple[Index, pa.Array]:
    """The index of a shard, and its documents' identifiers by place."""
    column = lambda name: [b.column(name) for b in held]
    names = pa.chunked_array(column("doc_id")).combine_chunks()
    lengths = np.concatenate([c.to_numpy(zero_copy_only=False) for c in column("length")])
    counts = np.concatenate([np.diff(c.offsets.to_numpy()) for c in column("terms")])
    term, tf = (np.concatenate([_flat(c) for c in column(n)]) for n in ("terms", "times"))
    if pa.types.is_integer(names.type):
        ids = names.to_numpy(zero_copy_only=False)
    else:
        ids = np.empty(len(names), np.int64)
        ids[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
    return Index(ids, lengths, np.repeat(np.arange(ids.size), counts), term, tf, idf, average, scale), names


def blocks(queries: DataFrame, id_column: str, most: int) -> Iterator[list[tuple]]:
    """The distinct (identifier, text) of the queries in order, at most ``most`` characters of text or one query at a time."""
    held, size = [], 0
    for r in only(queries, id_column, "text").where("text is not null").distinct().orderBy(id_column, "text").toLocalIterator():
        if held and size + len(r[1]) > most:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def _search_block(docs: DataFrame, rows: list[tuple], k: int, id_column: str, kind: str) -> DataFrame | None:
    spark = docs.sparkSession
    asked = Queries([t for _, t in rows])
    forward, _ = cut(postings(docs, asked.words))
    n, total = forward.agg(F.count("*"), F.sum("length")).first()
    if not n or not total or not asked.words.size:
        return None
    df = np.zeros(asked.words.size)
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[r[0]] = r[1]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((asked.each, idf, total / n, float(idf.max()) * (K1 + 1) / LEVELS))

    def run(batches):
        each, idf, average, scale = shared.value
        for held in shards(batches):
            own, names = index_of(held, idf, average, scale)
            found = [own.search(terms, times, k) for terms, times in each]
            places = np.concatenate([f[0] for f in found]).astype(np.int64)
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])), names.take(pa.array(places)), pa.array(np.concatenate([f[1] for f in found]))], names=["query", "doc_id", "score"])

    doc_kind = forward.schema["doc_id"].dataType.simpleString()
    best = forward.mapInArrow(run, f"query bigint, doc_id {doc_kind}, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")).cast("bigint")).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"query bigint, {id_column} {kind}")
    return ranked.join(names, "query").select(id_column, "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_column: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id and score: for every row of queries the k documents of the highest BM25 score.

    1. One pass over the texts keeps each document's length and its occurrences of the queries' words; it is written to
       the shared folder and nothing reads the texts again.
    2. Documents, their mean length and each word's document count are taken over all of it, in two aggregations.
    3. Each task indexes its documents, shard by shard, and runs every query on each shard.
    4. The shards' best k are merged by an exchange on the query: k rows a shard and query, whatever the shard's size.

    The queries and the counts of their words go to all tasks, in blocks of BLOCK_CHARS characters of queries; each block
    takes a pass over the documents, and the results are put together. Scores are rounded to six decimals, and equal ones
    ranked by doc_id (as a bigint if it is a whole number, else as a string); documents without a word of the query
    aren't found, so there may be fewer than k rows, and none for a query that is null, empty or wordless. Rows that
    repeat a query are one, an item_id with several texts has k rows for each. Rows of docs without identifier or text
    aren't searched and don't count; repeated rows are found each; long texts count whole; other columns are ignored.
    """
    kind = queries.schema[id_column].dataType.simpleString()
    found = [x for rows in blocks(queries, id_column, BLOCK_CHARS) if (x := _search_block(docs, rows, k, id_column, kind)) is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], f"{id_column} {kind}, rank bigint, doc_id {id_type(docs)}, score double")
    return reduce(DataFrame.unionByName, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = rf"list_filter(regexp_extract_all(lower(text), '{K.WORD_SQL}'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}\p{{M}}]'))"
ORACLE_SQL = rf"""
WITH doc_words AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
query_words AS (SELECT item_id, word, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS word FROM benchmark) GROUP BY item_id, word),
lengths AS (SELECT d.doc_id, count(word) AS length FROM documents d LEFT JOIN doc_words USING (doc_id) GROUP BY d.doc_id),
totals AS (SELECT count(*) AS n, sum(length)::DOUBLE / count(*) AS average FROM lengths),
tfs AS (SELECT doc_id, word, count(*) AS tf FROM doc_words GROUP BY doc_id, word),
idfs AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs, totals GROUP BY word, n),
scores AS (
  SELECT item_id, doc_id, round(sum(times * idf * (tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * length / average)))), 6) AS score
  FROM query_words JOIN tfs USING (word) JOIN idfs USING (word) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= {TOP}
"""
