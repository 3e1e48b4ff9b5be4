"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Items and documents are taken as words: runs of letters, marks and digits in lower case, and single characters of scripts
that don't part words, compared by 64-bit hashes. The automaton of all items gives, while a document's words stream through
it, the length of the longest run of words that ends at each word and occurs in an item. A run goes if it has at least
``length_limit`` words, or if it covers at least ``coverage_limit`` of an item that contains it. Items of fewer than
``least_item`` words are ordinary phrases inside a sentence; such an item goes where it is a whole line.

Every run that can go has at least q words, q being the least that either limit asks of any item. A document's
q-grams are therefore first looked up among the items' in one vectorised step, and only stretches of consecutive
hits are streamed: what lies outside can't be part of such a run. A document without a hit has a longest match of fewer
than q words, whose length the lookups of shorter grams give. So the result is that of streaming everything.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import kernels as K
from foliospark.llm.common import chunks, cut, inner, offsets_array, only, table

LENGTH_LIMIT, COVERAGE_LIMIT, LEAST_ITEM = 8, 0.8, 4
#: Words of one automaton, whose making takes about a kilobyte a word; more items make more automata, which each document passes in turn.
AUTOMATON_WORDS = 200_000
#: Words that are broadcast at a time, at about 250 bytes each; a larger benchmark takes more passes over the documents.
PASS_WORDS = 1_000_000


class Automaton:
    """The suffix automaton of several word sequences.

    It is made with a dictionary a state and then kept as flat arrays: the edges of a state by word, its link and length,
    the words that a run ending there needs to go, and those of the longest suffix before it that goes.
    """

    def __init__(self, items: list[list[int]], length_limit: int = LENGTH_LIMIT, coverage_limit: float = COVERAGE_LIMIT, least_item: int = LEAST_ITEM):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        for item in items:
            last = 0
            for c in item:
                last = self._extend(last, c)
        need = array("i", [length_limit]) * len(self.next)
        for item in sorted(items, key=len):
            asked = math.ceil(coverage_limit * len(item))
            if len(item) < least_item or asked >= length_limit:
                continue
            v = 0
            for c in item:
                u = v = self.next[v][c]
                while u > 0 and need[u] == length_limit:
                    need[u] = asked
                    u = self.link[u]
        self.need = need
        self.best = array("i", [0]) * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.best[v] = self.length[v] if self.length[v] >= need[v] else self.best[self.link[v]]
        self.begin, self.words, self.to = array("q", [0]), array("Q"), array("i")
        for edges in self.next:
            for c in sorted(edges):
                self.words.append(c)
                self.to.append(edges[c])
            self.begin.append(len(self.to))
        del self.next

    @property
    def nbytes(self) -> int:
        return sum(len(a) * a.itemsize for a in (self.link, self.length, self.need, self.best, self.begin, self.words, self.to))

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's words and c, cut out of the one that p leads to if that has longer words as well."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def step(self, v: int, c: int) -> int:
        """The state that c leads to, -1 for none."""
        a, z = self.begin[v], self.begin[v + 1]
        if z - a > 1:
            a = bisect_left(self.words, c, a, z)
        return self.to[a] if a < z and self.words[a] == c else -1

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], int]:
        """Merged (first, end) of the words that go, and the length of the longest run that is in an item."""
        v = n = most = 0
        out: list[tuple[int, int]] = []
        link, length, need, best, step = self.link, self.length, self.need, self.best, self.step
        for i, c in enumerate(words):
            while (to := step(v, c)) < 0 and v:
                v = link[v]
                n = length[v]
            if to < 0:
                continue
            v, n = to, n + 1
            most = max(most, n)
            if gone := n if n >= need[v] else best[link[v]]:
                first = i + 1 - gone
                while out and out[-1][1] >= first:
                    first = min(first, out.pop()[0])
                out.append((first, i + 1))
        return out, most


class Matcher:
    """The automata of some items, their grams of up to q words, and those of them that only go as a whole line."""

    def __init__(self, items: list[list[int]], length_limit: int, coverage_limit: float, least_item: int):
        asked = [math.ceil(coverage_limit * len(x)) for x in items if len(x) >= least_item]
        self.q = max(1, min([length_limit, *asked]))
        h = np.array([c for x in items for c in x], np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
        self.grams = []
        for size in range(1, self.q + 1):
            found = K.gram_hashes(h, owner, size)
            self.grams.append(K.HashSet(found[found != 0]))
        self.lines = {}
        for size in range(1, least_item):
            short = [x for x in items if len(x) == size]
            if short:
                self.lines[size] = K.HashSet(K.gram_hashes(np.array(short, np.uint64).reshape(-1), np.repeat(np.arange(len(short)), size), size)[::size])
        self.automata, group, size = [], [], 0
        for i, x in enumerate(items):
            group.append(x)
            size += len(x)
            if size >= AUTOMATON_WORDS or i + 1 == len(items):
                self.automata.append(Automaton(group, length_limit, coverage_limit, least_item))
                group, size = [], 0

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.grams, *self.lines.values(), *self.automata))

    def spans(self, owner: np.ndarray, h: np.ndarray, n: int, line: np.ndarray | None = None) -> tuple[dict[int, list[tuple[int, int]]], np.ndarray]:
        """By text, the merged (first, end) words that go, numbered over all texts; and each text's longest run that is in an item.

        ``line`` numbers the words' lines over all texts.
        """
        out: dict[int, list[tuple[int, int]]] = {}
        longest = np.zeros(n, np.int64)
        grams = K.Grams(h, owner)
        hits = self.grams[-1].find(K.gram_hashes(h, owner, self.q))
        if hits.size:
            breaks = np.flatnonzero((np.diff(hits) > 1) | (np.diff(owner[hits]) > 0)) + 1
            for a, b in zip(hits[np.append(0, breaks)].tolist(), hits[np.append(breaks - 1, hits.size - 1)].tolist(), strict=True):
                words, text = h[a : b + self.q].tolist(), int(owner[a])
                for automaton in self.automata:
                    gone, most = automaton.stream(words)
                    longest[text] = max(longest[text], most)
                    if gone:
                        out.setdefault(text, []).extend((a + x, a + y) for x, y in gone)
        rest = np.flatnonzero(longest[owner] == 0)
        for size, known in enumerate(self.grams[:-1], 1):
            if not rest.size:
                break
            rest = rest[known.find(grams.at(size, rest))]
            longest[owner[rest]] = size
        if self.lines and line is not None and h.size:
            first = np.flatnonzero(np.append(True, np.diff(line) > 0))
            words = np.diff(np.append(first, h.size))
            for size, known in self.lines.items():
                mine = first[words == size]
                for i in mine[known.find(grams.at(size, mine))].tolist():
                    out.setdefault(int(owner[i]), []).append((i, i + size))
        return {text: merged(spans) for text, spans in out.items()}, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def matchers(items: DataFrame, length_limit: int = LENGTH_LIMIT, coverage_limit: float = COVERAGE_LIMIT, least_item: int = LEAST_ITEM) -> Iterator[Matcher]:
    """Matchers of at most PASS_WORDS words (or one item) each, made on the driver from the distinct texts of items; at least one."""

    def made(texts: list[str]) -> Matcher:
        _, _, _, owner, h = K.hashed_words(pa.array(texts, pa.string()), True)
        cuts, words = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist(), h.tolist()
        return Matcher([words[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a], length_limit, coverage_limit, least_item)

    held, size, none = [], 0, True
    for r in only(items, "text").where("text is not null").distinct().orderBy("text").toLocalIterator():
        n = len(r.text) // 2 + 1  # more words than this it can't have, where words are parted
        if held and size + n > PASS_WORDS:
            yield made(held)
            held, size, none = [], 0, False
        held.append(r.text)
        size += n
    if held or none:
        yield made(held)


def _look(texts: pa.Array, own: Matcher) -> tuple:
    """(start, end, owner) of the words of a column, then what spans() gives."""
    buf, start, end, owner, h = K.hashed_words(texts, True)
    line = np.searchsorted(np.flatnonzero(buf == 10), start) + owner if own.lines else None
    return start, end, owner, *own.spans(owner, h, len(texts), line)


def _clean(b: pa.RecordBatch, at: int, own: Matcher, before: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, list[pa.Array]]:
    """The cleaned texts of a batch and n_words, n_removed, longest and spans; ``before`` has the spans and longest of other passes."""
    texts, n = b.column(at), b.num_rows
    start, end, owner, found, longest = _look(texts, own)
    head = np.searchsorted(owner, np.arange(n))
    for spans, most in before:
        longest = np.maximum(longest, most.to_numpy())
        for text in np.flatnonzero(np.diff(spans.offsets.to_numpy())).tolist():
            mine = [(int(head[text]) + s["first"], int(head[text]) + s["last"] + 1) for s in spans[text].as_py()]
            found[text] = merged([*found.get(text, []), *mine])
    removed = np.zeros(n, np.int64)
    first, last, cuts = [], [], np.zeros(n + 1, np.int64)
    out = None
    if found:
        out = texts.to_pylist()
        begin = np.concatenate([[0], np.cumsum([0 if t is None else len(t.encode()) for t in out])])
        for text in sorted(found):
            data, from_, keep = out[text].encode(), 0, []
            for x, y in found[text]:
                keep.append(data[from_ : start[x] - begin[text]])
                from_ = end[y - 1] - begin[text]
                first.append(x - head[text])
                last.append(y - 1 - head[text])
            keep.append(data[from_:])
            out[text] = b"".join(keep).decode()
            cuts[text + 1] = len(found[text])
            removed[text] = sum(y - x for x, y in found[text])
    counts = np.bincount(owner, minlength=n).astype(np.int64)
    return texts if out is None else pa.array(out, pa.string()), [pa.array(counts), pa.array(removed), pa.array(longest), _list(first, last, cuts)]


def _list(first: list[int], last: list[int], cuts: np.ndarray) -> pa.Array:
    return offsets_array(np.cumsum(cuts), pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["first", "last"]))


ADDED = ("n_words", "n_removed", "longest", "spans")
_SPANS = "array<struct<first: bigint, last: bigint>>"


def _found(docs: DataFrame, items: DataFrame, length_limit: int, coverage_limit: float, least_item: int) -> tuple[DataFrame, list[str]]:
    """The result under inner names, then ADDED; and the columns' own names."""
    spark = docs.sparkSession
    docs, names = inner(docs, *ADDED)
    at, n = names.index("text"), len(names)

    def mark(own_of):
        """A pass before the last: each row with what goes and the longest run."""

        def run(batches):
            own = own_of.value
            for b in chunks(batches, at):
                _, _, owner, found, longest = _look(b.column(at), own)
                head, cuts, first, last = np.searchsorted(owner, np.arange(b.num_rows)), np.zeros(b.num_rows + 1, np.int64), [], []
                for text in sorted(found):
                    cuts[text + 1] = len(found[text])
                    first += [x - int(head[text]) for x, _ in found[text]]
                    last += [y - 1 - int(head[text]) for _, y in found[text]]
                yield pa.record_batch([*b.columns, _list(first, last, cuts), pa.array(longest)], names=[*b.schema.names, f"s{b.num_columns}", f"l{b.num_columns}"])

        return run

    def finish(own_of):
        def run(batches):
            own = own_of.value
            for b in chunks(batches, at):
                texts, found = _clean(b, at, own, [(b.column(i), b.column(i + 1)) for i in range(n, b.num_columns, 2)])
                columns = list(b.columns[:n])
                columns[at] = texts
                yield pa.record_batch([*columns, *found], names=[*b.schema.names[:n], *ADDED])

        return run

    passes = matchers(items, length_limit, coverage_limit, least_item)
    own, passed = next(passes), docs
    for following in passes:
        k = len(passed.columns)
        marked = passed.limit(0).select("*", F.lit(None).cast(_SPANS).alias(f"s{k}"), F.lit(None).cast("bigint").alias(f"l{k}"))
        passed, _ = cut(passed.mapInArrow(mark(spark.sparkContext.broadcast(own)), marked.schema))
        own = following
    count = F.lit(None).cast("bigint")
    bare = docs.limit(0).select("*", *(count.alias(c) for c in ADDED[:3]), F.lit(None).cast(_SPANS).alias("spans"))
    return passed.mapInArrow(finish(spark.sparkContext.broadcast(own)), bare.schema), names


def decontaminate(docs: DataFrame, items: DataFrame, length_limit: int = LENGTH_LIMIT, coverage_limit: float = COVERAGE_LIMIT, least_item: int = LEAST_ITEM) -> DataFrame:
    """All columns of docs with the spans cut out of text, then n_words, n_removed, longest and spans of its words.

    ``longest`` is the length of the longest run of the document's words that is in an item, whether it goes or not. One
    narrow Arrow pass, no shuffle. What is broadcast has at most PASS_WORDS words of the items, or one item, and about
    250 bytes each; a larger benchmark takes further passes, between which rows and their spans are written.

    A null text stays null with 0 words; an empty one has none; a text without a match is returned as it
    is; items that are null, empty or repeat another change nothing; an item of fewer than ``least_item`` words goes
    where it makes up a whole line; without items nothing goes. Repeated rows are treated
    alike, long texts stream whole, columns of docs that have the new names are replaced, no rows give no rows.
    """
    found, names = _found(docs, items, length_limit, coverage_limit, least_item)
    return found.toDF(*names, *ADDED)


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with the columns they have: contaminated spans are cut out of text, n_chars follows, and a document of which no word is left goes.

    Nulls, empty and long texts, repeated rows and empty tables: as in decontaminate. Columns named like its new ones aren't kept.
    """
    found, names = _found(docs, items, LENGTH_LIMIT, COVERAGE_LIMIT, LEAST_ITEM)
    found = found.where("n_removed = 0 or n_removed < n_words")
    if "n_chars" in names:
        own = f"_{names.index('n_chars')}"
        kind = found.schema[own].dataType
        found = found.withColumn(own, F.when(F.col("n_removed") > 0, F.length(f"_{names.index('text')}").cast(kind)).otherwise(F.col(own)))
    return found.drop(*ADDED).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: what was found in it and its text without it."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_removed", "longest", F.size("spans").cast("bigint").alias("n_spans"), spans.alias("spans"), "text")


_IS_WORD = r"[\p{L}\p{N}\p{M}]"


def _words(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{K.WORD_SQL}'), lambda x: regexp_matches(x, '{_IS_WORD}'))"


#: An item of n words asks for runs of k, the least that goes; runs of k words are joined. A short item is joined with lines.
ORACLE_SQL = rf"""
WITH item_words AS (SELECT row_number() OVER () AS item, {_words("text")} AS w FROM (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL)),
sized AS (SELECT item, w, CAST(CASE WHEN len(w) >= {LEAST_ITEM} THEN least({LENGTH_LIMIT}, ceil({COVERAGE_LIMIT} * len(w))) ELSE {LENGTH_LIMIT} END AS BIGINT) AS k FROM item_words WHERE len(w) > 0),
item_grams AS (SELECT item, k, j, array_to_string(w[j : j + k - 1], ' ') AS gram FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM sized)),
doc_words AS (SELECT doc_id, text, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
doc_grams AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM sized))),
line_words AS (SELECT doc_id, pos, {_words("line")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM doc_words)),
placed AS (SELECT doc_id, w, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM line_words),
hits AS (
  SELECT doc_id, i, k FROM doc_grams JOIN item_grams USING (k, gram)
  UNION SELECT doc_id, CAST(before + 1 AS BIGINT), CAST(len(p.w) AS BIGINT) FROM placed p JOIN sized s ON p.w = s.w WHERE len(s.w) < {LEAST_ITEM}),
item_each AS (SELECT item, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM sized),
doc_each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc_words),
islands AS (SELECT doc_id, item, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS island FROM doc_each JOIN item_each USING (word)),
longest AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) AS n FROM islands GROUP BY doc_id, item, diagonal, island) GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS word FROM hits),
spans AS (SELECT doc_id, min(word) AS a, max(word) AS z FROM (SELECT *, word - row_number() OVER (PARTITION BY doc_id ORDER BY word) AS island FROM gone) GROUP BY doc_id, island),
listed AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, string_agg((a - 1) || '-' || (z - 1), ',' ORDER BY a) AS spans FROM spans GROUP BY doc_id),
pieces AS (
  SELECT doc_id, pos, piece, is_word, sum(CAST(is_word AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY pos) AS word
  FROM (SELECT doc_id, pos, piece, regexp_matches(piece, '{_IS_WORD}') AS is_word
        FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{K.WORD_SQL}|[^\p{{L}}\p{{N}}\p{{M}}]') AS p FROM doc_words SEMI JOIN gone USING (doc_id))))),
cleaned AS (
  SELECT p.doc_id, coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT (g.word IS NOT NULL AND (is_word OR h.word IS NOT NULL))), '') AS text
  FROM pieces p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.word = p.word LEFT JOIN gone h ON h.doc_id = p.doc_id AND h.word = p.word + 1 GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(longest, 0) AS BIGINT) AS longest,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(spans, '') AS spans, CASE WHEN n_removed IS NULL THEN d.text ELSE c.text END AS text
FROM documents d LEFT JOIN doc_words USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN cleaned c USING (doc_id)
"""
