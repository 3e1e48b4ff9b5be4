"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score is linear in its own features and those of the lines before and after it,
and neighbouring labels have transition weights. Forward-backward gives each line's marginal, and their mean, weighted
by the lines' lengths, is the document's quality.

With two states the messages are log odds: going forward r[t] = e[t] + f(r[t - 1]), and likewise backward, so one
step takes line t of all documents of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import kernels as K
from foliospark.llm.common import chunks, offsets_array, only, table

#: Labelled documents of each label that the fit sees at most, and characters of all of them together.
PER_LABEL, SAMPLE_CHARS = 1500, 16 << 20
THRESHOLD = 0.5
PLAIN = np.zeros(256, bool)
PLAIN[list(b".,;:'\"!?()-")] = True
TERMINAL = np.zeros(256, bool)
TERMINAL[list(b".!?:;\"')")] = True
OWN = 13
FIT_CHUNK_BYTES = 1 << 20


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, 3 * OWN + 2) features, the text of each line and its bytes; blank lines are left out."""
    column, buf, offsets = K.texts_of(column)
    if not buf.size:
        return np.zeros((0, 3 * OWN + 2)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = K.texts_of(K.lower(column))[1]
    kind = K.classes(buf)
    begin = np.union1d(offsets[:-1], np.flatnonzero(buf == 10) + 1)
    begin = begin[begin < buf.size]
    total = lambda mask: np.add.reduceat(mask.astype(np.int32), begin).astype(np.float64)
    solid = total(kind != K.SPACE)
    size = np.maximum(solid, 1)
    odd = (kind == K.OTHER) & ~PLAIN[buf]
    start, end, owner = K.words(kind, offsets)
    h = K.span_hashes(low, start, end)
    line = np.searchsorted(begin, start, "right") - 1
    n_words = np.bincount(line, minlength=begin.size).astype(np.float64)
    again = np.zeros(begin.size)
    for lag in (1, 2):
        same = (h[lag:] == h[:-lag]) & (line[lag:] == line[:-lag])
        again = np.maximum(again, np.bincount(line[lag:][same], minlength=begin.size))
    inside = np.flatnonzero(kind != K.SPACE)
    edge = np.searchsorted(inside, np.append(begin, buf.size))
    full = np.flatnonzero(edge[1:] > edge[:-1])
    first, last = inside[edge[:-1][full]], inside[edge[1:][full] - 1]
    text = np.searchsorted(offsets, begin[full], "right") - 1
    same = np.zeros(full.size + 1, bool)
    lh = K.span_hashes(low, first, last + 1)
    same[1:-1] = (lh[1:] == lh[:-1]) & (text[1:] == text[:-1])
    own = np.stack(
        [
            np.log1p(solid[full]),
            np.log1p(n_words[full]),
            (total(kind == K.LETTER) / size)[full],
            (total(kind == K.NUMBER) / size)[full],
            (total(buf != low) / size)[full],
            (total(odd) / size)[full],
            (total((kind == K.OTHER) & PLAIN[buf]) / size)[full],
            np.minimum(solid / np.maximum(n_words, 1), 40)[full],
            (again / np.maximum(n_words, 1))[full],
            TERMINAL[buf[last]].astype(float),
            (buf[first] != low[first]).astype(float),
            (odd[last] | odd[first]).astype(float),
            (same[:-1] | same[1:]).astype(float),
        ],
        1,
    )
    blank = np.zeros((1, OWN))
    joined = np.zeros(full.size + 1, bool)  # the line goes on the text of the one before
    joined[1:-1] = text[1:] == text[:-1]
    before = np.where(joined[:-1, None], np.concatenate([blank, own[:-1]]), 0)
    after = np.where(joined[1:, None], np.concatenate([own[1:], blank]), 0)
    return np.concatenate([own, before, after, joined[:-1, None], joined[1:, None]], 1), text, solid[full].astype(np.int64)


class Layout:
    """Lines of several texts, arranged so that step t is a slice: the texts with the most lines come first."""

    def __init__(self, text: np.ndarray):
        count = np.bincount(text) if text.size else np.zeros(0, np.int64)
        begin = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        self.begin, count = begin[order], count[order]
        self.active = np.searchsorted(-count, -np.arange(int(count.max(initial=0))), "left").tolist()

    def rows(self, t: int) -> np.ndarray:
        return self.begin[: self.active[t]] + t


def _odds(a: np.ndarray, r: np.ndarray, forward: bool) -> np.ndarray:
    """The log odds that a message with log odds r has after a transition."""
    off = (a[0, 1], a[1, 0]) if forward else (a[1, 0], a[0, 1])
    return np.logaddexp(off[0], a[1, 1] + r) - np.logaddexp(a[0, 0], off[1] + r)


def messages(e: np.ndarray, a: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds with a line's own score, and backward log odds without it."""
    r, b = e.copy(), np.zeros_like(e)
    for t in range(1, len(layout.active)):
        at = layout.rows(t)
        r[at] += _odds(a, r[at - 1], True)
    for t in range(len(layout.active) - 1, 0, -1):
        at = layout.rows(t)
        b[at - 1] = _odds(a, e[at] + b[at], False)
    return r, b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Crf:
    """w over the standardised features with 1 in front; a[i, j] from label i to j, 1 being good."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    a: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.w[0] + np.clip((x - self.mean) / self.scale, -6, 6) @ self.w[1:]

    def marginals(self, x: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The probability that each line is good."""
        e = self.scores(x)
        r, b = messages(e, self.a, Layout(text))
        return _sigmoid(r + b)


def _gradient(w, a, z, y, layout, link, chain: bool) -> tuple[np.ndarray, np.ndarray]:
    e = w[0] + z @ w[1:]
    if not chain:  # without transitions the lines are independent
        rest = y - _sigmoid(e)
        return np.concatenate([[rest.sum()], rest @ z]), np.zeros((2, 2))
    r, b = messages(e, a, layout)
    rest = y - _sigmoid(r + b)
    left, right = r[link - 1], e[link] + b[link]
    logs = np.stack([np.full_like(left, a[0, 0]), a[0, 1] + right, a[1, 0] + left, a[1, 1] + left + right], 1)
    pair = np.exp(logs - logs.max(1, keepdims=True))
    pair /= pair.sum(1, keepdims=True)
    seen = np.bincount((2 * y[link - 1] + y[link]).astype(np.int64), minlength=4)
    return np.concatenate([[rest.sum()], rest @ z]), (seen - pair.sum(0)).reshape(2, 2)


def _ascend(w, a, z, y, text, steps: int, chain: bool, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean log likelihood; without the chain the transitions stay."""
    layout = Layout(text)
    link = np.flatnonzero(np.append(False, text[1:] == text[:-1]))
    both = np.concatenate([w, a.reshape(-1)])
    m = v = np.zeros_like(both)
    for i in range(1, steps + 1):
        gw, ga = _gradient(both[:-4], both[-4:].reshape(2, 2), z, y, layout, link, chain)
        g = np.concatenate([gw, ga.reshape(-1)]) / max(1, len(y)) - penalty * both
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        both = both + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return both[:-4], both[-4:].reshape(2, 2)


def _features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features and the text of each line, some texts at a time: the kernels' work space is many times a chunk's bytes."""
    found, batch = [], pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    done = 0
    for b in chunks([batch], "text", FIT_CHUNK_BYTES):
        x, text, _ = line_features(b.column("text"))
        found.append((x, text + done))
        done += b.num_rows
    return (np.concatenate([x for x, _ in found]), np.concatenate([t for _, t in found])) if found else (np.zeros((0, 3 * OWN + 2)), np.zeros(0, np.int64))


def fit(texts: list[str], labels: list[int], steps: int = 150) -> Crf | None:
    """The field for labelled documents; None unless both labels have lines.

    Lines first take their document's label, and a model without transitions learns them. As bad documents also
    have good lines, those that it is sure of become good, unless no bad one would be left; then the field is fitted.
    """
    x, text = _features_of(texts)
    label = np.asarray(labels, float)
    y = label[text]
    if not (y == 0).any() or not (y == 1).any():
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -6, 6)
    w, a = _ascend(np.zeros(z.shape[1] + 1), np.zeros((2, 2)), z, y, text, steps, False)
    sure = _sigmoid(w[0] + z @ w[1:]) > 0.8
    n = len(texts)
    all_sure = np.bincount(text[~sure], minlength=n) == 0
    y = np.where((y == 0) & sure & ~all_sure[text], 1.0, y)
    w, a = _ascend(w, a, z, y, text, steps, True)
    return Crf(mean, scale, w, a)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, sample_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_label`` documents of each label in the order of their identifiers' hashes, whole texts of any
    length, until a label's next one would make more than ``sample_chars`` characters.

    Rows without identifier, label or text and identifiers with both labels don't take part. The choice is made on the
    labels, of which each partition keeps as many as could be chosen, and on the lengths of their texts; only the chosen
    texts come to the driver.
    """
    own = only(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("most")).where("q = most")
    kind = labels.schema["doc_id"].dataType.simpleString()
    chosen = {}
    for q in (0, 1):  # twice as many as are wanted: some may have no text
        for at, r in enumerate(own.where(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_label).select("doc_id").collect()):
            chosen[r.doc_id] = (q, at)
    texts = only(docs, "doc_id", "text").where("text is not null")

    def of(ids) -> DataFrame:
        """The rows of the identifiers, of which there are 4 * per_label at most."""
        few = docs.sparkSession.createDataFrame([(i,) for i in ids], f"id {kind}")
        return texts.join(F.broadcast(few), texts["doc_id"] == few["id"])

    sizes = {r.doc_id: r.n for r in of(chosen).groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).collect()} if chosen else {}
    taken = []
    for q in (0, 1):
        left = sample_chars
        for _, i in sorted((at, i) for i, (label, at) in chosen.items() if label == q and i in sizes)[:per_label]:
            if (left := left - sizes[i]) < 0:
                break
            taken.append(i)
    if not taken:
        return [], []
    found = {r.doc_id: r.text for r in of(taken).groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [found[i] for i in taken], [chosen[i][0] for i in taken]


def score_batch(texts: pa.Array, own: Crf | None, threshold: float) -> list[pa.Array]:
    """n_lines, n_bad, quality, keep and good_lines of a column of texts."""
    n = len(texts)
    x, text, size = line_features(texts)
    p = own.marginals(x, text) if own is not None else np.full(len(text), np.nan)
    count = np.bincount(text, minlength=n)
    quality = np.bincount(text, size * p, n) / np.where(count > 0, np.bincount(text, size, n), 1)
    known = (count > 0) & (own is not None)
    good = p >= 0.5
    cuts = np.concatenate([[0], np.cumsum(count)])
    return [
        pa.array(count.astype(np.int64)),
        pa.array(np.bincount(text, ~good, n).astype(np.int64) if own is not None else np.zeros(n, np.int64)),
        pa.array(quality, mask=~known),
        pa.array(known & (quality >= threshold)) if own is not None else pa.array(count > 0),
        offsets_array(cuts, pa.array(good if own is not None else np.ones(len(text), bool))),
    ]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_label: int = PER_LABEL, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, n_lines, n_bad, quality, keep and good_lines (a label for each line that isn't blank) for every row of docs.

    The field is fitted on the driver on a bounded sample of labelled documents (see sample) and travels with the tasks,
    a few hundred numbers. Then one narrow Arrow pass without a shuffle. A text without a line that isn't blank, or a null
    one, has null quality and isn't kept; if the labels don't give both kinds, quality is null, no line is bad and every
    text with a line is kept. A quality of just ``threshold`` is kept. Repeated rows get equal results, a long text or
    line counts whole, other columns are ignored, no rows give no rows.
    """
    own = fit(*sample(docs, labels, per_label, sample_chars))

    def run(batches):
        for b in chunks(batches, "text"):
            yield pa.record_batch([b.column("doc_id"), *score_batch(b.column("text"), own, threshold)], names=["doc_id", "n_lines", "n_bad", "quality", "keep", "good_lines"])

    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_lines bigint, n_bad bigint, quality double, keep boolean, good_lines array<boolean>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
