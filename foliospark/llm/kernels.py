"""Vectorised text kernels over the UTF-8 bytes of whole Arrow columns.

A batch of texts is one byte buffer with offsets. Character classes are looked up for every byte, runs
of a class become spans, and spans are hashed with prefix sums, all in numpy: no Python object is made
for a word, and every byte of every text counts.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

OTHER, LETTER, NUMBER, SPACE, MARK = range(5)
IS_WORD = np.array([False, True, True, False, True])
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


@functools.cache
def code_points() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"), (MARK, r"\p{M}+")):
        for m in regex.finditer(pattern, text):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def texts_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The column with nulls as empty texts, its bytes, and the offsets of its texts from 0."""
    column = pc.fill_null(column.cast(pa.string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return column, buf, offsets - offsets[0]


def lower(column: pa.Array) -> pa.Array:
    """Lower case; a character whose lower case has another length in UTF-8 stays, so that offsets hold."""
    low = pc.utf8_lower(column)
    moved = pc.not_equal(pc.binary_length(low), pc.binary_length(column))
    if not pc.any(moved).as_py():
        return low
    out = low.to_pylist()
    for i in np.flatnonzero(moved.to_numpy(zero_copy_only=False)):
        out[i] = lower_one(column[int(i)].as_py())
    return pa.array(out, pa.string())


def lower_one(text: str) -> str:
    low = pc.utf8_lower(pa.scalar(text)).as_py()
    if len(low) == len(text):
        return "".join(b if len(a.encode()) == len(b.encode()) else a for a, b in zip(text, low, strict=True))
    return "".join(b if len((b := pc.utf8_lower(pa.scalar(a)).as_py()).encode()) == len(a.encode()) else a for a in text)


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of every byte's character."""
    table = code_points()
    kind = table[:256][buf]
    at = np.flatnonzero(buf >= 0xC0)
    if at.size:
        b = np.concatenate([buf, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (b[at + i].astype(np.int32) for i in range(4))
        n = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        cp = np.where(n == 2, (b0 & 31) << 6 | b1 & 63, np.where(n == 3, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        k = table[np.minimum(cp, 0x10FFFF)]
        for i in range(4):
            m = n > i
            kind[at[m] + i] = k[m]
    return kind


#: Scripts that don't part words: each of their letters, marks and digits is taken as a word.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: A word in SQL (RE2), for lower-cased texts; matches of the first branch that aren't letters, marks or digits are none.
WORD_SQL = rf"[{UNSPACED}]|(?:[^\P{{L}}{UNSPACED}]|[^\P{{N}}{UNSPACED}]|[^\P{{M}}{UNSPACED}])+"


@functools.cache
def unspaced() -> np.ndarray:
    """Of every code point, whether it is a word by itself."""
    out = np.zeros(0x110000, bool)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for m in regex.finditer(rf"[{UNSPACED}]+", text):
        out[ord(m[0][0]) : ord(m[0][-1]) + 1] = True
    return out & IS_WORD[code_points()]


def alone(buf: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The first bytes of characters that are words by themselves."""
    at = np.flatnonzero((buf >= 0xE0) & IS_WORD[kind])
    if not at.size:
        return at
    b = np.concatenate([buf, np.zeros(3, np.uint8)])
    b0, b1, b2, b3 = (b[at + i].astype(np.int32) for i in range(4))
    cp = np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63)
    return at[unspaced()[np.minimum(cp, 0x10FFFF)]]


def words(kind: np.ndarray, offsets: np.ndarray, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of letters, marks and digits; with ``buf``, characters of unspaced scripts are words each."""
    w = IS_WORD[kind]
    if not w.size:
        return (np.zeros(0, np.int64),) * 3
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    full = np.flatnonzero(np.diff(offsets))
    first, last = offsets[full], offsets[full + 1] - 1
    start[first] = w[first]
    end[last] = w[last]
    if buf is not None and (at := alone(buf, kind)).size:
        after = at + 3 + (buf[at] >= 0xF0)
        start[at], end[after - 1] = True, True
        start[after[after < w.size]] |= w[after[after < w.size]]
        end[at[at > 0] - 1] |= w[at[at > 0] - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Powers that are kept, for as many bytes as a usual chunk has; a longer text's are made for it and let go.
KEPT_BITS = 21


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    bits = int(size).bit_length()
    return _kept_powers() if bits <= KEPT_BITS else _make_powers(bits)


@functools.cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _make_powers(KEPT_BITS)


def _make_powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, from prefix sums of a polynomial; equal bytes give equal hashes anywhere."""
    up, down = _powers(buf.size)
    sums = np.zeros(buf.size + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: buf.size], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def hashed_words(column: pa.Array, units: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes and, for each word of its texts, start, end, text and the hash of its lower case; ``units``: see words()."""
    column, buf, offsets = texts_of(column)
    low = texts_of(lower(column))[1]
    start, end, owner = words(classes(buf), offsets, buf if units else None)
    return buf, start, end, owner, span_hashes(low, start, end)


class Grams:
    """Hashes of runs of words, from prefix sums over the words' hashes."""

    def __init__(self, h: np.ndarray, owner: np.ndarray):
        self.owner = owner
        up, self.down = _powers(h.size)
        self.sums = np.zeros(h.size + 1, _U)
        np.cumsum(h * up[: h.size], out=self.sums[1:])

    def at(self, size: int, where: np.ndarray) -> np.ndarray:
        """The hash of the ``size`` words from each of the words ``where`` on, 0 where its text has no more so many."""
        out = np.zeros(where.size, _U)
        inside = np.flatnonzero(where + size <= self.owner.size)
        w = where[inside]
        same = self.owner[w] == self.owner[w + size - 1]
        inside, w = inside[same], w[same]
        out[inside] = mix((self.sums[w + size] - self.sums[w]) * self.down[w]) | _U(1)
        return out


def gram_hashes(h: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each word on, 0 where its text has no more so many."""
    out = np.zeros(h.size, _U)
    if h.size >= size:
        up, down = _powers(h.size)
        sums = np.zeros(h.size + 1, _U)
        np.cumsum(h * up[: h.size], out=sums[1:])
        n = h.size - size + 1
        out[:n] = np.where(owner[:n] == owner[size - 1 :], mix((sums[size:] - sums[:n]) * down[:n]) | _U(1), _U(0))
    return out


class HashSet:
    """A set of 64-bit hashes that large arrays are looked up in: by a table of low bits, then exactly."""

    def __init__(self, values: np.ndarray):
        self.__setstate__(np.unique(values.astype(_U)))

    def __getstate__(self) -> np.ndarray:
        return self.values

    def __setstate__(self, values: np.ndarray) -> None:
        self.values = values
        bits = int(values.size).bit_length()
        self.mask = _U((1 << max(16, bits + (5 if bits < 15 else 3))) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[(values & self.mask).astype(np.int64)] = True

    @property
    def nbytes(self) -> int:
        return self.values.nbytes + self.table.nbytes

    def find(self, h: np.ndarray) -> np.ndarray:
        """The indexes of those of h that are in the set."""
        at = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        if not at.size or not self.values.size:
            return at[:0]
        got = h[at]
        return at[self.values[np.minimum(np.searchsorted(self.values, got), self.values.size - 1)] == got]


def pre_tokens(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the pre-tokens of the public byte-level BPE pattern, ascending; they cover every byte.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = buf.size
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(buf)
    kind[kind == MARK] = OTHER
    starts = np.zeros(n, bool)  # a pre-token starts at this byte
    starts[1:] = kind[1:] != kind[:-1]
    full = np.flatnonzero(np.diff(offsets))
    first = offsets[full]
    starts[first] = True
    is_first = np.zeros(n + 1, bool)
    is_first[first] = is_first[n] = True
    # White space before something else in the same text gives up its last character: a blank joins what follows, another stands alone.
    follows = np.flatnonzero(starts & ~is_first[:n] & (kind != SPACE))
    follows = follows[kind[follows - 1] == SPACE]
    back = follows - 1
    while (inside := (buf[back] & 0xC0) == 0x80).any():
        back = back - inside
    starts[back] = True
    starts[follows[buf[follows - 1] == 0x20]] = False
    # Contractions: a lone apostrophe that no blank joins, before the letters. More letters start a pre-token of their own.
    at = np.flatnonzero(buf == 0x27)
    at = at[starts[at]]
    at = at[(at + 1 < n)]
    at = at[starts[at + 1] & ~is_first[at + 1]]
    if at.size:
        b = np.concatenate([buf, np.zeros(2, np.uint8)])
        b1, b2 = b[at + 1], b[at + 2]
        same = (at + 2 < n) & ~is_first[np.minimum(at + 2, n)]
        two = same & (((b1 == ord("r")) & (b2 == ord("e"))) | ((b1 == ord("v")) & (b2 == ord("e"))) | ((b1 == ord("l")) & (b2 == ord("l"))))
        one = np.isin(b1, np.frombuffer(b"stmd", np.uint8))
        for m, k in ((one, 2), (two, 3)):
            starts[at[m] + 1] = False
            after = at[m] + k
            after = after[after < n]
            starts[after] = True
    return np.append(np.flatnonzero(starts)[1:], n)


def strings(buf: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans between consecutive ends as a binary array over the same bytes, which it doesn't copy."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
