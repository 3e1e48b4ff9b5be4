"""Worksheets by column: a sheet in the form that common writers produce is read with array operations, without a step for each cell.

All tags are found at once and each becomes a letter; one expression over the letters says whether the sheet has the
usual grammar. Whatever is unusual (other elements, text between tags, entities, columns out of order, odd references)
gives None, and the row reader takes the sheet instead, with the same results where both can read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_GRAMMAR = re.compile(rb"(?:R(?:X|C(?:Ff|G)?(?:Vv|ITti)?c)*r|E)*")
_TAGS = {b"<row": b"R", b"</row>": b"r", b"<c": b"C", b"</c>": b"c", b"<v>": b"V", b"</v>": b"v", b"<f>": b"F", b"</f>": b"f", b"<f/>": b"G", b"<is>": b"I", b"</is>": b"i", b"<t>": b"T", b"</t>": b"t"}
QUOTE, SLASH, OPEN, CLOSE, SPACE, EQUALS = b'"/<> ='


class Columns(NamedTuple):
    """Rows by index and offsets into the cells; the cells' fields as arrays."""

    index: np.ndarray
    offsets: np.ndarray
    column: np.ndarray
    kind: pa.Array
    raw: pa.Array
    value: pa.Array
    boolean: pa.Array
    format: pa.Array
    formula: pa.Array


def _spans(buf: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array | None:
    """The bytes between starts and ends, ascending, as text; None if they aren't plain UTF-8 without entities."""
    cuts = np.empty(2 * start.size, np.int32)
    cuts[::2], cuts[1::2] = start, end
    pieces = pa.Array.from_buffers(pa.binary(), max(0, cuts.size - 1), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    try:
        out = pieces.take(pa.array(np.arange(0, 2 * start.size, 2))).cast(pa.string())
    except pa.ArrowInvalid:
        return None
    return None if pc.any(pc.match_substring(out, "&")).as_py() else out


def _numbers(buf: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray | None:
    """Plain decimal digits as numbers."""
    size = end - start
    if size.size and (size.min() < 1 or size.max() > most):
        return None
    out = np.zeros(start.size, np.int64)
    for i in range(int(size.max(initial=0))):
        on = size > i
        digit = buf[start[on] + i].astype(np.int64) - 48
        if digit.size and (digit.min() < 0 or digit.max() > 9):
            return None
        out[on] = out[on] * 10 + digit
    return out


def read(data: bytes, begin: int, end: int, strings: list[str], formats: list[str | None] | None) -> Columns | None:
    """The rows between the tags of sheetData, from ``begin`` to ``end``."""
    if end - begin >= 1 << 31:
        return None
    data = data[begin:end]
    buf = np.frombuffer(data, np.uint8)
    start, stop = np.flatnonzero(buf == OPEN), np.flatnonzero(buf == CLOSE)
    if start.size != stop.size or (start.size and not ((start < stop).all() and (start[1:] > stop[:-1]).all() and start[0] == 0 and stop[-1] == buf.size - 1)):
        return None
    size = stop - start + 1
    letter = np.zeros(start.size, np.uint8)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    bytes_at = [padded[start + i] for i in range(6)]
    for tag, code in _TAGS.items():
        on = np.ones(start.size, bool)
        for i, b in enumerate(tag):
            on &= bytes_at[i] == b
        if tag in (b"<row", b"<c"):
            on &= bytes_at[len(tag)] == SPACE
        else:
            on &= size == len(tag)
        letter[on] = code[0]
    preserve = b'<t xml:space="preserve">'
    maybe = np.flatnonzero((letter == 0) & (size == len(preserve)) & (bytes_at[1] == ord("t")))
    if maybe.size:
        same = np.ones(maybe.size, bool)
        for i, b in enumerate(preserve):
            same &= buf[start[maybe] + i] == b
        letter[maybe[same]] = ord("T")
    if not letter.all():
        return None
    closed = buf[stop - 1] == SLASH
    letter[closed & (letter == ord("R"))] = ord("E")
    letter[closed & (letter == ord("C"))] = ord("X")
    if not _GRAMMAR.fullmatch(letter.tobytes()):
        return None
    gap = start[1:] - stop[:-1] - 1
    if gap[~np.isin(letter[:-1], list(b"VTF"))].any():
        return None
    quotes = np.flatnonzero(buf == QUOTE)

    rows = np.flatnonzero((letter == ord("R")) | (letter == ord("E")))
    first = np.searchsorted(quotes, start[rows])
    if rows.size and (first + 1 >= quotes.size).any():
        return None
    head = start[rows]
    if not all((buf[head + 5 + i] == b).all() for i, b in enumerate(b'r="')) or (rows.size and (quotes[first] != head + 7).any()):
        return None
    index = _numbers(buf, quotes[first] + 1, quotes[first + 1], 10)
    if index is None or (index < 1).any():
        return None

    cells = np.flatnonzero((letter == ord("C")) | (letter == ord("X")))
    head, tail = start[cells], stop[cells] - (letter[cells] == ord("X"))
    first = np.searchsorted(quotes, head)
    n_quotes = np.searchsorted(quotes, tail) - first
    if not np.isin(n_quotes, (2, 4, 6)).all() or not all((buf[head + 3 + i] == b).all() for i, b in enumerate(b'r="')) or (quotes[first] != head + 5).any():
        return None
    column, at, last = np.zeros(cells.size, np.int64), quotes[first] + 1, quotes[first + 1]
    for _ in range(4):
        b = buf[at]
        on = (b >= 65) & (b <= 90)
        column[on] = column[on] * 26 + (b[on] - 64)
        at = at + on
    if (at == quotes[first] + 1).any() or (at > quotes[first] + 4).any() or _numbers(buf, at, last, 10) is None:
        return None
    style, kind_at, kind_end = np.full(cells.size, -1), np.zeros(cells.size, np.int64), np.zeros(cells.size, np.int64)
    before = last
    for k in (2, 4):
        on = np.flatnonzero(n_quotes > k)
        a, z = quotes[first[on] + k], quotes[first[on] + k + 1]
        if (a - before[on] != 4).any() or (buf[a - 1] != EQUALS).any() or (buf[a - 3] != SPACE).any():
            return None
        name = buf[a - 2]
        if not np.isin(name, list(b"st")).all():
            return None
        s, t = on[name == ord("s")], on[name == ord("t")]
        if (style[s] >= 0).any() or (kind_end[t] > 0).any():
            return None
        found = _numbers(buf, a[name == ord("s")] + 1, z[name == ord("s")], 9)
        if found is None:
            return None
        style[s] = found
        kind_at[t], kind_end[t] = a[name == ord("t")] + 1, z[name == ord("t")]
        before = before.copy()
        before[on] = z
    if (before + 1 != tail).any():
        return None

    # Each cell's row, and its text: what stands in its v or t.
    row = np.searchsorted(rows, cells) - 1
    column -= 1
    if ((row[1:] == row[:-1]) & (column[1:] <= column[:-1])).any():
        return None
    texts = np.flatnonzero((letter == ord("V")) | (letter == ord("T")))
    owner = np.searchsorted(cells, texts) - 1
    begin_at, end_at = tail + 1, tail + 1  # an empty text at the cell's own end
    begin_at, end_at = begin_at.copy(), end_at.copy()
    begin_at[owner], end_at[owner] = stop[texts] + 1, start[texts + 1]
    raw = _spans(buf, data, begin_at, end_at)
    if raw is None:
        return None
    formula = np.zeros(cells.size, bool)
    formula[np.searchsorted(cells, np.flatnonzero((letter == ord("F")) | (letter == ord("G")))) - 1] = True

    length = kind_end - kind_at
    given = np.zeros(cells.size, np.int8)  # 0 number, 1 shared, 2 boolean, 3 string, 4 error
    for name, code in ((b"s", 1), (b"b", 2), (b"str", 3), (b"inlineStr", 3), (b"e", 4)):
        on = np.flatnonzero(length == len(name))
        same = np.ones(on.size, bool)
        for i, b in enumerate(name):
            same &= buf[kind_at[on] + i] == b
        given[on[same]] = code
    blank = (given == 0) & (begin_at == end_at)
    shared = np.flatnonzero(given == 1)
    numbers = _numbers(buf, begin_at[shared], end_at[shared], 9)
    if numbers is None or (numbers >= len(strings)).any():
        return None
    code = np.where(blank, 0, np.array([1, 2, 3, 2, 4])[given])
    kinds = pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int8)), pa.array(["blank", "number", "string", "boolean", "error"])).cast(pa.string())
    raw = pc.if_else(pa.array(blank), pa.scalar(None, pa.string()), raw)
    value = pc.if_else(pa.array(given == 3), raw, pa.scalar(None, pa.string()))
    if shared.size:
        value = pc.replace_with_mask(value, pa.array(given == 1), pa.array(strings, pa.string()).take(pa.array(numbers)))
    boolean = pa.nulls(cells.size, pa.bool_())
    if (given == 2).any():
        own = pc.utf8_trim_whitespace(raw)
        truth = pc.if_else(pc.is_in(own, pa.array(["1", "true", "TRUE"])), pa.scalar(True), pc.if_else(pc.is_in(own, pa.array(["0", "false", "FALSE"])), pa.scalar(False), pa.scalar(None, pa.bool_())))
        boolean = pc.if_else(pa.array(given == 2), truth, pa.scalar(None, pa.bool_()))
    form = pa.nulls(cells.size, pa.string())
    if formats:
        on = (code == 1) & (style >= 0) & (style < len(formats))
        form = pa.array(formats, pa.string()).take(pa.array(np.where(on, style, 0), mask=~on))
    return Columns(index - 1, np.searchsorted(row, np.arange(rows.size + 1)), column, kinds, raw, value, boolean, form, pa.array(formula))


#: Types by their Arrow and their SQL types. Times are microseconds of the day; a column without values goes as nulls of any type.
DIRECT = {
    "int64": (pa.int64(), "bigint"), "float64": (pa.float64(), "double"), "bool": (pa.bool_(), "boolean"), "utf8": (pa.string(), "string"), "null": (pa.bool_(), "boolean"),
    "date": (pa.date32(), "date"), "time": (pa.int64(), "bigint"), "datetime": (pa.timestamp("us"), "timestamp_ntz"),
}
_SHAPES = {"int64": r"^-?[0-9]{1,18}$", "float64": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"}
#: What a number has to look like in its format to be one of these.
_SHOWN = {"date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "time": r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$", "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"}


def values(own: Columns, schema: list[tuple[str, int, str, bool]], date1904: bool) -> list[pa.Array] | None:
    """The rows' values of a schema, a column each; None where a cell doesn't fit or its text isn't as plain as most."""
    n = own.index.size
    row = np.repeat(np.arange(n), np.diff(own.offsets))
    texts = shown(own, date1904) if any(kind in _SHOWN for _, _, kind, _ in schema) else None
    out = []
    for _, index, kind, nullable in schema:
        at = np.flatnonzero(own.column == index)
        kinds = own.kind.take(pa.array(at))
        filled = pc.not_equal(kinds, "blank")
        if not pc.all(filled).as_py():
            at, kinds = at[filled.to_numpy(zero_copy_only=False)], kinds.filter(filled)
        if not nullable and at.size < n:
            return None
        if not at.size:
            out.append(pa.nulls(n, DIRECT[kind][0]))
            continue
        if kind == "null":
            return None
        wanted = {"utf8": "string", "bool": "boolean"}.get(kind, "number")
        if not pc.all(pc.equal(kinds, wanted)).as_py():
            return None
        found = (texts if kind in _SHOWN else {"utf8": own.value, "bool": own.boolean}.get(kind, own.raw)).take(pa.array(at))
        if found.null_count:
            return None
        if kind in _SHAPES:
            if not pc.all(pc.match_substring_regex(found, _SHAPES[kind])).as_py():
                return None
            found = found.cast(DIRECT[kind][0])
            if kind == "float64" and not pc.all(pc.is_finite(found)).as_py():
                return None
        if kind in _SHOWN:
            if not pc.all(pc.match_substring_regex(found, _SHOWN[kind])).as_py():
                return None
            if kind == "time":
                h, m, second = (pc.utf8_slice_codeunits(found, i, i + 2).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in (0, 3, 6))
                found = pa.array((h * 3600 + m * 60 + second) * 1_000_000, pa.int64())
            else:
                found = found.cast(DIRECT[kind][0])
        if at.size < n:
            place = np.full(n, -1)
            place[row[at]] = np.arange(at.size)
            found = found.take(pa.array(place, mask=place < 0))
        out.append(found)
    return out


_DAY = np.timedelta64(86400, "s")
_PLAIN = r"^-?[0-9]{1,15}(\.[0-9]{1,15})?$"
#: Instants go by the nearest double alone, which digits beyond the 15th and an exponent don't make a matter of opinion.
_PLAIN_INSTANT = r"^-?[0-9]{1,15}(\.[0-9]{1,25})?([eE]-[0-9]{1,2})?$"


def _instants(kind: str, value: np.ndarray) -> np.ndarray:
    """Dates from 1 March 1900 on, times of non-negative serials, as text."""
    seconds = value % 1.0 * 86400
    seconds = np.floor(seconds) + (seconds - np.floor(seconds) >= 0.5)  # half up, exactly
    clock = (seconds.astype(np.int64) % 86400).astype("timedelta64[s]")
    day = np.datetime64("1899-12-30", "s") + (np.floor(value).astype(np.int64) * _DAY if kind != "time" else 0)
    if kind == "date":
        return np.datetime_as_string(np.full(value.size, day) if np.ndim(day) == 0 else day, unit="D")
    return np.datetime_as_string(day + clock, unit="s")


def shown(own: Columns, date1904: bool) -> pa.Array:
    """The numbers as their formats have them, by format; null where the general rules of cells.formatted have to say, with the same results."""
    out = pa.nulls(own.column.size, pa.string())
    if own.format.null_count == own.column.size:
        return out
    coded = own.format.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for code, name in enumerate(coded.dictionary.to_pylist()):
        at = np.flatnonzero(codes == code)
        raw = own.raw.take(pa.array(at))
        kind, _, decimals = name.partition(":")
        plain = pc.match_substring_regex(raw, _PLAIN_INSTANT if kind in ("date", "time", "datetime") else _PLAIN)
        if not pc.all(plain).as_py():
            at, raw = at[plain.to_numpy(zero_copy_only=False)], raw.filter(plain)
        value = raw.cast(pa.float64()).to_numpy()
        if kind in ("date", "time", "datetime"):
            fits = np.zeros(at.size, bool) if date1904 and kind != "time" else value >= 0 if kind == "time" else (value >= 61) & (value < 2_900_000)
        else:
            # Up to 15 digits, of which the JVM and Python make the same.
            value = value * 100 if kind == "percent" else value
            fits = np.abs(value) < 1e9 if kind in ("percent", "currency", "decimal") and int(decimals) <= 6 else np.zeros(at.size, bool)
        if not fits.all():
            at, value = at[fits], value[fits]
        if not at.size:
            continue
        if kind in ("date", "time", "datetime"):
            text = pa.array(_instants(kind, value).tolist(), pa.string())
            text = pc.utf8_slice_codeunits(text, 11) if kind == "time" else text
        else:
            head, tail = "$" * (kind == "currency"), "%" * (kind == "percent")
            text = pa.array(list(map(f"{head}%.{int(decimals)}f{tail}".replace("f%", "f%%").__mod__, value.tolist())), pa.string())
            if (value <= 0).any():
                text = pc.replace_substring_regex(text, r"^(\$?)-(0(\.0*)?%?)$", r"\1\2")
        if at.size == own.column.size:
            return text
        mask = np.zeros(own.column.size, bool)
        mask[at] = True
        out = pc.replace_with_mask(out, pa.array(mask), text)
    return out
