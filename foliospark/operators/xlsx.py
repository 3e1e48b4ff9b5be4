"""Workbooks: sheets, shared strings, number formats and the sparse rows of a worksheet."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from foliospark import errors as E
from foliospark.operators import sheet_columns
from foliospark.sources import package as P
from foliospark.sources import xml as X
from foliospark.sources.archive import Archive, Limits


class Sheet(NamedTuple):
    name: str
    rel: str
    visibility: str


class Workbook(NamedTuple):
    path: str
    sheets: list[Sheet]
    date1904: bool
    warnings: list[dict]


def workbook(archive: Archive) -> Workbook:
    path = P.main_part(archive, "xlsx")
    sheets, found, date1904 = [], [], None
    try:
        for kind, name, raw in X.tokens(archive.text(path)):
            if kind > X.EMPTY:
                continue
            if name == "sheet":
                own = X.attributes(raw)
                if "name" in own and "id" in own:
                    state = own.get("state", "").lower()
                    sheets.append(Sheet(own["name"], own["id"], {"hidden": "hidden", "veryhidden": "veryHidden"}.get(state, "visible")))
                else:
                    found.append(E.warning(E.W_SHEET, path, "ignored workbook sheet without name or relationship id"))
            elif name == "workbookPr" and date1904 is None:
                date1904 = X.attribute(raw, "date1904") in ("1", "true", "TRUE")
    except X.XmlFault as e:
        found.append(E.malformed(path, e))
    return Workbook(path, sheets, bool(date1904), found)


def in_scope(sheets: list[Sheet], include_hidden: bool) -> list[tuple[int, Sheet]]:
    """Sheets and their numbers from 1, among those that count."""
    return list(enumerate((s for s in sheets if include_hidden or s.visibility == "visible"), 1))


def select(sheets: list[Sheet], name: str | None, index: int | None, include_hidden: bool) -> tuple[int, Sheet]:
    """The one sheet by name, by number, or the first."""
    if name is not None and index is not None:
        raise E.EngineError(E.ARGUMENT, "invalid argument: select an XLSX sheet by name or index, not both")
    scope, word = in_scope(sheets, include_hidden), "workbook" if include_hidden else "visible"

    def missing(what: str) -> E.EngineError:
        return E.EngineError(E.MISSING, f"missing required OOXML part: {what}")

    if name is not None:
        named = [x for x in scope if x[1].name == name]
        if not named:
            raise missing(f"{word} sheet named {name}")
        if len(named) > 1:
            raise E.EngineError(E.ARGUMENT, f"invalid argument: multiple {word} sheets named {name}; use sheet index to disambiguate")
        return named[0]
    if index is not None:
        if index < 1:
            raise E.EngineError(E.ARGUMENT, "invalid argument: sheet index must be 1 or greater")
        if index > len(scope):
            raise missing(f"{word} sheet index {index}")
        return scope[index - 1]
    if not scope:
        raise missing("workbook sheets" if include_hidden else "visible workbook sheets")
    return scope[0]


def shared_strings(data: bytes, path: str = "xl/sharedStrings.xml") -> tuple[list[str], list[dict]]:
    out: list[str] = []
    parts: list[str] | None = None
    in_t = False
    try:
        for kind, name, raw in X.tokens(data):
            if kind == X.START:
                if name == "si":
                    parts = []
                elif name == "t" and parts is not None:
                    in_t = True
            elif kind == X.EMPTY:
                if name == "si":
                    out.append("")
                elif parts is not None and name == "tab":
                    parts.append("\t")
                elif parts is not None and name in ("br", "cr"):
                    parts.append("\n")
            elif kind == X.END:
                if name == "t":
                    in_t = False
                elif name == "si" and parts is not None:
                    out.append("".join(parts))
                    parts, in_t = None, False
            elif in_t and parts is not None:
                parts.append(X.decode(raw))
    except X.XmlFault as e:
        return out, [E.malformed(path, e)]
    return out, []


_BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??"}
_BUILT_IN |= dict.fromkeys([*range(5, 9), *range(37, 45)], "$#,##0.00")
_BUILT_IN |= dict.fromkeys(range(14, 18), "m/d/yyyy") | dict.fromkeys(range(18, 21), "h:mm")
_BUILT_IN |= dict.fromkeys((21, 22), "m/d/yyyy h:mm") | dict.fromkeys(range(45, 48), "h:mm:ss")
_FORMAT = re.compile(r'(?P<escape>[\\_*].?)|(?P<bracket>\[[^\]]*\]?)|(?P<quoted>"[^"]*"?)|(?P<other>.)', re.S)


def normalize_format(code: str) -> str:
    """The first section without literals, in lower case and without commas; a currency sign stays wherever it stood."""
    out = []
    for m in _FORMAT.finditer(code.split(";")[0]):
        if m["other"]:
            out.append(m["other"] if not m["other"].isascii() else m["other"].lower())
        elif m["quoted"]:
            out.append("$" * m["quoted"].count("$"))
        elif m["bracket"] and "$" in m["bracket"] and m["bracket"].endswith("]"):
            out.append("$")
    return "".join(out).replace(",", "")


def classify_format(code: str) -> str | None:
    """datetime, date, time, or percent, currency or decimal with a colon and the decimals."""
    own = normalize_format(code)
    if not own or "?" in own or "e+" in own:
        return None
    time = any(c in own for c in "hs") or "am/pm" in own
    date = any(c in own for c in "yd") or ("m" in own and not time)
    if date or time:
        return "datetime" if date and time else "date" if date else "time"
    tail = re.match(r"[0#]*", own.split(".")[1])[0] if "." in own else ""
    kind = "percent" if "%" in own else "currency" if "$" in own else "decimal" if set(own) <= set("#0.- ") and "0" in own else None
    return kind and f"{kind}:{tail.count('0')}"


def styles(data: bytes, path: str = "xl/styles.xml") -> tuple[list[str | None], list[dict]]:
    """The class of each cell format; a custom format must come before the cell formats."""
    custom: dict[int, str] = {}
    out: list[str | None] = []
    inside = False
    try:
        for kind, name, raw in X.tokens(data):
            if kind == X.END:
                inside = inside and name != "cellXfs"
            elif kind > X.EMPTY:
                continue
            elif name == "cellXfs":
                inside = inside or kind == X.START
            elif name == "numFmt":
                own = X.attributes(raw)
                if (n := X.whole(own.get("numFmtId"))) is not None and "formatCode" in own:
                    custom[n] = own["formatCode"]
            elif name == "xf" and inside:
                n = X.whole(X.attribute(raw, "numFmtId"))
                code = custom.get(n) or _BUILT_IN.get(n) if n is not None else None
                out.append(classify_format(code) if code is not None else None)
    except X.XmlFault as e:
        return out, [E.malformed(path, e)]
    return out, []


_LETTERS = re.compile(r"[A-Za-z]+")
#: Columns are 32-bit numbers.
MOST_COLUMN = (1 << 31) - 2


def column_of(reference: str) -> int | None:
    """The column, from 0, that the letters of a cell reference name."""
    m = _LETTERS.match(reference)
    if not m:
        return None
    n = 0
    for c in m[0].upper():
        n = n * 26 + ord(c) - 64
        if n > MOST_COLUMN:
            raise E.EngineError(E.BAD_XML, f"malformed XML: column {m[0][:20]} is out of range")
    return n - 1


class Cell(NamedTuple):
    kind: str
    raw: str | None
    value: str | None
    boolean: bool | None
    format: str | None
    formula: bool


BLANK = Cell("blank", None, None, None, None, False)
_TRUTH = {"1": True, "true": True, "TRUE": True, "0": False, "false": False, "FALSE": False}


class SheetReader:
    """Types the cells of one worksheet; without formats (None) numbers stay raw."""

    def __init__(self, path: str, strings: list[str], formats: list[str | None] | None):
        self.path, self.strings, self.formats = path, strings, formats
        self.warnings: list[dict] = []

    def cell(self, kind: str | None, text: str, style: str | None, formula: bool) -> Cell:
        if kind == "s":
            n = X.whole(text.strip())
            if n is None:
                self.warnings.append(E.warning(E.W_INDEX, self.path, f"invalid shared string index '{text}'"))
                return Cell("string", text, text, None, None, formula)
            if n >= len(self.strings):
                self.warnings.append(E.warning(E.W_BOUNDS, self.path, f"shared string index {n} is out of bounds"))
                return Cell("string", text, "", None, None, formula)
            return Cell("string", text, self.strings[n], None, None, formula)
        if kind == "b":
            return Cell("boolean", text, None, _TRUTH.get(text.strip()), None, formula)
        if kind in ("str", "inlineStr"):
            return Cell("string", text, text, None, None, formula)
        if kind == "e":
            return Cell("error", text, None, None, None, formula)
        if not text:
            return Cell("blank", None, None, None, None, True) if formula else BLANK
        n = X.whole(style) if self.formats is not None else None
        return Cell("number", text, None, None, self.formats[n] if n is not None and n < len(self.formats) else None, formula)

    _FAST = re.compile(
        rb'<c r="([A-Z]{1,3})\d+"(?: s="(\d+)")?(?: t="(\w+)")?(?:/>|>(<f>[^<]*</f>|<f/>)?(?:<v>([^<]*)</v>|<is><t(?: xml:space="preserve")?>([^<]*)</t></is>)?</c>)'
        rb'|</row>(?=<row |</sheetData>)|<row r="([1-9]\d{0,9})"((?: [\w:.]+="[^"]*")*)(/?)>'
    )

    def rows(self, data: bytes) -> Iterator[tuple[int, dict[int, Cell]]]:
        """(row index from 0, cells by column in order) as the worksheet has them; the last of a column's cells stands.

        The rows that common writers produce are recognised as they stand by one expression; from the first that isn't, and
        for all around them, the tokenizer takes over.
        """
        opening = data.find(b"<sheetData>")
        opened: list[bytes] = []
        state: dict = {"next": 0, "row": None, "cells": {}, "most": -1}
        if opening < 0:
            yield from self._general(X.tokens(data, 0, None, opened), state)
            return
        body = opening + len(b"<sheetData>")
        before = len(self.warnings)
        yield from self._general(X.tokens(data, 0, body, opened), state)
        if len(self.warnings) > before:
            return
        if not opened or opened[-1] != b"sheetData" or state["row"] is not None or state.get("cell"):
            yield from self._general(X.tokens(data, body, None, opened), state)
            return
        columns: dict[bytes, int] = {}
        # at: where everything before has been taken; a row counts once its end is seen, so a doubtful one is read again.
        at = done = body
        index, cells, most, ordered = None, {}, -1, True
        for m in self._FAST.finditer(data, body):
            if m.start() != at:
                break
            at = m.end()
            letters, style, kind, formula, value, inline, number, _, empty = m.groups()
            if letters is not None:
                if index is None:
                    break
                if (column := columns.get(letters)) is None:
                    column = columns[letters] = column_of(letters.decode())
                text = value if value is not None else inline
                text = "" if text is None else X.decode(text)
                if column <= most:
                    ordered = False
                most = max(most, column)
                cells[column] = self.cell(kind.decode() if kind else None, text, style.decode() if style else None, formula is not None)
            elif number is not None:
                if index is not None:
                    break
                if empty:
                    state["next"] = int(number)
                    yield int(number) - 1, {}
                    done = at
                else:
                    index, cells, most, ordered = int(number) - 1, {}, -1, True
                    kept = len(self.warnings)
            else:
                if index is None:
                    break
                state["next"] = index + 1
                yield index, cells if ordered else dict(sorted(cells.items()))
                index, done = None, at
        if index is not None:
            del self.warnings[kept:]
        yield from self._general(X.tokens(data, done, None, opened), state)

    def columns(self, data: bytes) -> tuple[sheet_columns.Columns, list[tuple[int, dict[int, Cell]]]] | None:
        """The rows by column, and those that follow the sheet's data, of which there usually are none; None where rows() is needed."""
        begin, end = data.find(b"<sheetData>"), data.find(b"</sheetData>")
        if begin < 0 or end < begin:
            return None
        begin += len(b"<sheetData>")
        opened: list[bytes] = []
        state: dict = {"next": 0, "row": None, "cells": {}, "most": -1}
        before = SheetReader(self.path, self.strings, self.formats)
        if list(before._general(X.tokens(data, 0, begin, opened), state)) or before.warnings or state["row"] is not None or state.get("cell") or not opened or opened[-1] != b"sheetData":
            return None
        found = sheet_columns.read(data, begin, end, self.strings, self.formats)
        if found is None:
            return None
        state["next"] = int(found.index[-1]) + 1 if found.index.size else 0
        return found, list(self._general(X.tokens(data, end, None, opened), state))

    def _general(self, tokens, state: dict) -> Iterator[tuple[int, dict[int, Cell]]]:
        try:
            for kind, name, raw in tokens:
                own = state.get("cell")
                if kind >= X.TEXT:
                    if own is not None and (own["v"] or own["t"]):
                        own["text"].append(X.decode(raw))
                elif name == "row":
                    if kind == X.END:
                        if state["row"] is not None:
                            yield state["row"], dict(sorted(state["cells"].items()))
                        state["row"] = None
                        continue
                    n = X.whole(X.attribute(raw, "r"))
                    index = n - 1 if n else state["next"]
                    state |= {"next": index + 1, "row": index, "cells": {}, "most": -1}
                    if kind == X.EMPTY:
                        state["row"] = None
                        yield index, {}
                elif name == "c":
                    if kind == X.START:
                        state["cell"] = self._open(raw, state)
                    elif kind == X.EMPTY:
                        if state["row"] is not None:
                            self._close(self._open(raw, state), state)
                    else:
                        state["cell"] = None
                        if own is not None and state["row"] is not None:
                            self._close(own, state)
                elif own is not None:
                    if name in ("v", "t") and kind != X.EMPTY:
                        own[name] = kind == X.START
                    elif name == "f" and kind != X.END:
                        own["f"] = True
        except X.XmlFault as e:
            self.warnings.append(E.malformed(self.path, e))

    @staticmethod
    def _open(raw: bytes, state: dict) -> dict:
        own = X.attributes(raw)
        column = column_of(own["r"]) if "r" in own else None
        if column is None and "r" in own:
            column = state["most"] + 1
        return {"kind": own.get("t"), "style": own.get("s"), "column": column, "text": [], "v": False, "t": False, "f": False}

    def _close(self, own: dict, state: dict) -> None:
        column = state["most"] + 1 if own["column"] is None else own["column"]
        state["most"] = max(state["most"], column)
        state["cells"][column] = self.cell(own["kind"], "".join(own["text"]), own["style"], own["f"])


class Opened(NamedTuple):
    """What the sheets of a package share."""

    archive: Archive
    book: Workbook
    rels: dict[str, P.Relationship]
    strings: list[str]
    formats: list[str | None] | None
    warnings: list[dict]


def open_workbook(archive: Archive, formatted: bool) -> Opened:
    book = workbook(archive)
    path = P.rels_path(book.path)
    rels = P.by_id(P.relationships(archive.text(path), path)) if book.sheets else {}
    found = list(book.warnings)
    strings: list[str] = []
    if archive.has("xl/sharedStrings.xml"):
        strings, more = shared_strings(archive.read("xl/sharedStrings.xml"))
        found += more
    formats = None
    if formatted:
        formats = []
        if archive.has("xl/styles.xml"):
            formats, more = styles(archive.text("xl/styles.xml"))
            found += more
    return Opened(archive, book, rels, strings, formats, found)


def sheet_reader(opened: Opened, sheet: Sheet, limits: Limits | None = None) -> tuple[SheetReader, bytes]:
    if sheet.rel not in opened.rels:
        raise E.EngineError(E.MISSING, f"missing required OOXML part: {sheet.rel}")
    path = P.resolve(P.parent(opened.book.path), opened.rels[sheet.rel], P.rels_path(opened.book.path))
    return SheetReader(path, opened.strings, opened.formats), opened.archive.read(path, limits)
