"""Word documents: flattened text and structured tables of a part, and of a package with its related parts."""

from __future__ import annotations

from dataclasses import dataclass, field

from foliospark import errors as E
from foliospark.sources import package as P
from foliospark.sources import xml as X
from foliospark.sources.archive import Archive

RELATED = ("header", "footer", "footnotes", "endnotes", "comments")
DELETED = ("del", "moveFrom")


class _Text:
    """Collects text; a newline never doubles, and a pending separator becomes one blank before more text."""

    def __init__(self):
        self.parts: list[str] = []
        self.last = ""
        self.pending = False

    def add(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.last = s[-1]

    def flush(self) -> None:
        if self.pending and self.parts and not self.last.isspace():
            self.add(" ")
        self.pending = False

    def newline(self) -> None:
        if self.last != "\n":
            self.add("\n")


@dataclass
class _Nesting:
    rows: int = 0
    cells: int = 0
    has_cells: bool = False


def part_text(data: bytes, path: str) -> tuple[str, list[dict]]:
    """The flattened text of a part, and the warning that cut it short if any did."""
    out, tables = _Text(), []
    in_t, deleted = False, 0
    try:
        for kind, name, raw in X.tokens(data):
            if kind == X.START:
                if name in DELETED:
                    deleted += 1
                elif name == "tbl":
                    if tables and tables[-1].cells:
                        out.flush()
                    tables.append(_Nesting())
                elif name == "tr" and tables:
                    tables[-1].rows += 1
                    tables[-1].has_cells = out.pending = False
                elif name == "tc" and tables:
                    own = tables[-1]
                    if own.rows:
                        if own.has_cells:
                            out.add("\t")
                        own.has_cells = True
                        own.cells += 1
                    out.pending = False
                elif name == "t" and not deleted:
                    in_t = True
            elif kind == X.EMPTY:
                if not deleted:
                    if name == "tab":
                        out.flush()
                        out.add("\t")
                    elif name in ("br", "cr"):
                        out.pending = False
                        out.newline()
            elif kind == X.END:
                if name == "t":
                    in_t = False
                elif name in DELETED:
                    deleted, in_t = max(0, deleted - 1), False
                elif name == "p":
                    if not deleted:
                        if tables and tables[-1].cells:
                            out.pending = bool(out.parts)
                        else:
                            out.newline()
                elif name == "tc" and tables:
                    tables[-1].cells = max(0, tables[-1].cells - 1)
                    out.pending = False
                elif name == "tr" and tables:
                    own = tables[-1]
                    own.rows = max(0, own.rows - 1)
                    if own.has_cells:
                        if len(tables) > 1:
                            out.pending = True
                        else:
                            out.newline()
                            out.pending = False
                        own.has_cells = False
                elif name == "tbl" and tables:
                    tables.pop()
            elif in_t and (text := X.decode(raw)):
                out.flush()
                out.add(text)
    except X.XmlFault as e:
        return "".join(out.parts), [E.malformed(path, e)]
    return "".join(out.parts), []


@dataclass
class _Table:
    rows: list = field(default_factory=list)
    row: dict | None = None
    cell: dict | None = None
    columns: int | None = None
    in_row: int = 0
    in_cell: int = 0

    def end_cell(self) -> None:
        if self.cell is not None and self.row is not None:
            self.row["cells"].append(self.cell)
        self.cell, self.in_cell = None, 0

    def end_row(self) -> None:
        self.end_cell()
        if self.row is not None and not self.row.pop("deleted"):
            self.rows.append(self.row)
        self.row, self.in_row = None, 0

    def done(self, complete: bool) -> dict:
        return {"complete": complete, "grid_column_count": self.columns, "rows": self.rows}


#: Grid columns are 32-bit numbers; a row's add up to one too.
MOST_COLUMNS = 1 << 20


def _whole(text: str | None) -> int | None:
    return X.whole(text, MOST_COLUMNS)


def _property(table: _Table | None, name: str, raw: bytes, path: str, found: list[dict]) -> None:
    """Grid offsets of a row, span and merge of a cell, each only within its properties."""
    if table is None or table.row is None:
        return
    value = X.attribute(raw, "val")
    shown = "<missing>" if value is None else value
    row = f"row {len(table.rows) + 1}"
    if name in ("gridBefore", "gridAfter"):
        if table.in_row:
            n = _whole(value)
            if n is None:
                found.append(E.warning(E.W_OTHER, path, f"{row} has invalid {name} value {shown}; using 0"))
            table.row["grid_before" if name == "gridBefore" else "grid_after"] = n or 0
    elif table.in_cell and table.cell is not None:
        place = f"{row} cell {len(table.row['cells']) + 1}"
        if name == "gridSpan":
            n = _whole(value)
            if not n:
                found.append(E.warning(E.W_OTHER, path, f"{place} has invalid gridSpan value {shown}; using 1"))
            table.cell["grid_span"] = n or 1
        else:
            merge = "continue" if value is None else value.lower()
            if merge not in ("restart", "continue"):
                found.append(E.warning(E.W_OTHER, path, f"{place} has unknown vMerge value {shown}; using none"))
                merge = "none"
            table.cell["vertical_merge"] = merge


PROPERTIES = ("gridBefore", "gridAfter", "gridSpan", "vMerge")


def part_tables(data: bytes, path: str) -> tuple[list[dict], list[dict]]:
    """The tables of a part as trees: a cell's block is a paragraph's text or a table."""
    tables: list[dict] = []
    stack: list[_Table] = []
    found: list[dict] = []
    paragraph: list[str] | None = None
    in_t, deleted, fault = False, 0, None

    def top() -> _Table | None:
        return stack[-1] if stack else None

    def block(b) -> bool:
        if stack and stack[-1].cell is not None:
            stack[-1].cell["blocks"].append(b)
            return True
        return False

    def strike() -> None:
        if stack and stack[-1].in_row and stack[-1].row is not None:
            stack[-1].row["deleted"] = True

    def column() -> None:
        if stack and stack[-1].row is None and stack[-1].cell is None:
            stack[-1].columns = (stack[-1].columns or 0) + 1

    try:
        for kind, name, raw in X.tokens(data):
            if kind == X.START:
                own = top()
                if name in DELETED:
                    strike()
                    deleted += 1
                elif name == "tbl":
                    stack.append(_Table())
                elif name == "gridCol":
                    column()
                elif name in PROPERTIES:
                    _property(own, name, raw, path, found)
                elif name == "p":
                    if own is not None and own.cell is not None:
                        paragraph = []
                elif name == "t":
                    in_t = in_t or (not deleted and paragraph is not None)
                elif own is not None:
                    if name == "tr":
                        own.row = {"grid_before": 0, "grid_after": 0, "deleted": False, "cells": []}
                    elif name == "trPr":
                        own.in_row += 1
                    elif name == "tc":
                        if own.row is not None:
                            own.cell = {"grid_span": 1, "vertical_merge": "none", "blocks": []}
                    elif name == "tcPr":
                        own.in_cell += 1
            elif kind == X.EMPTY:
                if deleted:
                    continue
                if name in DELETED:
                    strike()
                elif name == "gridCol":
                    column()
                elif name in PROPERTIES:
                    _property(top(), name, raw, path, found)
                elif name == "p":
                    block("")
                elif paragraph is not None:
                    if name == "tab":
                        paragraph.append("\t")
                    elif name in ("br", "cr"):
                        paragraph.append("\n")
            elif kind == X.END:
                own = top()
                if name == "t":
                    in_t = False
                elif name in DELETED:
                    deleted, in_t = max(0, deleted - 1), False
                elif name == "p":
                    if paragraph is not None:
                        block("".join(paragraph))
                    paragraph = None
                elif own is None:
                    continue
                elif name == "tcPr":
                    own.in_cell = max(0, own.in_cell - 1)
                elif name == "tc":
                    own.end_cell()
                elif name == "trPr":
                    own.in_row = max(0, own.in_row - 1)
                elif name == "tr":
                    own.end_row()
                elif name == "tbl":
                    whole = stack.pop().done(True)
                    if not block(whole):
                        tables.append(whole)
            elif in_t and not deleted and paragraph is not None:
                paragraph.append(X.decode(raw))
        if stack:
            fault = "unexpected end with open table"
    except X.XmlFault as e:
        fault = e
    if fault is not None:
        found.append(E.malformed(path, fault))
        if stack and stack[0].rows:
            tables.append(stack[0].done(False))
    return tables, found


def _parts(archive: Archive, read) -> tuple[list[tuple[str, str, object]], list[dict]]:
    """(part type, path, read's value) of the main part and of the related ones in the order of their relationships."""
    main = P.main_part(archive, "docx")
    value, found = read(archive.read(main), main)
    out = [("main", main, value)]
    rels = P.rels_path(main)
    if not archive.has(rels):
        return out, found
    for r in P.relationships(archive.text(rels), rels):
        kind = r.type.rpartition("/")[2] if r.type and "/" in r.type else ""
        if kind not in RELATED:
            continue
        part = P.resolve(P.parent(main), r, rels)
        try:
            value, more = read(archive.read(part), part)
        except E.EngineError as e:
            if e.code != E.MISSING:
                raise
            found.append(E.warning(E.W_OTHER, rels, f"skipped related DOCX text part {part}: missing part"))
            continue
        out.append((kind, part, value))
        found += more
    return out, found


def text(archive: Archive) -> tuple[str, list[dict]]:
    parts, found = _parts(archive, part_text)
    out = ""
    for i, (_, _, t) in enumerate(parts):
        if i and t and out and not out.endswith("\n"):
            out += "\n"
        out += t
    return out, found


def blocks(archive: Archive) -> tuple[list[tuple[str, str, str]], list[dict]]:
    parts, found = _parts(archive, part_text)
    return [p for p in parts if p[2]], found


def tables(archive: Archive) -> tuple[list[dict], list[dict]]:
    """Public trees: every table with its part, ordinals from 1, and where each cell starts in the grid."""
    parts, found = _parts(archive, part_tables)
    return [{"part_type": kind, "part_path": path, "table_ordinal": i, **_public(t)} for kind, path, own in parts for i, t in enumerate(own, 1)], found


def _public(table: dict) -> dict:
    """Without recursion: tables may be nested deeper than calls can be."""
    out: dict = {}
    todo = [(table, out)]
    while todo:
        table, into = todo.pop()
        rows = []
        for i, row in enumerate(table["rows"], 1):
            at, cells = row["grid_before"], []
            for j, cell in enumerate(row["cells"], 1):
                own = []
                for b in cell["blocks"]:
                    own.append({"type": "paragraph", "text": b} if isinstance(b, str) else {"type": "table"})
                    if not isinstance(b, str):
                        todo.append((b, own[-1]))
                cells.append({"cell_ordinal": j, "grid_start": at, "grid_span": cell["grid_span"], "vertical_merge": cell["vertical_merge"], "complete": True, "blocks": own})
                at += cell["grid_span"]
            rows.append({"row_ordinal": i, "grid_before": row["grid_before"], "grid_after": row["grid_after"], "complete": True, "cells": cells})
        counted = {} if table["grid_column_count"] is None else {"grid_column_count": table["grid_column_count"]}
        into |= {"complete": table["complete"], **counted, "rows": rows}
    return out
