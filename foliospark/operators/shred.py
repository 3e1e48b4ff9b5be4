"""The one Python stage: packages go in as bytes, typed rows come out of a narrow Arrow pass.

Each scan reads only the parts it needs. A package that fails gives a row with ``error`` set; the modes of the API decide
what becomes of it. Nothing above reads ``content``, and nothing here is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark import errors as E
from foliospark.operators import docx, pptx, properties, sheet_columns, xlsx
from foliospark.sources import package as P
from foliospark.sources.archive import Archive, Limits

#: Worksheet rows of an Arrow batch.
BATCH_ROWS = 2048
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 8 << 20
_S = pa.string()
_WARNINGS = pa.list_(pa.struct([("category", _S), ("code", _S), ("path", _S), ("message", _S)]))
_ERROR = pa.struct([("code", _S), ("message", _S)])
_END = f"warnings array<{E.WARNING_TYPE}>, error {E.ERROR_TYPE}"


def _error(e: Exception) -> dict:
    """An engine's error as it is; any other, which an odd file may bring about, as one of input."""
    return {"code": e.code, "message": e.message} if isinstance(e, E.EngineError) else {"code": E.IO, "message": f"I/O error: {type(e).__name__}: {str(e)[:200]}"}


def _packages(batches) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        path, content = b.column("path"), b.column("content")
        for i in range(b.num_rows):
            if path[i].is_valid:
                yield path[i].as_py(), content[i].as_py() or b""


def _weight(value: object) -> int:
    """About the bytes that a value takes, for how many rows go in a batch."""
    if isinstance(value, str):
        return 50 + len(value)
    if isinstance(value, pa.Array):
        return value.nbytes
    if isinstance(value, dict | list):
        return 100 + sum(map(_weight, value.values() if isinstance(value, dict) else value))
    return 10


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """A column of Python values, or of lists of which some are arrays."""
    if not any(isinstance(v, pa.Array) for v in values):
        return pa.array(values, kind)
    sizes = [0 if v is None else len(v) for v in values]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([v is None for v in values] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.concat_arrays([pa.array([], kind.value_type), *(v if isinstance(v, pa.Array) else pa.array(v, kind.value_type) for v in values if v is not None)]), kind)


def _each(batches, schema: pa.Schema, read: Callable[[str, Archive], dict], limits: Limits, mode: str) -> Iterator[pa.RecordBatch]:
    """One row a package, in batches of some MB. In the lenient modes no package ends the scan, whatever is in it."""

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    def whole(rows: list[dict]) -> pa.RecordBatch | None:
        """The batch; where it can't be made, which a row may be to blame for, without that or with its error."""
        try:
            return made(rows)
        except Exception:
            if mode == "failfast":
                raise
        kept = []
        for row in rows:
            try:
                made([row])
                kept.append(row)
            except Exception as e:
                if mode == "permissive":
                    kept.append({"path": row["path"], "error": _error(e)})
        return made(kept) if kept else None

    rows, size = [], 0
    for path, content in _packages(batches):
        try:
            row = {"path": path, **read(path, Archive(content, limits))}
        except Exception as e:
            if mode == "failfast":
                raise
            if mode == "dropmalformed":
                continue
            row = {"path": path, "error": _error(e)}
        rows.append(row)
        size += _weight(row)
        if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
            if (b := whole(rows)) is not None:
                yield b
            rows, size = [], 0
    if rows and (b := whole(rows)) is not None:
        yield b


def _scan(packages: DataFrame, arrow: list[tuple[str, pa.DataType]], sql: str, read, limits: Limits, mode: str) -> DataFrame:
    if mode not in ("failfast", "dropmalformed", "permissive"):
        raise ValueError(f"mode must be failfast, dropmalformed or permissive, not {mode}")
    schema = pa.schema([("path", _S), *arrow, ("warnings", _WARNINGS), ("error", _ERROR)])

    def run(batches):
        return _each(batches, schema, read, limits, mode)

    return packages.select("path", "content").mapInArrow(run, f"path string, {sql}, {_END}")


def _kind(path: str, archive: Archive) -> str:
    return P.type_for(P.document_type(archive), path)


def types(packages: DataFrame, limits: Limits, mode: str) -> DataFrame:
    return _scan(packages, [("document_type", _S)], "document_type string", lambda path, a: {"document_type": P.document_type(a), "warnings": []}, limits, mode)


def _text_module(kind: str):
    if kind == "xlsx":
        raise E.EngineError(E.ARGUMENT, "invalid argument: text extraction takes DOCX and PPTX; use CSV extraction for XLSX")
    return docx if kind == "docx" else pptx


def texts(packages: DataFrame, limits: Limits, mode: str) -> DataFrame:
    def read(path: str, archive: Archive) -> dict:
        kind = _kind(path, archive)
        text, found = _text_module(kind).text(archive)
        return {"document_type": kind, "text": text, "warnings": found}

    return _scan(packages, [("document_type", _S), ("text", _S)], "document_type string, text string", read, limits, mode)


_BLOCKS = pa.list_(pa.struct([("part_type", _S), ("part_path", _S), ("ordinal", pa.int32()), ("text", _S)]))


def blocks(packages: DataFrame, limits: Limits, mode: str) -> DataFrame:
    def read(path: str, archive: Archive) -> dict:
        kind = _kind(path, archive)
        own, found = _text_module(kind).blocks(archive)
        return {"document_type": kind, "blocks": [{"part_type": t, "part_path": p, "ordinal": i, "text": x} for i, (t, p, x) in enumerate(own, 1)], "warnings": found}

    sql = "document_type string, blocks array<struct<part_type: string, part_path: string, ordinal: int, text: string>>"
    return _scan(packages, [("document_type", _S), ("blocks", _BLOCKS)], sql, read, limits, mode)


_CELL_FIELDS = [
    ("part_ord", pa.int32()), ("part_type", _S), ("part_path", _S), ("table_ordinal", pa.int32()), ("nest", pa.list_(pa.int32())), ("table_complete", pa.bool_()), ("grid_column_count", pa.int32()),
    ("row_ordinal", pa.int32()), ("grid_before", pa.int32()), ("grid_after", pa.int32()), ("cell_ordinal", pa.int32()), ("grid_start", pa.int32()), ("grid_span", pa.int32()), ("vertical_merge", _S),
    ("paragraphs", pa.list_(_S)),
]
_CELL_SQL = (
    "array<struct<part_ord: int, part_type: string, part_path: string, table_ordinal: int, nest: array<int>, table_complete: boolean, grid_column_count: int,"
    " row_ordinal: int, grid_before: int, grid_after: int, cell_ordinal: int, grid_start: int, grid_span: int, vertical_merge: string, paragraphs: array<string>>>"
)


def _flat(table: dict, base: dict) -> Iterator[dict]:
    """The cells of a table and of those within it; nest holds row, cell and place of each table around, in an array that its cells share."""

    def own_cells(table: dict, nest: np.ndarray) -> Iterator[dict | tuple]:
        own = base | {"nest": nest, "table_complete": table["complete"], "grid_column_count": table.get("grid_column_count")}
        for row in table["rows"]:
            for cell in row["cells"]:
                yield own | {k: row[k] for k in ("row_ordinal", "grid_before", "grid_after")} | {k: cell[k] for k in ("cell_ordinal", "grid_start", "grid_span", "vertical_merge")} | {"paragraphs": [b["text"] for b in cell["blocks"] if b["type"] == "paragraph"]}
                for i, b in enumerate(cell["blocks"], 1):
                    if b["type"] == "table":
                        yield b, np.append(nest, np.array([row["row_ordinal"], cell["cell_ordinal"], i], np.int32))

    open_ = [own_cells(table, np.empty(0, np.int32))]
    while open_:
        found = next(open_[-1], None)
        if found is None:
            open_.pop()
        elif isinstance(found, tuple):
            open_.append(own_cells(*found))
        else:
            yield found


def _cells(tables: list[dict]) -> pa.Array:
    """The cells of tables as an array. The nests of deep tables are long, so they go from arrays to an array."""
    parts = {p: i for i, p in enumerate(dict.fromkeys(t["part_path"] for t in tables), 1)}
    cells = [c for t in tables for c in _flat(t, {"part_ord": parts[t["part_path"]], **{k: t[k] for k in ("part_type", "part_path", "table_ordinal")}})]
    nests = [c["nest"] for c in cells]
    offsets = pa.array(np.concatenate([[0], np.cumsum([n.size for n in nests])]), pa.int32())
    nest = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(nests) if nests else [], pa.int32()))
    return pa.StructArray.from_arrays([nest if name == "nest" else pa.array([c[name] for c in cells], kind) for name, kind in _CELL_FIELDS], fields=[pa.field(*f) for f in _CELL_FIELDS])


def _json(value: object) -> str:
    """JSON of trees of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out, todo = [], [(value, True)]
    while todo:
        x, is_value = todo.pop()
        if not is_value:
            out.append(x)
        elif isinstance(x, dict | list):
            pairs = x.items() if isinstance(x, dict) else ((None, v) for v in x)
            parts: list[tuple] = [("{" if isinstance(x, dict) else "[", False)]
            for i, (k, v) in enumerate(pairs):
                parts.append(("," * bool(i) + (json.dumps(k, ensure_ascii=False) + ":" if k is not None else ""), False))
                parts.append((v, True))
            todo.extend(reversed([*parts, ("}" if isinstance(x, dict) else "]", False)]))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def tables(packages: DataFrame, limits: Limits, mode: str, cells: bool = True) -> DataFrame:
    """With ``cells`` the flat form too, which repeats the places of all tables around and so grows as the square of their depth."""

    def read(path: str, archive: Archive) -> dict:
        kind = _kind(path, archive)
        if kind != "docx":
            raise E.EngineError(E.ARGUMENT, f"invalid argument: table extraction takes DOCX, not {kind.upper()}")
        own, found = docx.tables(archive)
        flat = {"cells": _cells(own)} if cells else {}
        return {"tables_json": _json(own), "n_tables": len(own), **flat, "warnings": found}

    arrow = [("tables_json", _S), ("n_tables", pa.int32())] + [("cells", pa.list_(pa.struct(_CELL_FIELDS)))] * cells
    return _scan(packages, arrow, "tables_json string, n_tables int" + f", cells {_CELL_SQL}" * cells, read, limits, mode)


_INFO = [(f, _S) for f in (*properties.CORE.values(), *properties.APP.values())] + [(f, pa.int64()) for f in properties.COUNTS.values()] + [("custom_properties", pa.map_(_S, _S)), ("has_macros", pa.bool_())]
_INFO_SQL = ", ".join([*(f"{f} string" for f in (*properties.CORE.values(), *properties.APP.values())), *(f"{f} bigint" for f in properties.COUNTS.values()), "custom_properties map<string, string>", "has_macros boolean"])


def infos(packages: DataFrame, limits: Limits, mode: str) -> DataFrame:
    def read(path: str, archive: Archive) -> dict:
        own, found = properties.info(archive)
        return {**own, "warnings": found}

    return _scan(packages, _INFO, _INFO_SQL, read, limits, mode)


_SIGNALS = pa.list_(pa.struct([("kind", _S), ("severity", _S), ("path", _S), ("message", _S)]))


def audits(packages: DataFrame, limits: Limits, mode: str) -> DataFrame:
    def read(path: str, archive: Archive) -> dict:
        own, signals, found = properties.audit(archive)
        return {**own, "signals": signals, "warnings": found}

    sql = f"document_type string, {_INFO_SQL}, signals array<struct<kind: string, severity: string, path: string, message: string>>"
    return _scan(packages, [("document_type", _S), *_INFO, ("signals", _SIGNALS)], sql, read, limits, mode)


def relationships(packages: DataFrame, limits: Limits, mode: str) -> DataFrame:
    """All relationships of all .rels parts, with their order and the part they lead to."""
    own_type = pa.list_(pa.struct([("rels_path", _S), ("ord", pa.int32()), ("id", _S), ("target", _S), ("type", _S), ("target_mode", _S), ("part", _S), ("reason", _S)]))

    def read(path: str, archive: Archive) -> dict:
        out, found = [], []
        for rels in sorted(n for n in archive.names() if n.endswith(".rels")):
            try:
                own = P.relationships(archive.text(rels), rels)
            except E.EngineError as e:
                if e.code != E.BAD_XML:
                    raise
                found.append(E.malformed(rels, e.message.partition(": ")[2]))
                continue
            for i, r in enumerate(own):
                part, reason = P.target_part(P.rels_base(rels), r.target, r.mode)
                out.append({"rels_path": rels, "ord": i, "id": r.id, "target": r.target, "type": r.type, "target_mode": r.mode, "part": part, "reason": reason})
        return {"relationships": out, "warnings": found}

    sql = "relationships array<struct<rels_path: string, ord: int, id: string, target: string, type: string, target_mode: string, part: string, reason: string>>"
    return _scan(packages, [("relationships", own_type)], sql, read, limits, mode)


def sheets(packages: DataFrame, include_hidden: bool, limits: Limits, mode: str) -> DataFrame:
    own_type = pa.list_(pa.struct([("index", pa.int32()), ("name", _S), ("visibility", _S)]))

    def read(path: str, archive: Archive) -> dict:
        book = xlsx.workbook(archive)
        return {"sheets": [{"index": i, "name": s.name, "visibility": s.visibility} for i, s in xlsx.in_scope(book.sheets, include_hidden)], "warnings": book.warnings}

    return _scan(packages, [("sheets", own_type)], "sheets array<struct<index: int, name: string, visibility: string>>", read, limits, mode)


def strings(packages: DataFrame, limits: Limits, mode: str) -> DataFrame:
    """The shared strings of workbooks, the build side of the relational lookup."""

    def read(path: str, archive: Archive) -> dict:
        own, found = xlsx.shared_strings(archive.read("xl/sharedStrings.xml")) if archive.has("xl/sharedStrings.xml") else ([], [])
        return {"strings": own, "warnings": found}

    return _scan(packages, [("strings", pa.list_(_S))], "strings array<string>", read, limits, mode)


#: ``shown`` is the number as its format has it where that was found by column; else it is up to ``format``.
_CELL = pa.struct([("column_index", pa.int32()), ("kind", _S), ("raw", _S), ("value", _S), ("bool_value", pa.bool_()), ("format", _S), ("shown", _S), ("has_formula", pa.bool_())])
CELL_SQL = "struct<column_index: int, kind: string, raw: string, value: string, bool_value: boolean, format: string, shown: string, has_formula: boolean>"
ROWS_SQL = f"path string, sheet_index int, sheet_name string, row_ord bigint, row_index bigint, date1904 boolean, cells array<{CELL_SQL}>, {_END}, visibility string"
_ROWS = pa.schema([("path", _S), ("sheet_index", pa.int32()), ("sheet_name", _S), ("row_ord", pa.int64()), ("row_index", pa.int64()), ("date1904", pa.bool_()), ("cells", pa.list_(_CELL)), ("warnings", _WARNINGS), ("error", _ERROR), ("visibility", _S)])


def _row_batch(path: str, index: int, name: str, first: int, date1904: bool, rows: list[tuple[int, dict[int, xlsx.Cell]]]) -> pa.RecordBatch:
    """A batch of worksheet rows, built by column."""
    offsets, columns, cells = [0], [], []
    for _, own in rows:
        columns.extend(own)
        cells.extend(own.values())
        offsets.append(len(columns))
    kinds, raws, values, truths, formats, formulas = zip(*cells, strict=True) if cells else ((),) * 6
    flat = pa.StructArray.from_arrays(
        [pa.array(columns, pa.int32()), pa.array(kinds, _S), pa.array(raws, _S), pa.array(values, _S), pa.array(truths, pa.bool_()), pa.array(formats, _S), pa.nulls(len(cells), _S), pa.array(formulas, pa.bool_())],
        fields=list(_CELL),
    )
    return _rows_of(path, index, name, first, date1904, pa.array([i for i, _ in rows], pa.int64()), pa.array(offsets, pa.int32()), flat)


def _column_batches(path: str, index: int, name: str, date1904: bool, own: sheet_columns.Columns) -> Iterator[pa.RecordBatch]:
    flat = pa.StructArray.from_arrays([pa.array(own.column.astype(np.int32)), own.kind, own.raw, own.value, own.boolean, own.format, sheet_columns.shown(own, date1904), own.formula], fields=list(_CELL))
    for first in range(0, own.index.size, BATCH_ROWS):
        last = min(first + BATCH_ROWS, own.index.size)
        a, z = int(own.offsets[first]), int(own.offsets[last])
        yield _rows_of(path, index, name, first, date1904, pa.array(own.index[first:last]), pa.array((own.offsets[first : last + 1] - a).astype(np.int32)), flat.slice(a, z - a))


def _rows_of(path: str, index: int, name: str, first: int, date1904: bool, row_index: pa.Array, offsets: pa.Array, flat: pa.StructArray) -> pa.RecordBatch:
    n = len(row_index)
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(path, _S), n), pa.repeat(pa.scalar(index, pa.int32()), n), pa.repeat(pa.scalar(name, _S), n),
            pa.array(range(first, first + n), pa.int64()), row_index, pa.repeat(pa.scalar(date1904), n),
            pa.ListArray.from_arrays(offsets, flat), pa.nulls(n, _WARNINGS), pa.nulls(n, _ERROR), pa.nulls(n, _S),
        ],
        schema=_ROWS,
    )


def _direct_batches(path: str, index: int, name: str, date1904: bool, own: sheet_columns.Columns, values: list[pa.Array], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    flat = pa.StructArray.from_arrays(values, fields=list(schema[-1].type))
    for first in range(0, own.index.size, COLUMN_ROWS):
        n = min(COLUMN_ROWS, own.index.size - first)
        yield pa.RecordBatch.from_arrays(
            [
                pa.repeat(pa.scalar(path, _S), n), pa.repeat(pa.scalar(index, pa.int32()), n), pa.repeat(pa.scalar(name, _S), n),
                pa.array(np.arange(first, first + n)), pa.array(own.index[first : first + n]), pa.repeat(pa.scalar(date1904), n),
                pa.nulls(n, pa.list_(_CELL)), pa.nulls(n, _WARNINGS), pa.nulls(n, _ERROR), pa.nulls(n, _S), flat.slice(first, n),
            ],
            schema=schema,
        )


def _status(path: str, index: int | None, name: str | None, found: list[dict], error: dict | None, visibility: str | None = None) -> pa.RecordBatch:
    row = {"path": path, "sheet_index": index, "sheet_name": name, "warnings": found, "error": error, "visibility": visibility}
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) if f.name in row else pa.nulls(1, f.type) for f in _ROWS], schema=_ROWS)


#: Rows of a batch of columns, which are no more than a few arrays.
COLUMN_ROWS = 1 << 15
#: Bytes of a worksheet from which array operations, a few hundred whatever its size, take less than a step for each cell.
SMALL_SHEET = 1 << 13


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches as fewer, of about BATCH_ROWS rows or BATCH_BYTES."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def rows(
    packages: DataFrame, sheet: str | None, sheet_index: int | None, all_sheets: bool, include_hidden: bool, formatted: bool, max_rows: int | None, limits: Limits, worksheet_limits: Limits | None, mode: str,
    direct: list[tuple[str, int, str, bool]] | None = None,
) -> DataFrame:
    """Worksheet rows with their cells, in worksheet order by row_ord; then for each sheet a row without row_ord, for warnings and error.

    A sheet that fails half-way keeps the rows before. With ``max_rows`` the worksheet is left after so many rows. With ``direct``, a
    schema, rows also have ``direct``, a struct of its values; it is set, and cells aren't, in sheets of the usual form of which all cells fit.
    """
    with_direct = bool(direct) and all(kind in sheet_columns.DIRECT for _, _, kind, _ in direct)
    fields = [pa.field(n, sheet_columns.DIRECT[kind][0], True) for n, _, kind, _ in direct] if with_direct else []
    out_schema = pa.schema([*_ROWS, pa.field("direct", pa.struct(fields))]) if with_direct else _ROWS
    if sheet is not None and sheet_index is not None:
        raise E.EngineError(E.ARGUMENT, "invalid argument: select an XLSX sheet by name or index, not both")
    if mode not in ("failfast", "dropmalformed", "permissive"):
        raise ValueError(f"mode must be failfast, dropmalformed or permissive, not {mode}")

    def one(path: str, opened: xlsx.Opened, index: int, own: xlsx.Sheet) -> Iterator[pa.RecordBatch]:
        reader, data = xlsx.sheet_reader(opened, own, worksheet_limits)
        held: list = []
        first = n = 0
        rows = reader.columns(data) if max_rows is None and len(data) >= SMALL_SHEET else None
        if rows is not None:
            found, rows = rows
            values = sheet_columns.values(found, direct, opened.book.date1904) if with_direct else None
            if values is not None:
                yield from _direct_batches(path, index, own.name, opened.book.date1904, found, values, out_schema)
            else:
                yield from _column_batches(path, index, own.name, opened.book.date1904, found)
            first = n = found.index.size
        for row in reader.rows(data) if rows is None else rows:
            held.append(row)
            n += 1
            if len(held) >= BATCH_ROWS:
                yield _row_batch(path, index, own.name, first, opened.book.date1904, held)
                first, held = n, []
            if max_rows is not None and n >= max_rows:
                break
        if held:
            yield _row_batch(path, index, own.name, first, opened.book.date1904, held)
        yield _status(path, index, own.name, opened.warnings + reader.warnings, None, own.visibility)

    def run(batches):
        for path, content in _packages(batches):
            index = name = None
            try:
                opened = xlsx.open_workbook(Archive(content, limits), formatted)
                chosen = xlsx.in_scope(opened.book.sheets, include_hidden) if all_sheets else [xlsx.select(opened.book.sheets, sheet, sheet_index, include_hidden)]
            except Exception as e:
                if mode == "failfast":
                    raise
                if mode == "permissive":
                    yield _status(path, None, None, [], _error(e))
                continue
            for index, own in chosen:
                name = own.name
                try:
                    yield from one(path, opened, index, own)
                except Exception as e:
                    if mode == "failfast":
                        raise
                    if mode == "permissive":
                        yield _status(path, index, name, opened.warnings, _error(e), own.visibility)

    def whole(batches):
        for b in run(batches):
            yield b if b.num_columns == len(out_schema) else pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, out_schema[-1].type)], schema=out_schema)

    if not with_direct:
        return packages.select("path", "content").mapInArrow(lambda batches: _joined(run(batches)), ROWS_SQL)
    kinds = T.StructType([T.StructField(n, T._parse_datatype_string(sheet_columns.DIRECT[kind][1])) for n, _, kind, _ in direct])
    schema = T.StructType([*T._parse_datatype_string(ROWS_SQL).fields, T.StructField("direct", kinds)])
    return packages.select("path", "content").mapInArrow(lambda batches: _joined(whole(batches)), schema)
