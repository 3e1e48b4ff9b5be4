"""The engine's functions: packages in, DataFrames out.

Every function takes packages, a DataFrame with ``path`` and ``content`` (see packages() and from_bytes()), and keeps to one
rule for failures: mode "failfast" raises the first, "dropmalformed" leaves failed packages out, and "permissive" keeps a
row for each with ``error`` set. Recoverable oddities are in ``warnings``.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark import __version__
from foliospark import errors as E
from foliospark.functions import cells as C
from foliospark.operators import shred
from foliospark.sources import folders
from foliospark.sources.archive import Limits

LIMITS = Limits()


def packages(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """Files as packages, from anywhere that Spark reads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return _fewer((reader.option("pathGlobFilter", glob) if glob else reader).load(list(paths)).select("path", "length", "content"))


#: Spark's partitions that a task takes at most where files are small, and the bytes a task from which they aren't put together.
PUT_TOGETHER, SMALL = 64, 8 << 20


def _fewer(files: DataFrame) -> DataFrame:
    """Files without a task for each few: Spark counts a file as 4 MB at least, which makes a task of 32 small ones, and starting it takes longer than they do."""
    n, size = files.rdd.getNumPartitions(), int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not n or size // n >= SMALL:
        return files
    fewer = max(4 * files.sparkSession.sparkContext.defaultParallelism, size // (4 * SMALL), n // PUT_TOGETHER)
    return files.coalesce(fewer) if fewer < n else files


def from_bytes(spark: SparkSession, items: Iterable[tuple[str, bytes]]) -> DataFrame:
    """Named bytes as packages, such as those from a pipe, which go by <stdin>."""
    return spark.createDataFrame([(n, len(b), bytearray(b)) for n, b in items], "path string, length bigint, content binary")


def detect_type(pk: DataFrame, limits: Limits = LIMITS, mode: str = "permissive") -> DataFrame:
    """path, document_type (docx, pptx, xlsx or unknown)."""
    return shred.types(pk, limits, mode)


def extract_text(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    """path, document_type, text of documents and presentations."""
    return shred.texts(pk, limits, mode)


def structured_text(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    """path, document_type and blocks, the texts by part in order."""
    return shred.blocks(pk, limits, mode)


def text_blocks(pk: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row a block: path, part_type, part_path, ordinal, text."""
    return structured_text(pk, limits, "failfast").select("path", F.inline("blocks"))


def docx_tables(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast", cells: bool = True) -> DataFrame:
    """path, tables_json (the trees of all tables), n_tables, and with ``cells`` the same, flat."""
    return shred.tables(pk, limits, mode, cells)


def docx_table_cells(pk: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row a table cell, nested ones included, with its grid place and paragraphs."""
    return docx_tables(pk, limits).select("path", F.inline("cells"))


def read_info(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    return shred.infos(pk, limits, mode)


def read_audit(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    """path, document_type, the document's info and its signals in order."""
    return shred.audits(pk, limits, mode)


def audit_signals(pk: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row a signal: path, ord from 1, kind, severity, part_path, message."""
    found = read_audit(pk, limits).select("path", F.posexplode("signals").alias("ord", "s"))
    return found.select("path", (F.col("ord") + 1).alias("ord"), "s.kind", "s.severity", F.col("s.path").alias("part_path"), "s.message")


def relationships(pk: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row a relationship of any .rels part, with the part it leads to or the reason it isn't followed."""
    return shred.relationships(pk, limits, "failfast").select("path", F.inline("relationships"))


def list_sheets(pk: DataFrame, include_hidden: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """One row a sheet: path, index from 1 among those in scope, name, visibility."""
    return shred.sheets(pk, include_hidden, limits, "failfast").select("path", F.inline("sheets"))


def shared_strings(pk: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row a shared string: path, idx from 0, value."""
    return shred.strings(pk, limits, "failfast").select("path", F.posexplode("strings").alias("idx", "value"))


def scan_rows(
    pk: DataFrame,
    sheet: str | None = None,
    all_sheets: bool = False,
    include_hidden: bool = False,
    sheet_index: int | None = None,
    formatted: bool = False,
    max_rows: int | None = None,
    limits: Limits = LIMITS,
    worksheet_limits: Limits | None = None,
    mode: str = "failfast",
) -> DataFrame:
    """The raw scan: worksheet rows, and for each sheet a row without row_ord that has its warnings and error."""
    return shred.rows(pk, sheet, sheet_index, all_sheets, include_hidden, formatted, max_rows, limits, worksheet_limits, mode)


def visit_rows(pk: DataFrame, formatted: bool = False, **options) -> DataFrame:
    """path, sheet_index, sheet_name, row_ord (worksheet order), row_index (from 0) and typed cells, sorted by column.

    A cell has column_index, kind (blank, string, boolean, number, error), raw, value, bool_value, formatted and has_formula.
    """
    rows = scan_rows(pk, formatted=formatted, **options).where("row_ord is not null")
    return rows.select("path", "sheet_index", "sheet_name", "row_ord", "row_index", _typed_cells(formatted).alias("cells"))


def _typed_cells(formatted: bool) -> Column:
    shown = C.formatted if formatted else lambda c, d: F.lit(None).cast("string")
    return F.transform(
        "cells",
        lambda c: F.struct(c["column_index"].alias("column_index"), c["kind"].alias("kind"), c["raw"].alias("raw"), c["value"].alias("value"), c["bool_value"].alias("bool_value"), shown(c, F.col("date1904")).alias("formatted"), c["has_formula"].alias("has_formula")),
    )


def for_each_row(pk: DataFrame, callback: Callable[[Row], bool | None], formatted: bool = False, **options) -> int:
    """Calls back with each worksheet row, in order, until it gives False; the number of calls.

    Packages are parted by path, one to a partition, so that nothing is sorted and the first call waits for the first package alone; rows come
    to the driver a partition at a time.
    """
    n = 0
    for row in visit_rows(_by_path(pk), formatted, **options).toLocalIterator():
        n += 1
        if callback(row) is False:
            break
    return n


def _by_path(pk: DataFrame) -> DataFrame:
    """Packages in the order of their paths: their contents are exchanged once, their rows never."""
    return pk.repartitionByRange(max(1, min(10_000, pk.select("path").count())), "path").sortWithinPartitions("path")


def cells(pk: DataFrame, formatted: bool = False, **options) -> DataFrame:
    """One row a cell."""
    return visit_rows(pk, formatted, **options).select("path", "sheet_index", "sheet_name", "row_ord", "row_index", F.inline("cells"))


def row_warnings(pk: DataFrame, formatted: bool = False, **options) -> DataFrame:
    """One row a warning of the scan, in order: path, sheet_index, ord, category, code, part_path, message."""
    found = scan_rows(pk, formatted=formatted, **options).where("row_ord is null")
    return found.select("path", "sheet_index", F.posexplode("warnings").alias("ord", "w")).select("path", "sheet_index", "ord", "w.category", "w.code", F.col("w.path").alias("part_path"), "w.message")


def parse_delimiter(text: str) -> str:
    own = {"\\t": "\t", "\\n": "\n"}.get(text, text)
    if len(own.encode()) != 1:
        raise E.EngineError(E.ARGUMENT, "invalid argument: delimiter must be exactly one byte")
    return own


def csv_lines(pk: DataFrame, delimiter: str = ",", formatted: bool = False, **options) -> DataFrame:
    """path, sheet_index, sheet_name, row_ord and line: worksheet rows as CSV, without a shuffle."""
    own = parse_delimiter(delimiter)
    rows = scan_rows(pk, formatted=formatted, **options).where("row_ord is not null")
    return rows.select("path", "sheet_index", "sheet_name", "row_ord", C.csv_line(F.col("cells"), F.col("date1904"), own, formatted).alias("line"))


def rows_jsonl(pk: DataFrame, sheet: str | None = None, formatted: bool = False, sheet_index: int | None = None, **options) -> DataFrame:
    """path, row_ord and one JSON line a worksheet row; selectors are echoed if they were given."""
    rows = visit_rows(pk, formatted, sheet=sheet, sheet_index=sheet_index, **options)

    def one(c: Column) -> Column:
        head = F.concat(F.lit('{"column_index":'), c["column_index"].cast("string"), F.lit(',"kind":"'), c["kind"], F.lit('"'))
        text = lambda name, v: F.when(v.isNull(), "").otherwise(F.concat(F.lit(f',"{name}":'), _json_text(v)))
        value = F.when(c["kind"] == "boolean", F.when(c["bool_value"].isNull(), "").otherwise(F.concat(F.lit(',"value":'), c["bool_value"].cast("string")))).otherwise(text("value", c["value"]))
        return F.concat(head, text("raw", c["raw"]), value, text("formatted", c["formatted"]), F.lit(',"has_formula":'), c["has_formula"].cast("string"), F.lit("}"))

    selector = (f',"sheet_name":{json.dumps(sheet, ensure_ascii=False)}' if sheet is not None else "") + (f',"sheet_index":{sheet_index}' if sheet_index is not None else "")
    line = F.concat(F.lit('{"schema_version":1,"file":'), _json_text(F.col("path")), F.lit(f'{selector},"row_index":'), F.col("row_index").cast("string"), F.lit(',"cells":['), F.array_join(F.transform("cells", one), ","), F.lit("]}"))
    return rows.select("path", "sheet_index", "row_ord", line.alias("value"))


def _json_text(c: Column) -> Column:
    """A JSON string literal; a plain text is itself between quotes."""
    return F.when(c.rlike(r"^[ !#-\[\]-~]*\z"), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


#: Why a cell fell back to utf8.
_REASONS = ("invalid numeric encoding", "invalid boolean encoding", "worksheet error value")
TYPES = tuple("null bool int64 float64 date time datetime utf8".split())
_SHAPE = {"datetime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "date": r"^\d{4}-\d{2}-\d{2}$", "time": r"^\d{2}:\d{2}:\d{2}$"}


def _inferred(c: Column) -> Column:
    """struct(type, reason) of a cell; the reason says why it fell back to utf8."""

    def of(kind: str, reason: str | None = None) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(reason).cast("string").alias("reason"))

    number = F.when(F.lit(False), of("null"))
    for kind, shape in _SHAPE.items():
        number = number.when(c["formatted"].rlike(shape), of(kind))
    number = number.when(C.to_long(c["raw"]).isNotNull(), of("int64")).when(C.to_double(c["raw"]).isNotNull(), of("float64")).otherwise(of("utf8", "invalid numeric encoding"))
    return (
        F.when(c["kind"] == "blank", of("null"))
        .when(c["kind"] == "string", of("utf8"))
        .when(c["kind"] == "boolean", F.when(c["bool_value"].isNull(), of("utf8", "invalid boolean encoding")).otherwise(of("bool")))
        .when(c["kind"] == "error", of("utf8", "worksheet error value"))
        .otherwise(number)
    )


def infer_schema(pk: DataFrame, sample_rows: int | None = None, **options) -> DataFrame:
    """One row a column of each selected sheet: its promoted type, whether it is nullable, the types seen in order, and warnings.

    Each package is read once. Cells are reduced to one row a column and type, with the first row of each, before anything is
    exchanged, so the aggregation moves a few rows a partition whatever the sheets' length. Columns up to the widest row are listed.
    """
    if sample_rows is not None and sample_rows < 1:
        raise E.EngineError(E.ARGUMENT, "invalid argument: sample rows must be 1 or greater")
    rows = visit_rows(pk, True, max_rows=sample_rows, **options)
    key = ["path", "sheet_index", "sheet_name"]
    last = F.coalesce(F.get("cells", F.size("cells") - 1)["column_index"], F.lit(-1))
    filled = F.transform(F.filter("cells", lambda c: c["kind"] != "blank"), lambda c: c["column_index"])
    # A row's entries: its cells that have a value; its columns without one; and, under -2 - its last column, where it ends.
    kind = "struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.schema["cells"].dataType.elementType.fields) + ">"
    bare = lambda column, what: F.struct(column.cast("int").alias("column_index"), F.lit(what).alias("what"), F.lit(None).cast(kind).alias("cell"))
    of_cells = F.transform(F.filter("cells", lambda c: c["kind"] != "blank"), lambda c: F.struct(c["column_index"].alias("column_index"), F.lit("cell").alias("what"), c.alias("cell")))
    holes = F.when(F.size(filled) <= last, F.transform(F.array_except(F.sequence(F.lit(0), last), filled), lambda i: bare(i, "null"))).otherwise(F.slice(F.array(bare(F.lit(0), "null")), 1, 0))
    each = rows.select(*key, "row_ord", "row_index", F.inline(F.concat(of_cells, holes, F.array(bare(F.lit(-2) - last, "end")))))
    each = each.select(*key, "row_ord", "row_index", "column_index", "what", F.when(F.col("what") == "cell", _inferred(F.col("cell"))).alias("t"))
    each = each.select(*key, "row_ord", "row_index", "column_index", F.coalesce("t.type", "what").alias("type"), F.col("t.reason").alias("reason")).where("type != 'cell'")
    code = F.array_position(F.array(*map(F.lit, _REASONS)), F.col("reason")).cast("int")
    lapse = F.when(F.col("reason").isNotNull(), F.col("row_ord"))
    seen = each.groupBy(*key, "column_index", "type").agg(
        F.min("row_ord").alias("row_ord"), F.min_by("row_index", "row_ord").alias("row_index"), F.count("*").alias("n"), F.min(lapse).alias("lapse_ord"), F.min_by("row_index", lapse).alias("lapse_index"), F.min_by(code, lapse).alias("lapse")
    )
    fallback = F.min(F.when(F.col("lapse").isNotNull(), F.struct(F.col("lapse_ord").alias("row_ord"), F.col("lapse_index").alias("row_index"), F.get(F.array(*map(F.lit, _REASONS)), F.col("lapse") - 1).alias("reason"))))
    valued = ~F.col("type").isin("null", "end")
    by_column = seen.groupBy(*key, "column_index").agg(
        F.array_sort(F.collect_list(F.when(valued, F.struct("row_ord", "row_index", "type")))).alias("types"), fallback.alias("fallback"), F.min(F.when(F.col("type") == "null", F.col("row_ord"))).alias("gap"),
        F.max(F.when(F.col("type") == "end", F.struct((F.lit(-2) - F.col("column_index")).alias("last"), "row_ord", "n"))).alias("end"),
    )
    # Where rows end is known by sheet: a row that ends before a column has no value there.
    sheet = Window.partitionBy(*key)
    joined = by_column.withColumn("ends", F.collect_list("end").over(sheet)).where("column_index >= 0")
    joined = joined.withColumn("examined_rows", F.aggregate(F.filter("ends", lambda e: e["last"] >= -1), F.lit(0).cast("bigint"), lambda a, e: a + e["n"]))
    short = F.array_min(F.transform(F.filter("ends", lambda e: e["last"] < F.col("column_index")), lambda e: e["row_ord"]))
    hole = F.least("gap", short)
    none = F.when(hole.isNotNull(), F.array(F.struct(hole.alias("row_ord"), F.lit(None).cast("bigint").alias("row_index"), F.lit("null").alias("type")))).otherwise(F.array().cast("array<struct<row_ord: bigint, row_index: bigint, type: string>>"))
    types = F.col("types")
    observed = F.transform(F.array_sort(F.concat(types, none)), lambda t: t["type"])
    names = F.transform(types, lambda t: t["type"])

    def promote(a: Column, t: Column) -> Column:
        numeric = a.isin("int64", "float64") & t.isin("int64", "float64")
        return F.when((a == "null") | (a == t), t).when(numeric, "float64").otherwise("utf8")

    final = F.aggregate(names, F.lit("null"), promote)
    # A conflict is the first type that makes utf8 of columns that weren't, after promotion so far.
    steps = F.aggregate(
        types,
        F.struct(F.lit("null").alias("now"), F.lit(None).cast("struct<row_ord: bigint, row_index: bigint, before: string, after: string>").alias("hit")),
        lambda a, t: F.struct(
            promote(a["now"], t["type"]).alias("now"),
            F.when(
                a["hit"].isNull() & (a["now"] != "null") & (a["now"] != t["type"]) & ~(a["now"].isin("int64", "float64") & t["type"].isin("int64", "float64")),
                F.struct(t["row_ord"].alias("row_ord"), t["row_index"].alias("row_index"), a["now"].alias("before"), t["type"].alias("after")),
            )
            .otherwise(a["hit"])
            .alias("hit"),
        ),
    )["hit"]
    label = C.column_name(F.col("column_index"))
    def warning(code: str, row_ord: Column, message: Column) -> Column:
        return F.struct(row_ord.cast("bigint").alias("row_ord"), F.lit(code).alias("code"), message.alias("message"))

    fallback = F.concat(label, F.lit(": "), F.col("fallback.reason"), F.lit(" at worksheet row "), F.col("fallback.row_index").cast("string"), F.lit("; inferred utf8"))
    conflict = F.concat(label, F.lit(": observed "), steps["after"], F.lit(" after "), steps["before"], F.lit(" at worksheet row "), steps["row_index"].cast("string"), F.lit("; promoted to utf8"))
    warned = F.array_compact(F.array(F.when(F.col("fallback").isNotNull(), warning("utf8_fallback", F.col("fallback.row_ord"), fallback)), F.when(steps.isNotNull(), warning("type_conflict", steps["row_ord"], conflict))))
    return joined.select(*key, "column_index", label.alias("column"), final.alias("type"), hole.isNotNull().alias("nullable"), observed.alias("observed_types"), "examined_rows", warned.alias("warnings"))


def schema_report(pk: DataFrame, sample_rows: int | None = None, sheet: str | None = None, **options) -> DataFrame:
    """path, sheet_index and the inference report of each selected sheet as JSON."""
    own = infer_schema(pk, sample_rows, sheet=sheet, **options)
    column = F.struct("column_index", F.col("column").alias("name"), F.col("type").alias("logical_type"), "nullable", "observed_types")
    by = own.groupBy("path", "sheet_index").agg(
        F.max("examined_rows").alias("examined_rows"),
        F.array_sort(F.collect_list(column)).alias("columns"),
        F.array_sort(F.flatten(F.collect_list(F.transform("warnings", lambda w: F.struct(w["row_ord"].alias("row_ord"), F.col("column_index").alias("column_index"), (w["code"] == "type_conflict").alias("later"), w["code"].alias("code"), w["message"].alias("message")))))).alias("found"),
    )
    found = F.transform("found", lambda w: F.struct(w["code"].alias("code"), w["message"].alias("message"), w["column_index"].alias("column_index")))
    if sample_rows is not None:
        sampled = F.struct(F.lit("sampled_result").alias("code"), F.lit("schema inference used a row sample; results are approximate").alias("message"), F.lit(None).cast("int").alias("column_index"))
        found = F.concat(found, F.array(sampled))
    scan = F.struct(F.lit("full" if sample_rows is None else "sampled").alias("mode"), F.lit(sample_rows).cast("int").alias("sample_rows"), "examined_rows")
    chosen = [F.lit(sheet).cast("string").alias("sheet_name"), F.lit(options.get("sheet_index")).cast("int").alias("sheet_index")]
    report = F.struct(F.lit(1).alias("schema_version"), F.lit(True).alias("experimental"), F.col("path").alias("file"), *chosen, scan.alias("scan"), F.lit("none").alias("header_policy"), "columns", found.alias("warnings"))
    return by.select("path", "sheet_index", F.to_json(report).alias("value"))


def _converted(c: Column, kind: str) -> tuple[Column, Column]:
    """The value of a present cell as a type, and what the cell is for a mismatch."""
    number = c["kind"] == "number"
    shown = c["formatted"]
    value = {
        "utf8": F.when(c["kind"] == "string", c["value"]),
        "bool": F.when(c["kind"] == "boolean", c["bool_value"]),
        "int64": F.when(number, C.to_long(c["raw"])),
        "float64": F.when(number, C.to_double(c["raw"])),
        "date": F.when(number & shown.rlike(_SHAPE["date"]), shown.try_cast("date")),
        "time": F.when(number & shown.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), (F.substring(shown, 1, 2).cast("bigint") * 3600 + F.substring(shown, 4, 2).cast("bigint") * 60 + F.substring(shown, 7, 2).cast("bigint")) * 1000000),
        "datetime": F.when(number & shown.rlike(_SHAPE["datetime"]), shown.try_cast("timestamp_ntz")),
        "null": F.lit(None).cast("void"),  # nothing but an absent cell fits
    }[kind]
    actual = F.when((c["kind"] == "boolean") & c["bool_value"].isNull(), "invalid boolean").when(c["kind"] == "error", "worksheet error").when(number & shown.isNotNull(), F.concat(F.lit("number "), shown)).otherwise(c["kind"])
    return value, actual


def _at_column(index: int):
    return lambda c: c["column_index"] == index


def validate_schema(schema: list[tuple[str, int, str, bool]]) -> None:
    """(name, worksheet column from 0, type, nullable) for each column; the order of the checks is part of the contract."""
    if not schema:
        raise E.EngineError(E.ARGUMENT, "invalid argument: schema has no columns")
    seen: set[int] = set()
    for name, index, kind, nullable in schema:
        if not name:
            raise E.EngineError(E.ARGUMENT, "invalid argument: schema column has an empty name")
        if index in seen:
            raise E.EngineError(E.ARGUMENT, f"invalid argument: schema repeats worksheet column {index}")
        seen.add(index)
        if kind not in TYPES:
            raise E.EngineError(E.ARGUMENT, f"invalid argument: unknown type {kind}")
        if kind == "null" and not nullable:
            raise E.EngineError(E.ARGUMENT, f"invalid argument: null column {name} must be nullable")
    if len({n for n, *_ in schema}) < len(schema):
        raise E.EngineError(E.ARGUMENT, "invalid argument: schema repeats a column name")


def typed_table(pk: DataFrame, schema: list[tuple[str, int, str, bool]], on_mismatch: str = "error", **options) -> DataFrame:
    """Worksheet rows as a table with an explicit schema: path, row_ord and its columns; times are microseconds of the day.

    A cell that doesn't fit ends the query with its row, column, name, expected and actual kind, or is null with
    ``on_mismatch="null"``. Narrow: each row is converted where it is read, in sheets of the usual form a whole column at a time.
    """
    validate_schema(schema)
    direct = [(f"c{i}", *rest) for i, (_, *rest) in enumerate(schema)]
    names = ("sheet", "all_sheets", "include_hidden", "sheet_index", "max_rows", "limits", "worksheet_limits", "mode")
    if unknown := set(options) - set(names):
        raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
    o = dict.fromkeys(names) | {"all_sheets": False, "include_hidden": False, "limits": LIMITS, "mode": "failfast"} | options
    scanned = shred.rows(pk, o["sheet"], o["sheet_index"], o["all_sheets"], o["include_hidden"], True, o["max_rows"], o["limits"], o["worksheet_limits"], o["mode"], direct)
    scanned = scanned.where("row_ord is not null").withColumn("cells", _typed_cells(True))
    out = [F.col("path"), F.col("row_ord")]
    for i, (name, index, kind, nullable) in enumerate(schema):
        cell = F.get(F.filter("cells", _at_column(index)), F.lit(0))
        value, actual = _converted(cell, kind)
        absent = cell.isNull() | (cell["kind"] == "blank")
        if on_mismatch == "error":
            said = F.concat(F.lit("cell doesn't fit: row "), F.col("row_index").cast("string"), F.lit(f", column {index}, {name}: expected {kind}, found "), F.when(absent, "null").otherwise(actual))
            bad = F.lit(not nullable) if kind == "null" else F.when(absent, F.lit(not nullable)).otherwise(value.isNull())
            if kind == "null":
                bad = ~absent
            value = F.when(bad, F.raise_error(said).cast(value_type(kind))).otherwise(value)
        value = value.cast(value_type(kind))
        # Of a null column there is nothing: rows that went directly have no cell there.
        if "direct" in scanned.columns and kind != "null":
            value = F.when(F.col("cells").isNull(), F.col(f"direct.c{i}")).otherwise(value)
        out.append(value.alias(name))
    return scanned.select(*out)


def value_type(kind: str) -> str:
    return {"null": "void", "bool": "boolean", "int64": "bigint", "float64": "double", "date": "date", "time": "bigint", "datetime": "timestamp_ntz", "utf8": "string"}[kind]


def write_parquet(pk: DataFrame, schema: list[tuple[str, int, str, bool]], path: str, batch_rows: int = 8192, **options) -> dict[str, int]:
    """A typed table as Parquet with row groups of at most ``batch_rows`` rows; gives the rows and row groups written."""
    if batch_rows < 1:
        raise E.EngineError(E.ARGUMENT, "invalid argument: batch rows must be 1 or greater")
    own = typed_table(pk, schema, **options).drop("path", "row_ord")
    seen = Observation()
    own.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("parquet.block.row.count.limit", batch_rows).parquet(path)
    return {"rows": seen.get["rows"], "row_groups": _row_groups(own.sparkSession, path)}


#: Files whose footers the driver reads by itself, which takes about a millisecond each; more are read by tasks.
FOOTERS = 200


def _footers(system, names: list[str]) -> int:
    """The row groups of Parquet files."""
    import pyarrow.parquet as pq

    n = 0
    for name in names:
        with system.open_input_file(name) as f:
            n += pq.ParquetFile(f).num_row_groups
    return n


def _row_groups(spark: SparkSession, path: str) -> int:
    from pyarrow import fs

    system, at = folders.file_system(path)
    files = [x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.endswith(".parquet")]
    if len(files) <= FOOTERS:
        return _footers(system, files)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def count(batches):
        for b in batches:
            n = sum(_footers(own, [at]) for own, at in map(folders.file_system, b.column("path").to_pylist()))
            yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return found.mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def record_batches(pk: DataFrame, schema: list[tuple[str, int, str, bool]], batch_rows: int = 8192, **options) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``batch_rows`` rows, a package's rows in order; a partition at a time comes to the driver."""
    if batch_rows < 1:
        raise E.EngineError(E.ARGUMENT, "invalid argument: batch rows must be 1 or greater")
    table = typed_table(_by_path(pk), schema, **options)

    def pack(batches):
        import io

        for b in batches:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            yield pa.record_batch([pa.array([out.getvalue()], pa.binary())], names=["data"])

    def arrived() -> Iterator[tuple[str, pa.RecordBatch]]:
        for r in table.drop("row_ord").mapInArrow(pack, "data binary").toLocalIterator():
            for b in pa.ipc.open_stream(r.data):
                begin, paths = 0, b.column("path").to_pylist()
                for i in range(1, b.num_rows + 1):
                    if i == b.num_rows or paths[i] != paths[begin]:
                        yield paths[begin], b.slice(begin, i - begin).drop_columns("path")
                        begin = i

    def batches() -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, n = None, 0
        for path, b in arrived():
            if held and path != at:
                yield _one(held)
                held, n = [], 0
            at = path
            while n + b.num_rows >= batch_rows:
                held.append(b.slice(0, batch_rows - n))
                b = b.slice(batch_rows - n)
                yield _one(held)
                held, n = [], 0
            if b.num_rows:
                held.append(b)
                n += b.num_rows
        if held:
            yield _one(held)

    return batches()


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def visit_batches(pk: DataFrame, schema: list[tuple[str, int, str, bool]], callback: Callable[[pa.RecordBatch], bool | None], batch_rows: int = 8192, **options) -> dict[str, int]:
    """Calls back with each batch until it gives False; gives the rows and batches visited."""
    seen = {"rows": 0, "batches": 0}
    for b in record_batches(pk, schema, batch_rows, **options):
        seen["rows"] += b.num_rows
        seen["batches"] += 1
        if callback(b) is False:
            break
    return seen


def _some(warnings: str = "warnings") -> Column:
    """The warnings, or nothing where there are none."""
    return F.when(F.size(warnings) > 0, F.col(warnings)).alias("warnings")


def text_json(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    own = extract_text(pk, limits, mode)
    return own.select("path", F.to_json(F.struct(F.col("path").alias("file"), "text")).alias("value"))


def text_jsonl(pk: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """path and one JSON line a package: its text or its error, and its warnings if there are any."""
    own = extract_text(pk, limits, "permissive")
    kind = F.coalesce(F.col("document_type"), F.lit("unknown"))
    return own.select("path", F.to_json(F.struct(F.col("path").alias("file"), kind.alias("document_type"), "text", "error", _some())).alias("value"))


def structured_json(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    own = structured_text(pk, limits, mode)
    return own.select("path", F.to_json(F.struct(F.col("path").alias("file"), "document_type", "blocks")).alias("value"))


def tables_json(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    """path and all tables of a document as JSON, with the warnings."""
    own = docx_tables(pk, limits, mode, cells=False)
    head = F.concat(F.lit('{"schema_version":1,"file":'), _json_text(F.col("path")), F.lit(',"document_type":"docx","tables":'))
    return own.select("path", F.concat(head, F.col("tables_json"), F.lit(',"warnings":'), F.to_json(F.coalesce("warnings", F.from_json(F.lit("[]"), f"array<{E.WARNING_TYPE}>"))), F.lit("}")).alias("value"))


def _metadata(own: DataFrame, *without: str) -> list[Column]:
    return [F.col("path").alias("file"), *(F.col(c) for c in own.columns if c not in ("path", "document_type", "signals", "warnings", "error", *without))]


def info_json(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    own = read_info(pk, limits, mode)
    return own.select("path", info_json_of(own).alias("value"))


def info_json_of(own: DataFrame) -> Column:
    """What info_json gives, for each row of read_info: several forms can be had of one scan."""
    return F.to_json(F.struct(F.lit(__version__).alias("engine_version"), *_metadata(own)))


def info_lines_of(own: DataFrame) -> Column:
    """The lines of info_text, for each row of read_info."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in ((c, F.col(c)) for c in own.columns if c not in ("path", "custom_properties", "warnings", "error"))]
    return F.array_compact(F.array(F.concat(F.lit("file: "), "path"), *lines))


def info_text(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    """One line a known field of a package, but for custom properties."""
    own = read_info(pk, limits, mode)
    return own.select("path", F.explode(info_lines_of(own)).alias("line"))


def audit_json(pk: DataFrame, limits: Limits = LIMITS, mode: str = "failfast") -> DataFrame:
    """path and one JSON document a package: document type, metadata and signals."""
    own = read_audit(pk, limits, mode)
    return own.select("path", audit_json_of(own).alias("value"))


def _audit(own: DataFrame) -> list[Column]:
    return [F.col("path").alias("file"), F.col("document_type"), F.struct(*_metadata(own)).alias("metadata"), F.col("signals")]


def audit_json_of(own: DataFrame) -> Column:
    """What audit_json gives, for each row of read_audit: several forms can be had of one scan."""
    return F.to_json(F.struct(F.lit(__version__).alias("engine_version"), *_audit(own)))


def audit_jsonl(pk: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """path and one JSON line a package: its audit or its error, and its warnings if there are any."""
    own = read_audit(pk, limits, "permissive")
    return own.select("path", audit_line_of(own).alias("value"))


def audit_line_of(own: DataFrame) -> Column:
    """The line of audit_jsonl, for each row of read_audit."""
    audit = F.struct(F.lit(__version__).alias("engine_version"), *_audit(own))
    kind = F.coalesce("document_type", F.lit("unknown"))
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("path").alias("file"), kind.alias("document_type"), F.when(F.col("error").isNull(), audit).alias("audit"), "error", _some()))


def audit_text(pk: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The number of a package's signals, then a line each."""
    return read_audit(pk, limits).select("path", F.explode(audit_lines_of()).alias("line"))


def audit_lines_of() -> Column:
    """The lines of audit_text, for each row of read_audit."""
    lines = F.transform("signals", lambda s: F.concat(F.lit("- "), s["severity"], F.lit(" "), s["kind"], F.lit(" "), s["path"], F.lit(": "), s["message"]))
    return F.concat(F.array(F.concat(F.lit("signal_count: "), F.size("signals").cast("string"))), lines)


def joined_text(pk: DataFrame, order: list[str] | None = None, limits: Limits = LIMITS) -> str:
    """All texts as one, each after the first behind a line of three hyphens; a report for the driver, of a few packages."""
    own = {r.path: r.text for r in extract_text(pk, limits, "dropmalformed").select("path", "text").toLocalIterator()}
    texts = [own[p] for p in (order or sorted(own)) if p in own]
    if not texts:
        raise E.EngineError(E.ARGUMENT, "invalid argument: no input could be read")
    return "\n---\n".join(texts)


def warning_lines(found: Iterable[Row | dict], form: str = "text") -> list[str]:
    """Warnings for a reader: as lines of text, as JSON lines, or (none) not at all."""
    if form == "none":
        return []
    if form == "json":
        return [json.dumps({k: w[k] for k in ("category", "code", "path", "message")}, ensure_ascii=False, separators=(",", ":")) for w in found]
    return [f"warning[{w['category']}/{w['code']}]: {w['path']}: {w['message']}" for w in found]


def skipped(path: str, error: Row | dict) -> dict:
    """The warning for an input that a batch leaves out."""
    return E.warning(E.W_SKIPPED, path, f"skipped after error[{error['code']}]: {error['message']}")


def sheet_list_text(pk: DataFrame, include_hidden: bool = False) -> DataFrame:
    """path, index and a line such as ``2: Notes`` or, with hidden ones, ``2: Notes (hidden)``."""
    line = F.format_string("%d: %s", "index", "name") if not include_hidden else F.format_string("%d: %s (%s)", "index", "name", "visibility")
    return list_sheets(pk, include_hidden).select("path", "index", line.alias("line"))


def export_all_sheets(pk: DataFrame, folder: str, delimiter: str = ",", formatted: bool = False, include_hidden: bool = False, flat: bool = False) -> DataFrame:
    """Writes a CSV file for each sheet of each package, in a folder of the package below ``folder``, and its manifest beside them.

    ``folder`` is one that all tasks share, a path or a URI. A package's folder has the name of its file and a hash of its whole path, so
    packages of one name keep apart; ``flat``, for one package, writes into ``folder`` itself. A sheet's file is written by the task
    that reads it, row by row, and takes its name when it is done; a sheet that fails keeps the rows before. Gives a row a sheet: path,
    index, name, visibility, csv_path, warnings, error; a package that can't be read has one without a sheet. Nothing but that table,
    which is written to the shared folder, comes of the tasks: no row goes through the driver.
    """
    own = parse_delimiter(delimiter)
    scanned = scan_rows(pk, all_sheets=True, include_hidden=include_hidden, formatted=formatted, mode="permissive")
    line = F.when(F.col("row_ord").isNotNull(), C.csv_line(F.col("cells"), F.col("date1904"), own, formatted))
    lines = scanned.select("path", "sheet_index", "sheet_name", C.slug(F.col("sheet_name")).alias("slug"), line.alias("line"), F.to_json(F.struct("warnings", "error")).alias("status"), "visibility")
    names = ["path", "index", "name", "visibility", "csv_path", "status"]

    def write(batches):
        import pandas as pd

        system, base = folders.file_system(folder)

        def folder_of(path: str) -> str:
            where = base if flat else f"{base}/{package_folder(path)}"
            system.create_dir(where, recursive=True)
            return where

        def manifest(rows: list[tuple]) -> None:
            """Of one package, whose rows follow each other."""
            sheets = []
            for path, index, name, visibility, csv_path, status in rows:
                found = json.loads(status)
                own = {"index": index, "name": name, "visibility": visibility, "csv_path": csv_path, "warnings": found.get("warnings") or [], "error": found.get("error")}
                sheets += [{k: v for k, v in own.items() if v is not None}] if index is not None else []
            out = folders.Replacing(system, f"{folder_of(rows[0][0])}/manifest.json")
            out.write(json.dumps({"engine_version": __version__, "file": rows[0][0], "sheets": sheets}, ensure_ascii=False, indent=2).encode())
            out.done()

        target, at, held = None, None, []
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                if held and held[0][0] != r.path:
                    manifest(held)
                    done, held = done + held, []
                if pd.isna(r.sheet_index):
                    held.append((r.path, None, None, None, None, r.status))
                    continue
                key = (r.path, int(r.sheet_index))
                if key != at:
                    name, at = f"{key[1]:03d}-{r.slug}.csv", key
                    target = folders.Replacing(system, f"{folder_of(r.path)}/{name}")
                if r.line is not None:
                    target.write(f"{r.line}\n".encode())
                else:
                    target.done()
                    held.append((r.path, key[1], r.sheet_name, r.visibility, name, r.status))
                    target = at = None
            yield pd.DataFrame(done, columns=names)
        if held:
            manifest(held)
            yield pd.DataFrame(held, columns=names)

    found = lines.mapInPandas(write, "path string, index int, name string, visibility string, csv_path string, status string")
    state = F.from_json("status", f"struct<warnings: array<{E.WARNING_TYPE}>, error: {E.ERROR_TYPE}>")
    found = found.select("path", "index", "name", "visibility", "csv_path", F.coalesce(state["warnings"], F.array().cast(f"array<{E.WARNING_TYPE}>")).alias("warnings"), state["error"].alias("error"))
    where = f"{folders.shared_folder(pk.sparkSession)}/exported-{uuid.uuid4().hex}"
    found.write.parquet(where)  # the exporting happens here, and once
    return pk.sparkSession.read.schema(found.schema).parquet(where)


def package_folder(path: str) -> str:
    """The folder of a package's exports: the stem of its file and eight digits of its whole path's hash."""
    return f"{Path(re.sub(r'^[a-z0-9]+:/*', '/', path)).stem}-{hashlib.sha256(path.encode()).hexdigest()[:8]}"
