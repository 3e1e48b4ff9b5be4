"""Worksheets: typing, sparse rows, formats, selection, CSV, inference and conversion."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark import api
from foliospark import errors as E
from foliospark.functions import cells as C
from foliospark.operators import xlsx
from foliospark.plans import forge as G
from foliospark.sources.archive import Archive, Limits


def rows(sheet_data, strings=("zero", "one"), formats=None):
    reader = xlsx.SheetReader("s", list(strings), formats)
    return [(i, dict(c)) for i, c in reader.rows(f"<worksheet><sheetData>{sheet_data}</sheetData></worksheet>".encode())], reader.warnings


def test_cell_types():
    cells = [(None, "1.50"), ("s", 1), ("b", 1), ("b", "maybe"), ("str", "s", None, "X"), ("inlineStr", "ab"), ("e", "#N/A"), (None, None), ("d", "2020-01-01"), ("s", 9), ("s", "x")]
    body = "".join(G.cell(3, i, *c) for i, c in enumerate(cells)).replace(">ab</t>", "></t><r><t>a</t></r><r><t>b</t></r>")
    got, found = rows(f'<row r="3">{body}</row>')
    assert got[0][0] == 2
    own = [(c.kind, c.raw, c.value, c.boolean, c.formula) for c in got[0][1].values()]
    assert own == [
        ("number", "1.50", None, None, False), ("string", "1", "one", None, False), ("boolean", "1", None, True, False), ("boolean", "maybe", None, None, False), ("string", "s", "s", None, True), ("string", "ab", "ab", None, False),
        ("error", "#N/A", None, None, False), ("blank", None, None, None, False), ("number", "2020-01-01", None, None, False), ("string", "9", "", None, False), ("string", "x", "x", None, False),
    ]
    assert [w["code"] for w in found] == [E.W_BOUNDS, E.W_INDEX]


def test_rows_and_columns_without_references():
    c = lambda v, r="": f"<c{f' r={chr(39)}{r}{chr(39)}' if r else ''}><v>{v}</v></c>"
    body = f'<row>{c(1)}{c(2, "D1")}{c(3)}{c(4, "B1")}{c(5, "B1")}</row><row r="9"/><row/><row r="0">{c(6, 7)}</row>{c("stray")}'
    got, _ = rows(body)
    assert [(i, {k: c.raw for k, c in own.items()}) for i, own in got] == [(0, {0: "1", 1: "5", 3: "2", 4: "3"}), (8, {}), (9, {}), (10, {0: "6"})]


def test_a_malformed_sheet_keeps_complete_rows():
    got, found = rows(f'<row r="1">{G.cell(1, 0, None, 1)}</row><row r="2">{G.cell(2, 0, None, 2)[:-9]}<')
    assert len(got) == 1 and [w["code"] for w in found] == [E.W_XML]


CELL = st.tuples(st.sampled_from(["A", "B", "C", "AA"]), st.sampled_from(["", ' s="1"', ' t="s"', ' t="b"', ' t="str"', ' s="1" t="e"']), st.sampled_from(["<v>1</v>", "<v>0</v>", "<v>a&amp;b</v>", "", "<f>x</f><v>2</v>", "<is><t>q</t></is>", "<v><![CDATA[1]]></v>"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(CELL, max_size=5), max_size=5), st.integers(0, 5), st.sampled_from(["", "\n", "<!-- -->", "<extLst/>"]), st.booleans())
def test_the_fast_way_gives_what_the_tokenizer_does(table, odd, gap, closed):
    body = ""
    for i, cells in enumerate(table, 1):
        own = "".join(f'<c r="{a}{i}"{attrs}>{inner}</c>' for a, attrs, inner in cells)
        body += (gap if i == odd else "") + (f'<row r="{i}" spans="1:3">{own}</row>' if own else f'<row r="{i}"/>')
    data = f"<worksheet><dim/><sheetData>{body}" + ("</sheetData><f><c r='A1'/></f></worksheet>" if closed else "<row r='9'><")
    fast, slow = (xlsx.SheetReader("s", ["zero"], [None, "decimal:1"]) for _ in range(2))
    from foliospark.sources import xml as X

    want = list(slow._general(X.tokens(data.encode()), {"next": 0, "row": None, "cells": {}, "most": -1}))
    assert [(i, list(c.items())) for i, c in fast.rows(data.encode())] == [(i, list(c.items())) for i, c in want]
    assert fast.warnings == slow.warnings
    whole = xlsx.SheetReader("s", ["zero"], [None, "decimal:1"])
    if (found := whole.columns(data.encode())) is not None:
        own, tail = found
        fields = list(zip(own.kind.to_pylist(), own.raw.to_pylist(), own.value.to_pylist(), own.boolean.to_pylist(), own.format.to_pylist(), own.formula.to_pylist(), strict=True))
        got = [(int(i), [(int(own.column[j]), xlsx.Cell(*fields[j])) for j in range(a, z)]) for i, a, z in zip(own.index, own.offsets, own.offsets[1:], strict=False)]
        assert got + [(i, list(c.items())) for i, c in tail] == [(i, list(c.items())) for i, c in want] and whole.warnings == slow.warnings


def test_usual_sheets_are_read_by_column():
    lines = [G.cell(i, 0, None, i, 1) + G.cell(i, 1, "s", 0) + G.cell(i, 2, "b", 1) + G.cell(i, 3, "inlineStr", "é x") + G.cell(i, 4, None, None) + G.cell(i, 27, "e", "#N/A", formula="A1") for i in range(1, 50)]
    data = G.sheet_xml(lines).encode()
    reader = xlsx.SheetReader("s", ["zero"], [None, "decimal:1"])
    own, tail = reader.columns(data)
    assert tail == [] and own.index.size == 49 and own.column[:6].tolist() == [0, 1, 2, 3, 4, 27]
    assert own.kind[:6].to_pylist() == ["number", "string", "boolean", "string", "blank", "error"] and own.format[0].as_py() == "decimal:1"
    for odd in (b"<v>&amp;</v>", b"<v>9999</v>", b"<v> 1</v>"):
        assert reader.columns(data.replace(b"<v>0</v>", odd, 1)) is None


@pytest.mark.parametrize(
    ("code", "kind"),
    [
        ("General", None), ("0", "decimal:0"), ("#,##0.00", "decimal:2"), ("0.00E+00", None), ("# ?/?", None), ("0.0%", "percent:1"), ('"$"#,##0.00', "currency:2"), ("[$€-407]0.0", "currency:1"), ("yyyy-mm-dd", "date"),
        ("h:mm", "time"), ("mm:ss", "time"), ("m/d/yyyy h:mm", "datetime"), ("mmm", "date"), ('0" h"', "decimal:0"), ("0.0;[Red]-0.0", "decimal:1"), ("\\d0", "decimal:0"), ("_(0_)", "decimal:0"), ("", None),
    ],
)
def test_format_classes(code, kind):
    assert xlsx.classify_format(code) == kind


def book(cells, formats=(), date1904=False):
    return G.workbook([("S", "", G.sheet_xml(["".join(cells)]))], formats=list(formats), date1904=date1904)


def one(spark, data, **options):
    return api.visit_rows(api.from_bytes(spark, [("a.xlsx", data)]), **options)


def test_formatted_values(spark):
    formats = [0, 14, 22, 10, 2, 44, "0.0", 46, 11]
    values = [("44927", 0), ("44927", 1), ("44927.25", 2), ("0.12345", 3), ("42.5", 4), ("9.5", 5), ("-5", 5), ("-0.0001", 4), ("0.9999999", 7), ("1.5", 8), ("60", 1), ("61", 1), ("0", 1), ("59", 1), ("x", 4), (" 7 ", 4), ("1f", 4), ("0.125", 4), ("12.345", 4), ("44927.9999999", 2), ("3", 99)]
    data = book([G.cell(1, i, None, v, s) for i, (v, s) in enumerate(values)], formats)
    got = [c.formatted for c in one(spark, data, formatted=True).first().cells]
    assert got == [
        None, "2023-01-01", "2023-01-01T06:00:00", "12.35%", "42.50", "$9.50", "$-5.00", "0.00", "00:00:00", None, "1900-02-29", "1900-03-01", "1899-12-31", "1900-02-28", None, "7.00", None, "0.12", "12.35", "2023-01-01T00:00:00", None,
    ]
    assert [c.formatted for c in one(spark, book([G.cell(1, 0, None, 0, 1), G.cell(1, 1, None, 60, 1)], formats, True), formatted=True).first().cells] == ["1904-01-01", "1904-03-01"]
    assert all(c.formatted is None for c in one(spark, data).first().cells)
    assert api.csv_lines(api.from_bytes(spark, [("a.xlsx", data)]), formatted=True).first().line.startswith("44927,2023-01-01,2023-01-01T06:00:00,12.35%")


def test_fixed_decimals_are_those_of_exact_rounding(spark):
    rng = random.Random(8)
    values = [(rng.choice([rng.uniform(-1e6, 1e6), rng.randint(-999, 999) / 8, rng.gauss(0, 1)]), d) for _ in range(2000) for d in (0, 1, 2, 4)]
    df = spark.createDataFrame(values, "v double, d int")
    for r in df.select("v", "d", C.fixed(F.col("v"), F.col("d")).alias("got")).collect():
        want = f"{r.v:.{r.d}f}"
        assert r.got == (want[1:] if want.startswith("-") and float(want) == 0 else want)


def test_csv_quotes_pads_and_keeps_rows(spark):
    rows = [G.cell(1, 0, "inlineStr", 'a"b') + G.cell(1, 2, "inlineStr", "c,d"), "", G.cell(3, 16383, None, 1), G.cell(4, 0, "b", 0) + G.cell(4, 1, "b", "odd") + G.cell(4, 2, "e", "#REF!")]
    pk = api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", G.sheet_xml(rows))]))])
    got = [r.line for r in api.csv_lines(pk).orderBy("row_ord").collect()]
    assert got == ['"a""b",,"c,d"', "", "," * 16383 + "1", "FALSE,odd,#REF!"]
    assert api.csv_lines(pk, "\\t").orderBy("row_ord").first().line == '"a""b"\t\tc,d'
    with pytest.raises(E.EngineError):
        api.csv_lines(pk, "ab")


SHEETS = [("Sales Q1", ""), ("Hidden", "hidden"), ("Twice", ""), ("Twice", ""), ("Ops/Q1 🚀", "VERYHIDDEN")]
BOOK = G.workbook([(n, s, G.sheet_xml([G.cell(1, 0, None, i)])) for i, (n, s) in enumerate(SHEETS)])


@pytest.mark.parametrize(
    ("name", "index", "hidden", "want"),
    [(None, None, False, "Sales Q1"), ("Hidden", None, True, "Hidden"), (None, 2, False, "Twice"), (None, 2, True, "Hidden"), ("Hidden", None, False, E.MISSING), ("Twice", None, False, E.ARGUMENT), (None, 0, False, E.ARGUMENT), (None, 9, True, E.MISSING), ("a", 1, False, E.ARGUMENT)],
)
def test_selection(name, index, hidden, want):
    sheets = xlsx.workbook(Archive(BOOK)).sheets
    if want in (E.MISSING, E.ARGUMENT):
        with pytest.raises(E.EngineError) as e:
            xlsx.select(sheets, name, index, hidden)
        assert e.value.code == want
    else:
        assert xlsx.select(sheets, name, index, hidden)[1].name == want


def test_modes_and_limits(spark):
    pk = api.from_bytes(spark, [("a.xlsx", BOOK), ("b.xlsx", b"junk"), ("c.xlsx", G.package("xlsx", {"xl/workbook.xml": "<w/>", "xl/_rels/workbook.xml.rels": "<r/>"}))])
    with pytest.raises(Exception, match="E002|E003"):
        api.visit_rows(pk).collect()
    assert [r.path for r in api.visit_rows(pk, mode="dropmalformed").collect()] == ["a.xlsx"]
    status = api.scan_rows(pk, mode="permissive").where("row_ord is null").orderBy("path").collect()
    assert [(r.path, r.error and r.error.code) for r in status] == [("a.xlsx", None), ("b.xlsx", E.BAD_ZIP), ("c.xlsx", E.MISSING)]
    small = api.scan_rows(pk.where("path = 'a.xlsx'"), worksheet_limits=Limits(max_part_bytes=10), mode="permissive").collect()
    assert [r.error.code for r in small] == [E.TOO_LARGE]
    with pytest.raises(ValueError):
        api.extract_text(pk, mode="perhaps")


def test_all_sheets_with_manifest(spark, tmp_path):
    pk = api.from_bytes(spark, [("dir/book.xlsx", BOOK)])
    got = api.export_all_sheets(pk, str(tmp_path / "out"), include_hidden=True).orderBy("index").collect()
    assert [r.csv_path for r in got] == ["001-sales-q1.csv", "002-hidden.csv", "003-twice.csv", "004-twice.csv", "005-ops-q1.csv"]
    assert (tmp_path / "out" / api.package_folder("dir/book.xlsx") / "005-ops-q1.csv").read_text() == "4\n"
    assert [r.visibility for r in got] == ["visible", "hidden", "visible", "visible", "veryHidden"]
    manifest = json.loads((tmp_path / "out" / api.package_folder("dir/book.xlsx") / "manifest.json").read_text())
    assert manifest["file"] == "dir/book.xlsx" and len(manifest["sheets"]) == 5 and manifest["sheets"][1]["warnings"] == []


def test_inference(spark):
    lines = [
        [(0, None, 1), (1, None, "1.5"), (2, "inlineStr", "x"), (3, "b", 1), (5, None, "44927", 1)],
        [(0, None, 2), (1, None, 3), (2, None, 7), (3, "b", "odd"), (4, "e", "#N/A"), (5, None, "44928", 1)],
        [(0, None, "9" * 30), (2, "inlineStr", "y"), (3, "b", 0), (6, None, None)],
    ]
    xml = G.sheet_xml(["".join(G.cell(i, *c) for c in own) for i, own in enumerate(lines, 1)])
    pk = api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", xml)], formats=[0, 14]))])
    got = {r.column: r for r in api.infer_schema(pk).collect()}
    assert {k: (r.type, r.nullable, list(r.observed_types)) for k, r in got.items()} == {
        "A": ("float64", False, ["int64", "float64"]), "B": ("float64", True, ["float64", "int64", "null"]), "C": ("utf8", False, ["utf8", "int64"]), "D": ("utf8", False, ["bool", "utf8"]),
        "E": ("utf8", True, ["null", "utf8"]), "F": ("date", True, ["date", "null"]), "G": ("null", True, ["null"]),
    }
    said = {k: [w.message for w in r.warnings] for k, r in got.items()}
    assert said["D"] == ["D: invalid boolean encoding at worksheet row 1; inferred utf8", "D: observed utf8 after bool at worksheet row 1; promoted to utf8"]
    assert said["C"] == ["C: observed int64 after utf8 at worksheet row 1; promoted to utf8"] and said["A"] == []
    sampled = {r.column: r.type for r in api.infer_schema(pk, sample_rows=1).collect()}
    assert sampled == {"A": "int64", "B": "float64", "C": "utf8", "D": "bool", "E": "null", "F": "date"}
    report = json.loads(api.schema_report(pk).first().value)
    assert report["header_policy"] == "none" and len(report["columns"]) == 7 and report["scan"] == {"mode": "full", "examined_rows": 3}
    assert [(w["code"], w["column_index"]) for w in report["warnings"]] == [("type_conflict", 2), ("utf8_fallback", 3), ("type_conflict", 3), ("utf8_fallback", 4)]
    assert json.loads(api.schema_report(pk, 1).first().value)["warnings"][-1]["code"] == "sampled_result"


KINDS = st.sampled_from([None, "i", "f", "s", "b", "e", "blank"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(KINDS, max_size=4), min_size=1, max_size=6))
def test_inference_is_the_fold_over_rows(spark, table):
    make = {"i": (None, 5), "f": (None, "2.5"), "s": ("str", "t"), "b": ("b", 1), "e": ("e", "#X"), "blank": (None, None)}
    kind = {"i": "int64", "f": "float64", "s": "utf8", "b": "bool", "e": "utf8", "blank": "null"}
    xml = G.sheet_xml(["".join(G.cell(i, j, *make[k]) for j, k in enumerate(own) if k) for i, own in enumerate(table, 1)])
    got = {r.column_index: (r.type, r.nullable, list(r.observed_types)) for r in api.infer_schema(api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", xml)]))])).collect()}
    width = max((j + 1 for own in table for j, k in enumerate(own) if k), default=0)
    want = {}
    for j in range(width):
        now, seen = "null", []
        for own in table:
            t = kind[own[j]] if j < len(own) and own[j] else "null"
            if t not in seen:
                seen.append(t)
            if t != "null" and now != t:
                now = t if now == "null" else "float64" if {now, t} <= {"int64", "float64"} else "utf8"
        want[j] = (now, "null" in seen, seen)
    assert got == want


def test_conversion_of_all_types(spark, tmp_path):
    own = [G.cell(1, 0, "b", 1), G.cell(1, 1, None, -7), G.cell(1, 2, None, "2.5"), G.cell(1, 3, None, 44927, 1), G.cell(1, 4, None, "0.25", 2), G.cell(1, 5, None, "44927.5", 3), G.cell(1, 6, "str", "text")]
    pk = api.from_bytes(spark, [("a.xlsx", book(own, [0, 14, 45, 22]))])
    schema = [("b", 0, "bool", False), ("i", 1, "int64", False), ("f", 2, "float64", False), ("d", 3, "date", False), ("t", 4, "time", False), ("dt", 5, "datetime", False), ("s", 6, "utf8", False), ("n", 7, "null", True)]
    row = api.typed_table(pk, schema).first()
    assert (row.b, row.i, row.f, str(row.d), row.t, str(row.dt), row.s, row.n) == (True, -7, 2.5, "2023-01-01", 6 * 3600 * 10**6, "2023-01-01 12:00:00", "text", None)
    api.write_parquet(pk, schema[:-1], str(tmp_path / "t"), batch_rows=1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert [b.num_rows for b in api.record_batches(pk, schema[:2], 2)] == [1]
    for name, index, kind in (("x", 6, "int64"), ("x", 0, "utf8"), ("x", 9, "bool"), ("x", 2, "int64"), ("x", 0, "null")):
        with pytest.raises(Exception, match="column"):
            api.typed_table(pk, [(name, index, kind, kind == "null")]).collect()
    assert api.typed_table(pk, [("x", 6, "int64", True)], on_mismatch="null").first().x is None


@pytest.mark.parametrize("schema", [[], [("", 0, "utf8", True)], [("a", 0, "utf8", True), ("b", 0, "utf8", True)], [("a", 0, "null", False)], [("a", 0, "decimal", True)], [("a", 0, "utf8", True), ("a", 1, "utf8", True)]])
def test_bad_schemas(schema):
    with pytest.raises(E.EngineError):
        api.validate_schema(schema)


def test_shared_strings_and_styles():
    assert xlsx.shared_strings(b"<sst><si><t>a</t></si><si/><si><r><t>b</t></r><tab/><r><t>c</t></r><br/></si><si><t>d<") == (["a", "", "b\tc\n"], [xlsx.E.malformed("xl/sharedStrings.xml", xlsx.shared_strings(b"<sst><si><t>a</t></si><si/><si><r><t>b</t></r><tab/><r><t>c</t></r><br/></si><si><t>d<")[1][0]["message"].partition(": ")[2])])
    late = b'<s><cellXfs><xf numFmtId="164"/><xf numFmtId="2"/><xf/></cellXfs><numFmts><numFmt numFmtId="164" formatCode="0.0"/></numFmts></s>'
    assert xlsx.styles(late)[0] == [None, "decimal:2", None]


def test_max_rows_leaves_the_sheet(spark):
    broken = "<worksheet><sheetData>" + "".join(f'<row r="{i}">{G.cell(i, 0, None, i)}</row>' for i in range(1, 6)) + "<"
    pk = api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", broken)]))])
    assert api.visit_rows(pk, max_rows=3).count() == 3 and api.row_warnings(pk, max_rows=3).collect() == []
    assert [r.code for r in api.row_warnings(pk).collect()] == [E.W_XML]
