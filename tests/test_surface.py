"""Every registered query against its SQL, the JSON forms, streams, SQL names and the command line."""

import json

import duckdb
import pytest

from foliospark import __version__, api
from foliospark.plans import catalog
from foliospark.plans import forge as G

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events", "labels", "pages", "embeddings")


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(catalog.oracle_sql()[name])
    assert sorted(c[0] for c in want.description) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall()))) == sorted(map(str, map(tuple, got.select(*columns).collect())))


def test_no_operator_query_shuffles_where_it_needn_t(spark):
    pk = api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", G.sheet_xml([G.cell(1, 0, None, 1)]))]))])
    for df in (api.csv_lines(pk), api.visit_rows(pk, True), api.rows_jsonl(pk), api.list_sheets(pk), api.read_info(pk), api.typed_table(pk, [("a", 0, "int64", True)])):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_json_forms(spark):
    doc = G.document(G.paragraph("hi"), extra=G.properties({"creator": "A"}, custom={"k": "v"}))
    pk = api.from_bytes(spark, [("a.docx", doc), ("b.docx", b"junk")])
    lines = {r.path: json.loads(r.value) for r in api.text_jsonl(pk).collect()}
    assert lines["a.docx"] == dict(file="a.docx", document_type="docx", text="hi\n")
    assert lines["b.docx"]["error"]["code"] == "E002"
    assert json.loads(api.info_json(pk.where("path = 'a.docx'")).first().value) == dict(engine_version=__version__, file="a.docx", author="A", custom_properties={"k": "v"}, has_macros=False)
    audits = {r.path: json.loads(r.value) for r in api.audit_jsonl(pk).collect()}
    assert audits["a.docx"]["audit"]["signals"][0]["kind"] == "custom_properties" and audits["b.docx"]["error"]["code"] == "E002"
    rows = json.loads(api.rows_jsonl(api.from_bytes(spark, [("q\"x.xlsx", G.workbook([("S", "", G.sheet_xml([G.cell(1, 0, "str", 'a"\n\\') + G.cell(1, 1, "b", 1)]))]))]), sheet="S").first().value)
    own = dict(column_index=0, kind="string", raw='a"\n\\', value='a"\n\\', has_formula=False)
    assert rows == dict(schema_version=1, file='q"x.xlsx', sheet_name="S", row_index=0, cells=[own, dict(column_index=1, kind="boolean", raw="1", value=True, has_formula=False)])
    one = pk.where("path = 'a.docx'")
    assert json.loads(api.structured_json(one).first().value)["blocks"][0]["ordinal"] == 1
    assert json.loads(api.tables_json(one).first().value) == dict(schema_version=1, file="a.docx", document_type="docx", tables=[], warnings=[])
    assert json.loads(api.audit_json(one).first().value)["metadata"]["author"] == "A" and json.loads(api.text_json(one).first().value)["text"] == "hi\n"
    assert [r.line for r in api.audit_text(one).collect()] == ["signal_count: 1", "- info custom_properties docProps/custom.xml: 1 custom document properties are present"]
    assert [r.line for r in api.info_text(one).collect()] == ["file: a.docx", "author: A", "has_macros: false"]
    assert api.joined_text(api.from_bytes(spark, [("1", doc), ("2", doc)])) == "hi\n\n---\nhi\n"
    assert api.relationships(pk.where("path = 'a.docx'")).first().part == "word/document.xml"


def test_text_of_a_workbook_and_tables_of_slides_are_refused(spark):
    pk = api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", G.sheet_xml([]))])), ("b.pptx", G.presentation([("", None)]))])
    assert {r.path: r.error.code for r in api.extract_text(pk, mode="permissive").collect() if r.error} == {"a.xlsx": "E010"}
    assert [r.error.code for r in api.docx_tables(pk, mode="permissive").collect()] == ["E010", "E010"]


def test_streams_land_each_package_once(spark, tmp_path):
    from foliospark.streaming import files

    src = tmp_path / "in"
    src.mkdir()
    for batch in range(2):
        for i in range(3):
            (src / f"{batch}-{i}.docx").write_bytes(G.document(G.paragraph(f"{batch} {i}")))
        files.land(files.packages(spark, str(src), "*.docx"), api.extract_text, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3 * (batch + 1)


def test_sql_names(spark):
    from foliospark.functions import sql

    sql.register(spark)
    assert [r[0] for r in spark.sql("select xl_column_name(i) from values (0), (25), (26), (701), (702), (16383) as t(i)").collect()] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert tuple(spark.sql("select csv_quote('a,b', ','), sheet_slug(' A  b! '), sheet_slug('!')").first()) == ('"a,b"', "a-b", "sheet")
    api.from_bytes(spark, [("a.docx", G.document(G.paragraph("hi"))), ("b", b"x")]).createOrReplaceTempView("pk")
    got = spark.sql("select path, b.text, b.error from pk, lateral ooxml_blocks(path, content) b order by path").collect()
    assert [tuple(r) for r in got] == [("a.docx", "hi\n", None), ("b", None, "E002")]
    api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", G.sheet_xml([G.cell(1, 0, None, 5)]))]))]).createOrReplaceTempView("pk")
    assert spark.sql("select c.raw from pk, lateral xlsx_cells(content) c").first().raw == "5"


@pytest.fixture
def call(spark, tmp_path, capsys):
    """Runs a command in a folder of files: exit code, output, errors."""
    from foliospark.__main__ import main

    sheet = G.sheet_xml([G.cell(1, 0, None, 5, 1) + G.cell(1, 1, "str", "x")])
    files = {
        "a.xlsx": G.workbook([("S", "", sheet), ("T", "hidden", G.sheet_xml([G.cell(1, 0, "s", 7)]))], ["w"], formats=[0, 2]),
        "a.docx": G.document(G.paragraph("hi"), extra=G.properties({"creator": "A"}, custom={"k": "v"})),
        "b.docx": G.document(G.paragraph("ho") + "<w:p></w:x>"),
        "junk.docx": b"junk",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)

    def run(*args):
        code = main([str(tmp_path / x) if x in files or x.startswith("absent") else x for x in args])
        got = capsys.readouterr()
        return code, got.out, got.err

    return run


def test_command_line_of_one_input(call, tmp_path):
    assert call("extract", "csv", "a.xlsx") == (0, "5,x\n", "")
    assert call("extract", "csv", "--value-mode", "formatted", "a.xlsx") == (0, "5.00,x\n", "")
    assert call("extract", "csv", "--list-sheets", "--include-hidden", "a.xlsx") == (0, "1: S (visible)\n2: T (hidden)\n", "")
    code, out, err = call("extract", "csv", "--sheet", "T", "--include-hidden", "a.xlsx")
    assert (code, out) == (0, "\n") and err.startswith("warning[data/W003]: xl/worksheets/sheet2.xml: ")
    assert call("extract", "csv", "--sheet", "T", "--include-hidden", "-q", "a.xlsx")[2] == ""
    assert json.loads(call("--warnings", "json", "extract", "csv", "--sheet", "T", "--include-hidden", "a.xlsx")[2])["code"] == "W003"
    assert call("extract", "text", "a.docx") == (0, "hi\n", "")
    assert json.loads(call("extract", "text", "--format", "json", "a.docx")[1]) == {"file": "a.docx", "text": "hi\n"}
    assert json.loads(call("extract", "text", "--format", "structured-json", "a.docx")[1])["blocks"][0]["text"] == "hi\n"
    out = tmp_path / "out.txt"
    assert call("extract", "text", "-o", str(out), "a.docx")[1] == "" and out.read_text() == "hi\n"
    assert call("extract", "csv", "a.xlsx", "--all-sheets", "--include-hidden", "--output-dir", str(tmp_path / "dir"))[0] == 0
    assert (tmp_path / "dir/001-s.csv").read_text() == "5,x\n" and json.loads((tmp_path / "dir/manifest.json").read_text())["sheets"][1]["warnings"][0]["code"] == "W003"
    assert json.loads(call("info", "a.docx")[1])["author"] == "A" and call("info", "--format", "text", "a.docx")[1].startswith("file: a.docx\nauthor: A\n")
    assert json.loads(call("extract", "tables", "a.docx")[1])["tables"] == []
    row = json.loads(call("extract", "rows", "--sheet-index", "1", "a.xlsx")[1])
    assert row["file"] == "a.xlsx" and row["sheet_index"] == 1 and len(row["cells"]) == 2
    report = json.loads(call("infer", "schema", "--sheet", "S", "--sample-rows", "1", "a.xlsx")[1])
    assert report["scan"]["mode"] == "sampled" and [c["logical_type"] for c in report["columns"]] == ["int64", "utf8"] and report["file"] == "a.xlsx"
    assert json.loads(call("audit", "a.docx")[1])["signals"][0]["kind"] == "custom_properties"
    assert call("extract", "text", "junk.docx")[0] == 1 and call("extract", "text", "junk.docx")[2].startswith("error[E002]: ")
    assert call("info", "absent.docx")[::2] == (1, "error[E001]: I/O error: No such file or directory\n")


def test_command_line_of_several_inputs(call):
    code, out, err = call("extract", "text", "a.docx", "junk.docx", "b.docx", "absent.docx")
    lines = err.splitlines()
    assert (code, out) == (0, "hi\n\n---\nho\n") and [x.split(":")[0] for x in lines] == ["warning[batch/W998]", "warning[parser/W001]", "warning[batch/W998]"]
    assert lines[0].startswith("warning[batch/W998]: junk.docx: skipped after error[E002]: ")
    assert [x["text"] for x in json.loads(call("extract", "text", "--format", "json", "b.docx", "junk.docx", "a.docx")[1])] == ["ho\n", "hi\n"]
    assert call("extract", "text", "--format", "json", "junk.docx", "junk.docx")[:2] == (0, "[]\n")
    assert json.loads(call("extract", "text", "--format", "structured-json", "junk.docx", "absent.docx")[1]) == []
    rows = [json.loads(x) for x in call("extract", "text", "--format", "jsonl", "a.docx", "junk.docx", "absent.docx")[1].splitlines()]
    assert [(r["file"], r.get("text"), r.get("error", {}).get("code")) for r in rows] == [("a.docx", "hi\n", None), ("junk.docx", None, "E002"), ("absent.docx", None, "E001")]
    assert call("extract", "text", "junk.docx", "absent.docx")[0] == 1 and "error[E010]: no input files" in call("extract", "text", "junk.docx", "absent.docx")[2]
    code, out, err = call("extract", "csv", "a.xlsx", "junk.docx", "a.xlsx")
    assert (code, out) == (0, "5,x\n5,x\n") and "W998" in err
    assert call("extract", "csv", "junk.docx", "junk.docx")[0] == 1
    assert call("extract", "csv", "--list-sheets", "a.xlsx", "a.xlsx")[::2] == (1, "error[E010]: --list-sheets supports a single input file\n")
    audits = json.loads(call("audit", "a.docx", "junk.docx", "b.docx")[1])
    assert [a["file"] for a in audits] == ["a.docx", "b.docx"]
    lines = [json.loads(x) for x in call("audit", "--format", "jsonl", "a.docx", "junk.docx")[1].splitlines()]
    assert lines[0]["audit"]["file"] == "a.docx" and lines[1]["error"]["code"] == "E002"


def test_wrong_usage():
    from foliospark.__main__ import parse

    for args in ("extract csv --sheet S --sheet-index 1 x", "extract csv --all-sheets x", "extract csv --output-dir d x", "extract csv --list-sheets --all-sheets --output-dir d x", "extract text", "infer schema --sample-rows 0 x", "extract rows --sheet-index 0 x", "info --format jsonl x", "extract csv --all-sheets --output-dir d -o f x"):
        with pytest.raises(SystemExit) as e:
            parse(args.split())
        assert e.value.code == 2


def test_exports_of_packages_of_one_name_keep_apart(spark, tmp_path):
    books = [(f"/x/{q}/book.xlsx", G.workbook([("Orders", "", G.sheet_xml([G.cell(1, 0, None, n)]))])) for n, q in enumerate(("q1", "q2"))]
    pk = api.from_bytes(spark, books).repartition(1)
    for _ in range(2):  # again, as a retried task would
        rows = api.export_all_sheets(pk, str(tmp_path)).collect()
    assert [r.csv_path for r in rows] == ["001-orders.csv"] * 2 and len(list(tmp_path.iterdir())) == 2
    for n, (path, _) in enumerate(books):
        where = tmp_path / api.package_folder(path)
        assert (where / "001-orders.csv").read_text() == f"{n}\n" and json.loads((where / "manifest.json").read_text())["file"] == path
        assert sorted(p.name for p in where.iterdir()) == ["001-orders.csv", "manifest.json"]


def test_batches_and_their_numbers(spark, tmp_path, monkeypatch):
    books = [(f"{n}.xlsx", G.workbook([("S", "", G.sheet_xml([G.cell(i, 0, None, 100 * n + i) for i in range(1, 8)]))])) for n in range(3)]
    pk, schema = api.from_bytes(spark, books), [("v", 0, "int64", False)]
    got = list(api.record_batches(pk, schema, 3))
    assert [b.num_rows for b in got] == [3, 3, 1] * 3 and [v for b in got for v in b.column(0).to_pylist()] == [100 * n + i for n in range(3) for i in range(1, 8)]
    assert got[0].schema.names == ["v"]
    seen = []
    assert api.visit_batches(pk, schema, lambda b: seen.append(b.num_rows) or len(seen) < 2, 3) == {"rows": 6, "batches": 2}
    assert api.write_parquet(pk.repartition(1), schema, str(tmp_path / "out"), 4) == {"rows": 21, "row_groups": 6}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 21
    monkeypatch.setattr(api, "FOOTERS", 0)
    assert api._row_groups(spark, str(tmp_path / "out")) == 6


def test_inference_reads_each_package_once(spark):
    pk = api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", G.sheet_xml([G.cell(1, 0, None, 1)]))]))])
    assert api.infer_schema(pk)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_direct_columns_are_those_of_the_cells(spark):
    rows = [G.cell(i, 0, None, i) + G.cell(i, 1, None, f"{i}.5e1") + G.cell(i, 2, "s", i % 2) + (G.cell(i, 3, "b", i % 2) if i % 3 else "") + G.cell(i, 5, "inlineStr", "é") for i in range(1, 50)]
    usual = G.workbook([("S", "", G.sheet_xml(rows))], ["a", "b"])
    odd = G.edited(usual, "xl/worksheets/sheet1.xml", lambda x: x.replace(b"<sheetData>", b"<sheetData><!-- x -->"))
    schema = [("i", 0, "int64", False), ("f", 1, "float64", True), ("s", 2, "utf8", True), ("b", 3, "bool", True), ("n", 4, "int64", True), ("t", 5, "utf8", False), ("g", 0, "float64", True)][:6]
    one, two = ([tuple(r)[1:] for r in api.typed_table(api.from_bytes(spark, [("x", data)]), schema).collect()] for data in (usual, odd))
    assert one == two and len(one) == 49 and one[0] == (0, 1, 15.0, "b", True, None, "é")
    bad = G.workbook([("S", "", G.sheet_xml([G.cell(1, 0, None, 1), G.cell(2, 0, "str", "x")]))])
    with pytest.raises(Exception, match="row 1, column 0, i: expected int64, found string"):
        api.typed_table(api.from_bytes(spark, [("x", bad)]), schema[:1]).collect()
    assert [r.i for r in api.typed_table(api.from_bytes(spark, [("x", bad)]), [("i", 0, "int64", True)], on_mismatch="null").collect()] == [1, None]


def test_no_mutated_package_ends_a_lenient_scan(spark):
    """Packages with bytes changed, cut or doubled in their parts and in the archive itself."""
    import random

    rng = random.Random(5)
    plain = [
        G.document("<w:tbl><w:tr><w:tc>" + G.paragraph("a &amp; b") + "</w:tc></w:tr></w:tbl>", [("header", "header1.xml", f"<w:hdr>{G.paragraph('h')}</w:hdr>")], G.properties({"creator": "A"}, {"Words": 3}, {"k": 1})),
        G.workbook([("S", "", G.sheet_xml([G.cell(1, 0, None, 45000, 1) + G.cell(1, 1, "s", 0) + G.cell(1, 2, "b", 1)]))], ["x"], [0, 14], extra=G.properties({"creator": "A"})),
        G.presentation([(G.slide_paragraph("a"), G.slide_paragraph("n"))]),
    ]

    def changed(data):
        data = bytearray(data)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(data))
            kind = rng.random()
            if kind < 0.5:
                data[at] = rng.choice(b"<>&\"'/= 0123456789AZaz\x00\xff")
            elif kind < 0.75:
                del data[at : at + rng.randint(1, 40)]
            else:
                data[at:at] = data[at : at + rng.randint(1, 40)] * rng.randint(1, 5)
        return bytes(data)

    items = []
    for i in range(240):
        data = plain[i % 3]
        if i % 4:
            import io
            import zipfile

            name = rng.choice(zipfile.ZipFile(io.BytesIO(data)).namelist())
            data = G.edited(data, name, changed)
        else:
            data = changed(data)
        items.append((f"{i}.bin", data))
    pk = api.from_bytes(spark, items)
    for scan in (api.extract_text, api.structured_text, api.docx_tables, api.read_info, api.read_audit, api.detect_type):
        found = scan(pk, mode="permissive").select("path", "error").collect()
        assert {r.path for r in found} == {n for n, _ in items}
        assert scan(pk, mode="dropmalformed").count() == sum(r.error is None for r in found)
    found = api.scan_rows(pk, all_sheets=True, include_hidden=True, formatted=True, mode="permissive").select("path", "error").collect()
    assert {r.path for r in found if r.error} <= {n for n, _ in items} and found
    assert api.csv_lines(pk, mode="dropmalformed", formatted=True).count() >= 0


def test_the_entry_works_without_the_other_subpackage(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        entry = importlib.reload(__spark_entry__)
        assert set(entry.queries()) == set(catalog.queries()) == set(entry.oracle_sql())
        assert entry.entry(spark).count() == 1500
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_contracts_read_what_is_written(spark):
    from pyspark.sql import functions as F

    from foliospark.contracts import CONTRACTS

    doc = G.document("<w:tbl><w:tr><w:tc>" + G.paragraph("a") + "</w:tc></w:tr></w:tbl>", extra=G.properties({"creator": "A"}))
    docs = api.from_bytes(spark, [("a.docx", doc)])
    books = api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", G.sheet_xml([G.cell(1, 0, None, 1)]))]))])
    made = {
        "info": api.info_json(docs), "text": api.text_json(docs), "text-jsonl": api.text_jsonl(docs), "structured-text": api.structured_json(docs), "docx-tables": api.tables_json(docs), "audit": api.audit_json(docs),
        "audit-jsonl": api.audit_jsonl(docs), "rows-jsonl": api.rows_jsonl(books), "schema": api.schema_report(books),
    }
    assert {*made, "manifest"} == set(CONTRACTS)
    for name, df in made.items():
        row = df.select("value", F.from_json("value", CONTRACTS[name], {"mode": "FAILFAST"}).alias("r"), F.schema_of_json(F.lit(df.first().value)).alias("kind")).first()
        assert row.r.file in ("a.docx", "a.xlsx")
        again = json.loads(df.select(F.to_json(F.from_json("value", CONTRACTS[name])).alias("v")).first().v)
        assert again == json.loads(row.value)


def test_a_callback_stops_the_rows(spark):
    pk = api.from_bytes(spark, [("a.xlsx", G.workbook([("S", "", G.sheet_xml([G.cell(i, 0, None, i) for i in range(1, 9)]))]))])
    seen = []
    assert api.for_each_row(pk, lambda r: seen.append(r.row_index) or len(seen) < 3) == 3 and seen == [0, 1, 2]
