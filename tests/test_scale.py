"""What keeps the queries' cost in proportion to their rows: tasks by rows, batches by bytes, formats by column."""

import io
import random
import zipfile

import pyarrow as pa
import pytest

from foliospark import api
from foliospark.operators import sheet_columns, shred
from foliospark.plans import catalog as Q
from foliospark.plans import forge as G
from foliospark.plans import more as M
from foliospark.sources.archive import Limits


def test_packages_are_forged_by_as_many_tasks_as_their_number_asks(spark, tmp_path):
    """Few bytes are many packages, which adaptive execution would put into one task."""
    spark.range(1000).selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    made = Q.mixed_packages(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 4 and made.count() == 1000
    rows = spark.range(20_000).selectExpr("id", "id DIV 500 AS g")
    groups = G.forged(rows, "g", ["id"], "g-{}.bin", lambda own: ",".join(str(r.id) for r in own).encode())
    assert groups.rdd.getNumPartitions() == 4
    assert {r.path: bytes(r.content) for r in groups.collect()} == {f"g-{g}.bin": ",".join(map(str, range(g * 500, g * 500 + 500))).encode() for g in range(40)}


def test_repeated_keys_give_a_package_each(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k bigint, v string")
    assert sorted(bytes(r.content) for r in G.each(rows, "k", "{}", lambda r: r.v.encode()).collect()) == [b"a", b"b"]


def test_deep_tables_take_memory_by_their_arrays(spark):
    """The nests of n tables within each other are n * n numbers: 4 bytes each, not an object each."""
    import tracemalloc

    from foliospark.operators import docx
    from foliospark.sources.archive import Archive

    own, _ = docx.tables(Archive(M.hostile_document(9)))
    tracemalloc.start()
    cells = shred._cells(own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    nests = cells.field("nest")
    assert len(cells) == 1500 and len(nests[1499]) == 3 * 1499 and peak < 40e6 and nests.nbytes < 15e6
    pk = api.from_bytes(spark, [("a.docx", M.hostile_document(9)), ("b.docx", b"no")])
    whole, bare = (api.docx_tables(pk, mode="permissive", cells=c).orderBy("path").collect() for c in (True, False))
    assert [(r.path, r.tables_json, r.n_tables, r.error) for r in whole] == [(r.path, r.tables_json, r.n_tables, r.error) for r in bare]
    assert len(whole[0].cells) == 1500 and "cells" not in bare[0]


@pytest.mark.parametrize("mode", ["failfast", "dropmalformed", "permissive"])
def test_batches_are_bounded_by_bytes(mode):
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("error", pa.struct([("code", pa.string()), ("message", pa.string())]))])
    data = G.document(G.paragraph("x"))
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(40)], "content": [data] * 40})

    def read(path, archive):
        return {"text": "\ud800" if mode != "failfast" and path == "7" else "x" * (1 << 20)}

    made = list(shred._each([batch], schema, read, Limits(), mode))
    assert len(made) >= 4 and max(b.nbytes for b in made) < 2 * shred.BATCH_BYTES
    assert [p for b in made for p in b["path"].to_pylist()] == [str(i) for i in range(40) if mode != "dropmalformed" or i != 7]
    assert [p for b in made for p, e in zip(b["path"].to_pylist(), b["error"].to_pylist(), strict=True) if e] == ["7"] * (mode == "permissive")


def test_rows_of_small_packages_share_batches(spark):
    """A few rows a package aren't a batch each."""
    pk = api.from_bytes(spark, [(f"{i}.xlsx", G.workbook([("S", "", G.sheet_xml([G.cell(1, 0, None, i)]))])) for i in range(300)]).coalesce(1)
    sizes = api.scan_rows(pk).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in shred._joined(batches)), "n bigint").collect()
    assert [r.n for r in sizes] == [600] and len(list(shred._joined(iter([pa.record_batch([pa.array([1])], names=["n"])] * 300)))) == 1


def test_formats_by_column_are_those_of_expressions(spark):
    """A sheet of the usual form, whose formats go by column, against the same with a comment, which is read by rows."""
    some = random.Random(5)
    formats = [0, 14, 22, 45, 10, 9, 2, 1, 44, "#,##0.0", "0.000000", "0.0000000"]
    values = ["0", "-0", "0.5", "1.5", "2.5", "-0.001", "-0.5", "0.125", "60", "60.99", "61", "59", "-3", "2958465.9999999", "2899999", "2900000", "3000000", "1e3", " 4", "7.", "12345678901", "1.005", "0.9999999", "1e400", "x"]
    values += [f"{some.uniform(-1, 1) * 10 ** some.randint(0, 10):.{some.randint(0, 12)}f}" for _ in range(400)] + [repr(some.randint(0, 3_000_000) + some.randint(0, 86400) / 86400) for _ in range(200)]
    values += [repr(some.randint(0, 10**6) / 8 + k / 2) for k in range(50)]
    rows = ["".join(G.cell(i, j, None, v, j) for j in range(len(formats))) for i, v in enumerate(values, 1)]
    usual = G.sheet_xml(rows)
    odd = usual.replace("<sheetData>", "<sheetData><!-- -->")
    for date1904 in (False, True):
        pk = api.from_bytes(spark, [(n, G.workbook([("S", "", x)], formats=formats, date1904=date1904)) for n, x in (("a", usual), ("b", odd))])
        found = {n: api.visit_rows(pk.where(f"path = '{n}'"), True).drop("path").orderBy("row_ord").collect() for n in "ab"}
        assert found["a"] == found["b"]
        raw = api.scan_rows(pk, formatted=True).where("row_ord is not null").selectExpr("path", "inline(cells)").where("shown is not null").groupBy("path").count().collect()
        assert [r.path for r in raw] == ["a"] and raw[0]["count"] > 0.6 * len(values) * (len(formats) - 3 * date1904)


def test_stored_packages_are_zipfiles_bytes():
    parts = {"[Content_Types].xml": "<Types/>", "a/b.bin": b"\0\xff" * 9, "empty": ""}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in parts.items():
            z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), d)
    assert G.archive(parts) == out.getvalue()
    assert zipfile.ZipFile(io.BytesIO(G.archive({"\xe4": "x"}))).namelist() == ["\xe4"]


@pytest.mark.parametrize("deflate", [False, True])
def test_parts_are_read_without_file_objects_as_by_zipfile(monkeypatch, deflate):
    """A sound part takes no file object; of a damaged one zipfile says what is wrong, as before."""
    from foliospark.sources.archive import Archive

    parts = {"a.xml": "x" * 5000, "b.xml": "some text, not long", "c.xml": ""}
    data = G.archive(parts, deflate)
    with monkeypatch.context() as m:
        m.setattr(zipfile.ZipFile, "open", lambda *_: pytest.fail("opened"))
        for whole in (data, b"before the archive" + data):
            assert {n: Archive(whole).read(n).decode() for n in parts} == parts

    def outcomes(data):
        try:
            archive = Archive(data)
        except Exception as e:
            return repr(e)
        found = []
        for n in parts:
            try:
                found.append(archive.read(n))
            except Exception as e:
                found.append(repr(e))
        return found

    some = random.Random(3)
    for _ in range(600):
        odd = bytearray(data)
        for _ in range(some.randint(1, 3)):
            odd[some.randrange(len(odd))] = some.randrange(256)
        got = outcomes(bytes(odd))
        with monkeypatch.context() as m:
            m.setattr(Archive, "_plain", lambda *_: None)
            assert got == outcomes(bytes(odd))


def test_types_and_relationships_that_repeat_are_parsed_once(monkeypatch):
    """Packages of one writer say the same of their parts; faults are said for each."""
    from foliospark.operators import docx, properties
    from foliospark.sources import package as P
    from foliospark.sources import xml as X
    from foliospark.sources.archive import Archive

    seen = []
    plain = X.tokens
    monkeypatch.setattr(X, "tokens", lambda data, *rest: (seen.append(data), plain(data, *rest))[1])
    tag = random.random()
    for i in range(5):
        a = Archive(G.document(G.paragraph(i), overrides=((f"x{tag}", "application/x"),)))
        assert P.document_type(a) == "docx" and docx.text(a)[0] == f"{i}\n" and properties.audit(a)[1] == []
    assert sum(b"<Types" in d for d in seen) == 2 and sum(b"<w:document" in d for d in seen) == 5
    cut = Archive(G.edited(G.document(G.paragraph("x")), "[Content_Types].xml", lambda x: x.replace(b"</Types>", b"</Oops>")))
    assert [properties.info(cut)[1][0]["code"] for _ in range(2)] == ["W001"] * 2
    for _ in range(2):
        with pytest.raises(Exception, match="E009"):
            P.document_type(cut)


def test_small_files_share_tasks(spark, tmp_path):
    """A task for every 32 files took longer to start than to run; large files stay by themselves."""
    for i in range(2000):
        (tmp_path / f"{i}.docx").write_bytes(b"%d" % i)
    own = api.packages(spark, str(tmp_path), glob="*.docx")
    assert own.rdd.getNumPartitions() == 16 and sorted(int(bytes(r.content)) for r in own.collect()) == list(range(2000))
    large = tmp_path / "large"
    large.mkdir()
    for i in range(40):
        (large / f"{i}.bin").write_bytes(bytes(10 << 20))
    plain = spark.read.format("binaryFile").load(str(large)).rdd.getNumPartitions()
    assert api.packages(spark, str(large)).rdd.getNumPartitions() == plain
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        api.packages(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("name", ["info_forms", "audit_forms"])
def test_all_forms_come_from_one_scan(spark, tmp_path, name):
    """Packages were made and read once a form and joined by path, which multiplied those of repeated keys."""
    spark.createDataFrame([(k, f"s{k}", 1) for k in (1, 2, 2, 6)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    own = Q.queries()[name](spark, str(tmp_path))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan
    assert sorted(r.path.rpartition(".")[0].rpartition("-")[2] for r in own.collect()) == ["1", "2", "2", "6"]
    if name == "info_forms":
        assert {(r.word_count, r.n_lines) for r in own.collect()} == {(3, 7), (6, 8), (18, 8)}


def test_temporal_columns_go_directly_as_by_cells(spark):
    """Dates, times, moments and columns of nothing are read by column; the same sheet with a comment goes by cells."""
    some = random.Random(9)
    days = [61, 62, 40000, *(some.randint(61, 90000) for _ in range(400))]
    clocks = [0.0, 0.5, 86399 / 86400, *(some.randint(0, 86399) / 86400 for _ in range(400))]
    rows = [
        G.cell(i, 0, None, d, 1) + (G.cell(i, 1, None, repr(c), 2) if i % 3 else "") + G.cell(i, 2, None, repr(d + c), 3) + G.cell(i, 3, "b", i % 2)
        for i, (d, c) in enumerate(zip(days, clocks, strict=True), 1)
    ]
    formats = [0, 14, 45, 22]
    usual = G.sheet_xml(rows)
    schema = [("day", 0, "date", False), ("clock", 1, "time", True), ("moment", 2, "datetime", False), ("odd", 3, "bool", False), ("none", 8, "null", True)]
    for date1904 in (False, True):
        pk = api.from_bytes(spark, [(n, G.workbook([("S", "", x)], formats=formats, date1904=date1904)) for n, x in (("a", usual), ("b", usual.replace("<sheetData>", "<sheetData><!-- -->")))])
        table = api.typed_table(pk, schema)
        assert table.schema["none"].dataType.simpleString() == "void"
        found = {n: table.where(f"path = '{n}'").drop("path").orderBy("row_ord").collect() for n in "ab"}
        assert len(found["a"]) == len(days) and found["a"] == found["b"]
        direct = shred.rows(pk, None, None, False, False, True, None, api.LIMITS, None, "failfast", [(f"c{i}", *x[1:]) for i, x in enumerate(schema)])
        ways = {(r.path, r.direct is not None) for r in direct.where("row_ord is not null").select("path", "direct").collect()}
        assert ways == {("a", not date1904), ("b", False)}
    # What doesn't fit is said as by cells.
    for odd, kind in ((G.cell(1, 0, None, 5.5), "date"), (G.cell(1, 0, None, 1, 1), "null"), (G.cell(1, 0, None, 40000, 1), "time")):
        pk = api.from_bytes(spark, [("a", G.workbook([("S", "", G.sheet_xml([odd] + [""] * 2000))], formats=formats))])
        with pytest.raises(Exception, match=f"column 0, v: expected {kind}"):
            api.typed_table(pk, [("v", 0, kind, True)]).collect()


def test_json_texts_are_those_of_the_general_rule(spark):
    texts = ["", "plain ~!#[]{}/", 'a"b', "a\\b", "a\n", "\n", "\t", "\x7f", "\u00e4\u2028\U0001f600", "\x00", None]
    own = spark.createDataFrame([(t,) for t in texts], "t string")
    general = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(r"""t""", r"""regexp_extract(to_json(struct(t AS v)), '(?s)^\\{"v":(.*)\\}$', 1) AS j""")
    assert {(r.t, r.j) for r in own.select("t", api._json_text(own.t).alias("j")).collect()} == {(r.t, r.j) for r in general.collect()}


@pytest.mark.parametrize("kind", ["int64", "float64", "bool", "utf8", "date", "time", "datetime", "null"])
def test_a_column_that_isnt_there_doesnt_send_the_sheet_to_the_cells(kind):
    """What holds for all of no values was taken for what holds for none."""
    own, _ = sheet_columns_of(G.sheet_xml([G.cell(i, 0, None, i) for i in range(1, 600)]))
    first, none = sheet_columns.values(own, [("a", 0, "int64", False), ("b", 9, kind, True)], False)
    assert first.to_pylist() == list(range(1, 600)) and none.null_count == 599 and none.type == sheet_columns.DIRECT[kind][0]
    if kind != "null":
        assert sheet_columns.values(own, [("b", 9, kind, False)], False) is None


def sheet_columns_of(xml):
    from foliospark.operators import xlsx
    from foliospark.sources.archive import Archive

    opened = xlsx.open_workbook(Archive(G.workbook([("S", "", xml)])), True)
    reader, data = xlsx.sheet_reader(opened, opened.book.sheets[0], None)
    return reader.columns(data)
