"""Text and tables of documents, slides, properties and audit signals, case by case."""

import pytest

from foliospark import errors as E
from foliospark.operators import docx, pptx, properties
from foliospark.plans import forge as G
from foliospark.sources.archive import Archive

P = G.paragraph


def text(body):
    return docx.part_text(f"<w:document>{body}</w:document>".encode(), "p")


def cell(*paragraphs, properties=""):
    return f"<w:tc>{properties}{''.join(paragraphs)}</w:tc>"


def row(*cells, properties=""):
    return f"<w:tr>{properties and f'<w:trPr>{properties}</w:trPr>'}{''.join(cells)}</w:tr>"


def table(*rows, grid=0):
    return f"<w:tbl>{grid and '<w:tblGrid>' + '<w:gridCol/>' * grid + '</w:tblGrid>' or ''}{''.join(rows)}</w:tbl>"


def run(*parts):
    """A paragraph of texts and, in tuples, empty elements."""
    return "<w:p>" + "".join(f"<w:{p[0]}/>" if isinstance(p, tuple) else f"<w:t>{p}</w:t>" for p in parts) + "</w:p>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (P("a") + P("b"), "a\nb\n"),
        ("<w:p/>" + P("a"), "a\n"),
        ("<w:p></w:p>" + P("a"), "\na\n"),
        (P("a") + "<w:p></w:p><w:p></w:p>" + P("b"), "a\nb\n"),
        (run("a", ("tab",), "b", ("br",), ("br",), "c").replace("c<", "c</w:t><w:t></w:t><w:tab></w:tab><w:t><"), "a\tb\nc\n"),
        (run("a &amp; b", "<![CDATA[&lt;x]]>"), "a & b<x\n"),
        (f"<w:del>{P('gone')}</w:del><w:ins>{P('stays')}</w:ins><w:moveFrom>{P('gone')}</w:moveFrom><w:moveTo>{P('too')}</w:moveTo>", "stays\ntoo\n"),
        ("<w:p><w:instrText>FIELD</w:instrText><w:t>shown</w:t></w:p>", "shown\n"),
        (table(row(cell(P("a"), P("b")), cell(P("c"))), row(cell(P("d")))) + P("e"), "a b\tc\nd\ne\n"),
        (table(row(cell(P("a"), table(row(cell(P("x")), cell(P("y")))), P("z")))), "a x\ty z\n"),
        (table(row(cell(P("kept")), properties="<w:del/>")), "kept\n"),
    ],
)
def test_flattened_text(body, want):
    assert text(body) == (want, [])


def test_text_before_a_fault_stays():
    got, found = docx.part_text(b"<d><w:p><w:t>one</w:t></w:p><w:p><w:t>two<", "p")
    assert got == "one\ntwo" and [w["code"] for w in found] == [E.W_XML] and found[0]["message"].startswith("stopped after malformed XML: ")


def related(*items, extra=None):
    return Archive(G.document(P("main"), list(items), extra))


def test_related_parts_in_relationship_order():
    own = related(("footnotes", "f.xml", P("foot")), ("styles", "s.xml", P("no")), ("header", "h.xml", P("head")), ("comments", "c.xml", "<x/>"))
    assert docx.text(own) == ("main\nfoot\nhead\n", [])
    assert [(t, x) for t, _, x in docx.blocks(own)[0]] == [("main", "main\n"), ("footnotes", "foot\n"), ("header", "head\n")]


def test_a_missing_related_part_is_a_warning_and_an_external_one_an_error():
    parts = {"word/document.xml": P("main"), "word/_rels/document.xml.rels": G.rels(("rId1", "header", "none.xml"))}
    got, found = docx.text(Archive(G.package("docx", parts)))
    assert got == "main\n" and found[0]["code"] == E.W_OTHER and "word/none.xml" in found[0]["message"]
    parts["word/_rels/document.xml.rels"] = G.rels(("rId1", "hyperlink", "https://x.invalid/"), ("rId2", "header", "https://x.invalid/"), external=("rId1", "rId2"))
    with pytest.raises(E.EngineError) as e:
        docx.text(Archive(G.package("docx", parts)))
    assert e.value.code == E.BAD_TARGET


def cell_properties(*items):
    return "<w:tcPr>" + "".join(f"<w:{n}" + (f' w:val="{v}"' if v is not None else "") + "/>" for n, v in items) + "</w:tcPr>"


TABLE = table(
    row(
        cell("<w:p/>", P("a"), properties=cell_properties(("gridSpan", 2))),
        cell(run("b", ("tab",), ("br",), ("br",)), properties=cell_properties(("vMerge", "RESTART"), ("gridSpan", 0))),
        properties="<w:gridBefore w:val='1'/><w:gridAfter w:val='x'/>",
    ),
    row(cell(P("deleted")), properties="<w:del/>"),
    row(cell(P("c"), table(row(cell(P("n")))), properties=cell_properties(("vMerge", None))), cell(properties=cell_properties(("vMerge", "odd")))),
    grid=3,
)


def test_table_semantics():
    got, found = docx.part_tables(f"<d>{TABLE}</d>".encode(), "p")
    own = docx._public(got[0])
    assert (own["grid_column_count"], own["complete"], len(own["rows"])) == (3, True, 2)
    a, b = own["rows"][0]["cells"]
    assert (own["rows"][0]["grid_before"], own["rows"][0]["grid_after"]) == (1, 0)
    assert (a["grid_start"], a["grid_span"], a["blocks"]) == (1, 2, [{"type": "paragraph", "text": ""}, {"type": "paragraph", "text": "a"}])
    assert (b["grid_start"], b["grid_span"], b["vertical_merge"], b["blocks"][0]["text"]) == (3, 1, "restart", "b\t\n\n")
    c, d = own["rows"][1]["cells"]
    assert (c["vertical_merge"], d["vertical_merge"], d["blocks"]) == ("continue", "none", [])
    assert c["blocks"][1]["type"] == "table" and c["blocks"][1]["rows"][0]["cells"][0]["blocks"] == [{"type": "paragraph", "text": "n"}]
    assert [w["message"] for w in found] == ["row 1 has invalid gridAfter value x; using 0", "row 1 cell 2 has invalid gridSpan value 0; using 1", "row 2 cell 2 has unknown vMerge value odd; using none"]


def test_a_malformed_table_keeps_its_closed_rows():
    got, found = docx.part_tables(f"<d><w:tbl>{row(cell(P('a')))}<w:tr><w:tc><w:tbl>{row(cell(P('b')))}<".encode(), "p")
    assert len(got) == 1 and not got[0]["complete"] and len(got[0]["rows"]) == 1 and found[0]["code"] == E.W_XML
    got, found = docx.part_tables(f"<d><w:tbl><w:tr>{cell(P('a'))}".encode(), "p")
    assert got == [] and len(found) == 1


def test_slides_and_notes():
    S = G.slide_paragraph
    own = Archive(G.presentation([(S("one") + "<a:p></a:p>" + "<a:p><a:tab/><a:t>x</a:t><a:br/><a:br></a:br></a:p>", S("note")), (S(""), None), (S("three"), None)]))
    assert pptx.text(own) == ("one\n\tx\nnote\nthree\n", [])
    assert [(k, p.rpartition("/")[2]) for k, p, _ in pptx.blocks(own)[0]] == [("slide", "slide1.xml"), ("notes", "notesSlide1.xml"), ("slide", "slide3.xml")]


def test_slide_ids_need_a_prefix_and_a_relationship():
    parts = {"ppt/presentation.xml": '<p><sldId id="1"/></p>', "ppt/_rels/presentation.xml.rels": G.rels()}
    assert pptx.text(Archive(G.package("pptx", parts)))[1][0]["code"] == E.W_OTHER
    parts["ppt/presentation.xml"] = '<p><sldId r:id="rId7"/></p>'
    with pytest.raises(E.EngineError, match="rId7"):
        pptx.text(Archive(G.package("pptx", parts)))


def test_properties():
    extra = G.properties({"creator": "A &", "created": "2020"}, {"Words": "12", "Pages": "-1", "Company": "C"}, {"b": 1, "a": 2})
    extra["docProps/custom.xml"] += "<"
    own, found = properties.info(Archive(G.document("", extra=extra)))
    assert (own["author"], own["created_at"], own["word_count"], own["page_count"], own["company"], own["revision"]) == ("A &", "2020", 12, None, "C", None)
    assert own["custom_properties"] == [("a", "2"), ("b", "1")] and not own["has_macros"] and [w["code"] for w in found] == [E.W_XML]


def test_audit_signals_in_order():
    extra = {"xl/vbaProject.bin": "", "xl/_rels/odd.rels": "<R><"} | G.properties(custom={"a": 1})
    links = (("rId8", "oleObject", "embeddings/o.bin"), ("rId9", "attachedTemplate", "file:///x"))
    data = G.workbook([("A", "veryHidden", G.sheet_xml([]))], extra=extra, extra_rels=links)
    own, signals, found = properties.audit(Archive(data))
    assert own["document_type"] == "xlsx"
    assert [(s["kind"], s["severity"]) for s in signals] == [
        ("macros", "high"), ("custom_properties", "info"), ("hidden_sheet", "warning"), ("ole_object", "warning"), ("attached_template", "warning"), ("parser_warning", "warning"),
    ]
    assert signals[2]["message"] == "worksheet 'A' is veryHidden" and signals[-1]["message"].startswith("warning[parser/W001]: stopped after malformed XML: ")
    assert signals[4]["message"] == "relationship target 'file:///x' is suspicious: target is external or absolute outside the package"
