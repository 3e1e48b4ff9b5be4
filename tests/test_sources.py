"""The tokenizer, ZIP guardrails, and the package graph."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark import errors as E
from foliospark.plans import forge as G
from foliospark.sources import package as P
from foliospark.sources import xml as X
from foliospark.sources.archive import Archive, Limits, enclosed


def kinds(data):
    out = []
    try:
        for kind, name, raw in X.tokens(data):
            out.append((kind, name or raw.decode()))
    except X.XmlFault:
        out.append("fault")
    return out


def test_self_closing_and_empty_elements_differ():
    assert kinds(b"<w:p/><w:p></w:p>") == [(X.EMPTY, "p"), (X.START, "p"), (X.END, "p")]


def test_declarations_comments_and_cdata():
    assert kinds(b'\xef\xbb\xbf<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><!-- <a> --><t><![CDATA[<&amp;]]></t>') == [(X.START, "t"), (X.CDATA, "<&amp;"), (X.END, "t")]


def test_a_fault_comes_after_what_is_before_it():
    assert kinds(b"<a>text<") == [(X.START, "a"), (X.TEXT, "text"), "fault"]
    assert kinds(b"<a></b>") == [(X.START, "a"), "fault"]
    assert kinds(b"<a><b>open") == [(X.START, "a"), (X.START, "b"), (X.TEXT, "open")]
    assert kinds(b"</a>") == ["fault"]


def test_attributes_may_hold_anything_quoted():
    _, _, raw = next(X.tokens(b"<a r:id='x>\"1' id=\"2/\" e=\"&lt;&#65;\"/>"))
    assert X.attributes(raw) == {"id": 'x>"1', "e": "<A"}


def test_entities():
    named = {"lt": "<", "quot": '"', "amp": "&", "apos": "'", "gt": ">"}
    assert all(X.decode(f"a&{n};b".encode()) == f"a{c}b" for n, c in named.items())
    assert X.decode(b"&#65;&#x42;&unknown;&#xD800;&#zz;&") == "AB&unknown;&"
    assert X.decode(b"a\xffb") == "a\ufffdb"


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60) | st.lists(st.sampled_from([b"<a>", b"</a>", b"<a/>", b"<", b">", b"&amp;", b"x", b"<![CDATA[", b"]]>", b"<!--", b"-->", b'"', b"<b c='"]), max_size=14).map(b"".join))
def test_any_bytes_give_tokens_or_a_fault(data):
    kinds_ = []
    try:
        for kind, _, raw in X.tokens(data):
            kinds_.append(kind)
            X.decode(raw)
    except X.XmlFault:
        pass


def code(f, *args):
    with pytest.raises(E.EngineError) as e:
        f(*args)
    return e.value.code


def test_guardrails_in_order():
    data = G.archive({"a.xml": "x" * 1000, "../up.xml": "x", "dir/": ""})
    own = Archive(data, Limits(max_part_bytes=999))
    assert code(own.read, "a.xml") == E.TOO_LARGE and code(own.read, "absent") == E.MISSING
    assert code(own.read, "../up.xml") == E.BAD_ENTRY and code(own.read, "dir/") == E.BAD_ENTRY
    assert own.names() == ["a.xml", "dir/"]
    assert own.read("a.xml", Limits()) == b"x" * 1000
    bomb = G.archive({"z": "0" * (5 << 20)}, deflate=True)
    assert code(Archive(bomb).read, "z") == E.BAD_ENTRY
    assert len(Archive(bomb, Limits(max_ratio=10**6)).read("z")) == 5 << 20
    assert code(Archive, b"no zip") == E.BAD_ZIP and code(Archive, b"") == E.BAD_ZIP


def test_encrypted_and_lying_entries():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "hello")
    data = bytearray(out.getvalue())
    data[data.index(b"PK\x01\x02") + 8] |= 1
    own = Archive(bytes(data))
    assert code(own.read, "a") == E.ENCRYPTED and not own.has("a")
    crc = bytearray(out.getvalue())
    crc[crc.index(b"hello")] ^= 1
    assert code(Archive(bytes(crc)).read, "a") == E.IO
    assert code(Archive(G.archive({"a": b"\xff"})).text, "a") == E.IO


@pytest.mark.parametrize(("name", "safe"), [("a/b", True), ("/a", False), ("a/../b", True), ("../a", False), ("a/../../b", False), ("C:/a", False), ("a\\..\\..\\b", False)])
def test_enclosed(name, safe):
    assert enclosed(name) == safe


@pytest.mark.parametrize(
    ("base", "target", "mode", "part", "reason"),
    [
        ("word", "header1.xml", None, "word/header1.xml", None),
        ("ppt/slides", "../notes/n.xml", None, "ppt/notes/n.xml", None),
        ("word", "/word/a.xml", None, "word/a.xml", None),
        ("", " ./a//b.xml ", None, "a/b.xml", None),
        ("word", "x", "External", None, "external relationship targets are not supported"),
        ("word", " ", None, None, "target is empty"),
        ("word", "a\0", None, None, "target contains a NUL byte"),
        ("word", "a\\b", None, None, "backslashes are not valid OOXML part separators"),
        ("word", "//host/a", None, None, "target is external or absolute outside the package"),
        ("word", "mailto:x", None, None, "target is external or absolute outside the package"),
        ("word", "../../a", None, None, "target escapes the OOXML package root"),
        ("word", "..", None, None, "target does not resolve to an OOXML part"),
    ],
)
def test_targets(spark, base, target, mode, part, reason):
    from pyspark.sql import functions as F

    from foliospark.functions import cells as C

    assert P.target_part(base, target, mode) == (part, reason)
    row = spark.range(1).select(C.resolve_part(F.lit(base), F.lit(target), F.lit(mode).cast("string")).alias("r")).first().r
    assert tuple(row) == (part, reason)


def test_types_and_main_part():
    own = Archive(G.document("x"))
    assert (P.document_type(own), P.main_part(own, "docx")) == ("docx", "word/document.xml")
    bare = Archive(G.archive({"[Content_Types].xml": "<Types/>", "_rels/.rels": '<Relationships><Relationship Type="officeDocument" Target="x"/></Relationships>'}))
    assert (P.document_type(bare), P.main_part(bare, "xlsx")) == ("unknown", "xl/workbook.xml")
    assert [P.type_for("unknown", p) for p in ("a.XLSX", "b.pptx", "c.bin", "d")] == ["xlsx", "pptx", "docx", "docx"]
    assert code(P.document_type, Archive(G.archive({"[Content_Types].xml": "<Types></x>"}))) == E.BAD_XML
    assert P.by_id(P.relationships(b'<R><Relationship Id="a" Target="1"/><Relationship Id="a" Target="2"/><Relationship Target="3"/><Relationship Id="b"/></R>', "r"))["a"].target == "2"
    assert [P.rels_base(p) for p in ("_rels/.rels", "word/_rels/document.xml.rels", "word/_rels/.rels", "odd.rels")] == ["", "word", "word", ""]
    assert [P.rels_path(p) for p in ("word/document.xml", "a.xml")] == ["word/_rels/document.xml.rels", "_rels/a.xml.rels"]
