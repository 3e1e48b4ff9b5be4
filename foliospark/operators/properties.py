"""Document properties, and audit signals: macros, custom properties, hidden sheets, protection, relationship targets and parser warnings."""

from __future__ import annotations

from functools import lru_cache

from foliospark import errors as E
from foliospark.sources import package as P
from foliospark.sources import xml as X
from foliospark.sources.archive import Archive

CORE = {"creator": "author", "lastModifiedBy": "last_modified_by", "created": "created_at", "modified": "modified_at", "revision": "revision"}
APP = {"Application": "application", "Company": "company"}
COUNTS = {"Words": "word_count", "Pages": "page_count", "Slides": "slide_count", "Worksheets": "worksheet_count"}
FIELDS = (*CORE.values(), *APP.values(), *COUNTS.values())


def _count(text: str) -> int | None:
    return X.whole(text)


def _fields(data: bytes, path: str, texts: dict[str, str], counts: dict[str, str], out: dict, found: list[dict]) -> None:
    current = None
    try:
        for kind, name, raw in X.tokens(data):
            if kind == X.START and (name in texts or name in counts):
                current = name
            elif kind == X.END and name == current:
                current = None
            elif kind >= X.TEXT and current is not None:
                text = X.decode(raw)
                if current in texts:
                    out[texts[current]] = (out.get(texts[current]) or "") + text
                else:
                    out[counts[current]] = _count(text)
    except X.XmlFault as e:
        found.append(E.malformed(path, e))


def _custom(data: bytes, path: str, found: list[dict]) -> dict[str, str]:
    """Named properties that have a value element; the last of a name."""
    values: dict[str, str] = {}
    name, value, depth, seen = None, "", 0, False
    try:
        for kind, tag, raw in X.tokens(data):
            if kind == X.START:
                if tag == "property" and (named := X.attribute(raw, "name")) is not None:
                    name, value, depth, seen = named, "", 0, False
                elif name is not None:
                    depth, seen = depth + 1, True
            elif kind == X.EMPTY:
                seen = seen or (name is not None and tag != "property")
            elif kind == X.END:
                if tag == "property" and name is not None:
                    if seen and name:
                        values[name] = value
                    name = None
                elif name is not None:
                    depth = max(0, depth - 1)
            elif name is not None and depth:
                value += X.decode(raw)
    except X.XmlFault as e:
        found.append(E.malformed(path, e))
    return values


def _declared(data: bytes) -> tuple[bool, str | None]:
    """Whether a content type declares macros, and the fault that ended the look."""
    out = False
    try:
        for kind, name, raw in X.tokens(data):
            if kind <= X.EMPTY and name in ("Default", "Override"):
                out = out or (X.attribute(raw, "ContentType") or "").lower() == P.MACRO_TYPE
    except X.XmlFault as e:
        return out, str(e)
    return out, None


_remembered = lru_cache(256)(_declared)


def _macro_type(archive: Archive, found: list[dict]) -> bool:
    """Whether a content type declares macros; a fault here ends only this look."""
    path = "[Content_Types].xml"
    data = archive.text(path) if archive.has(path) else b""
    out, fault = (_remembered if len(data) <= P.REMEMBERED else _declared)(data)
    if fault is not None:
        found.append(E.malformed(path, fault))
    return out


def info(archive: Archive) -> tuple[dict, list[dict]]:
    out: dict = {}
    found: list[dict] = []
    macros = any(archive.has(p) for p in P.MACRO_PARTS)
    macros = _macro_type(archive, found) or macros
    for path, texts, counts in (("docProps/core.xml", CORE, {}), ("docProps/app.xml", APP, COUNTS)):
        if archive.has(path):
            _fields(archive.read(path), path, texts, counts, out, found)
    custom = _custom(archive.read("docProps/custom.xml"), "docProps/custom.xml", found) if archive.has("docProps/custom.xml") else {}
    return {**{f: out.get(f) for f in FIELDS}, "custom_properties": sorted(custom.items()) or None, "has_macros": macros}, found


def _signal(kind: str, path: str, message: str) -> dict:
    """A warning, but for macros, which weigh more, and custom properties, which weigh less."""
    return {"kind": kind, "severity": {"macros": "high", "custom_properties": "info"}.get(kind, "warning"), "path": path, "message": message}


EXTERNAL = {"hyperlink": "hyperlink", "externallink": "external_link", "attachedtemplate": "attached_template"}
INTERNAL = {"oleobject": ("ole_object", "OLE object"), "package": ("embedded_package", "embedded package")}


def _workbook(archive: Archive, found: list[dict]) -> list[dict]:
    path, out = "xl/workbook.xml", []
    try:
        for kind, name, raw in X.tokens(archive.text(path)):
            if kind > X.EMPTY:
                continue
            if name == "sheet":
                own = X.attributes(raw)
                if own.get("state", "").lower() in ("hidden", "veryhidden"):
                    out.append(_signal("hidden_sheet", path, f"worksheet '{own.get('name', '<unnamed>')}' is {own['state']}"))
            elif name == "workbookProtection":
                out.append(_signal("workbook_protection", path, "workbook protection settings are present"))
    except X.XmlFault as e:
        found.append(E.malformed(path, e))
    return out


def _targets(archive: Archive, found: list[dict]) -> list[dict]:
    out = []
    for path in sorted(n for n in archive.names() if n.endswith(".rels")):
        try:
            rels = P.relationships(archive.text(path), path)
        except E.EngineError as e:
            if e.code != E.BAD_XML:
                raise
            found.append(E.malformed(path, e.message.partition(": ")[2]))
            continue
        for r in rels:
            kind = r.type.rpartition("/")[2].lower() if r.type else ""
            try:
                P.resolve(P.rels_base(path), r, path)
            except E.EngineError as e:
                out.append(_signal(EXTERNAL.get(kind, "relationship_target"), path, f"relationship target '{e.target}' is suspicious: {e.reason}"))
                continue
            if kind in INTERNAL:
                name, words = INTERNAL[kind]
                out.append(_signal(name, path, f"internal {words} relationship targets '{r.target}'"))
    return out


def audit(archive: Archive) -> tuple[dict, list[dict], list[dict]]:
    """Document info, signals in order, and the warnings, which are signals too."""
    kind = P.document_type(archive)
    own, found = info(archive)
    out = []
    if own["has_macros"]:
        out.append(_signal("macros", "[Content_Types].xml", "VBA macro content is present or declared"))
    if own["custom_properties"]:
        out.append(_signal("custom_properties", "docProps/custom.xml", f"{len(own['custom_properties'])} custom document properties are present"))
    if kind == "xlsx" and archive.has("xl/workbook.xml"):
        out += _workbook(archive, found)
    out += _targets(archive, found)
    out += [_signal("parser_warning", w["path"], f"warning[{w['category']}/{w['code']}]: {w['message']}") for w in found]
    return {**own, "document_type": kind}, out, found
