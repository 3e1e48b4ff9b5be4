"""The package graph: content types, relationships, and targets resolved to parts."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from foliospark import errors as E
from foliospark.sources import xml as X
from foliospark.sources.archive import Archive

_BASE = "application/vnd.openxmlformats-officedocument."
MAIN_TYPES = {
    f"{_BASE}wordprocessingml.document.main+xml": "docx",
    f"{_BASE}presentationml.presentation.main+xml": "pptx",
    f"{_BASE}spreadsheetml.sheet.main+xml": "xlsx",
}
FALLBACK = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
MACRO_PARTS = tuple(f"{folder}/vbaProject.bin" for folder in ("word", "xl", "ppt"))
MACRO_TYPE = "application/vnd.ms-office.vbaproject"
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")


class Relationship(NamedTuple):
    id: str | None
    target: str
    type: str | None
    mode: str | None


def _elements(data: bytes, path: str, *names: str):
    """Attributes of the named elements; a fault is fatal."""
    try:
        for kind, name, raw in X.tokens(data):
            if kind <= X.EMPTY and name in names:
                yield X.attributes(raw)
    except X.XmlFault as e:
        raise E.EngineError(E.BAD_XML, f"malformed XML in {path}: {e}") from None


#: Bytes of a part up to which what was read is remembered: the types and relationships of a writer's packages are mostly the same.
REMEMBERED = 4096


def _content_types(data: bytes) -> tuple[str, ...]:
    return tuple(a["ContentType"] for a in _elements(data, "[Content_Types].xml", "Default", "Override") if "ContentType" in a)


_remembered_types = lru_cache(256)(_content_types)


def content_types(archive: Archive) -> list[str]:
    if not archive.has("[Content_Types].xml"):
        return []
    data = archive.text("[Content_Types].xml")
    return list((_remembered_types if len(data) <= REMEMBERED else _content_types)(data))


def document_type(archive: Archive) -> str:
    """docx, pptx or xlsx by the first main content type; else unknown."""
    return next((MAIN_TYPES[t] for t in content_types(archive) if t in MAIN_TYPES), "unknown")


def type_for(kind: str, path: str) -> str:
    """An unknown type goes by the file's extension, and is docx without a known one."""
    if kind != "unknown":
        return kind
    extension = path.rpartition(".")[2].lower()
    return extension if extension in ("pptx", "xlsx") else "docx"


def _relationships(data: bytes, path: str) -> tuple[Relationship, ...]:
    return tuple(Relationship(a.get("Id"), a["Target"], a.get("Type"), a.get("TargetMode")) for a in _elements(data, path, "Relationship") if "Target" in a)


_remembered_relationships = lru_cache(256)(_relationships)


def relationships(data: bytes, path: str) -> list[Relationship]:
    return list((_remembered_relationships if len(data) <= REMEMBERED else _relationships)(data, path))


def by_id(found: list[Relationship]) -> dict[str, Relationship]:
    """The last of each id; those without are left out."""
    return {r.id: r for r in found if r.id is not None}


def parent(path: str) -> str:
    return path.rpartition("/")[0]


def rels_path(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"


def target_part(base: str, target: str, mode: str | None = None) -> tuple[str | None, str | None]:
    """(part, None), or (None, why the target isn't followed)."""
    if mode is not None and mode.lower() == "external":
        return None, "external relationship targets are not supported"
    target = target.strip()
    if not target:
        return None, "target is empty"
    if "\0" in target:
        return None, "target contains a NUL byte"
    if "\\" in target:
        return None, "backslashes are not valid OOXML part separators"
    if target.startswith("//") or _SCHEME.match(target):
        return None, "target is external or absolute outside the package"
    parts = [] if target.startswith("/") else [p for p in base.split("/") if p not in ("", ".")]
    for p in target.split("/"):
        if p == "..":
            if not parts:
                return None, "target escapes the OOXML package root"
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return ("/".join(parts), None) if parts else (None, "target does not resolve to an OOXML part")


def resolve(base: str, relationship: Relationship, path: str) -> str:
    part, reason = target_part(base, relationship.target, relationship.mode)
    if part is None:
        shown = relationship.target if reason.startswith("external ") else relationship.target.strip()
        raise E.EngineError(E.BAD_TARGET, f"suspicious OOXML relationship target in {path}: {shown}: {reason}", shown, reason)
    return part


def main_part(archive: Archive, kind: str) -> str:
    if archive.has("_rels/.rels"):
        for r in relationships(archive.text("_rels/.rels"), "_rels/.rels"):
            if r.type is not None and r.type.endswith("/officeDocument"):
                return resolve("", r, "_rels/.rels")
    return FALLBACK[kind]


def rels_base(path: str) -> str:
    """The folder that the targets of a .rels part are relative to."""
    if path == "_rels/.rels":
        return ""
    before, found, name = path.rpartition("/_rels/")
    if not found:
        return parent(path)
    return before
