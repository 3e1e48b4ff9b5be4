"""Presentations: the text of slides and their notes, in the order of the slide list."""

from __future__ import annotations

from foliospark import errors as E
from foliospark.sources import package as P
from foliospark.sources import xml as X
from foliospark.sources.archive import Archive


def part_text(data: bytes, path: str) -> tuple[str, list[dict]]:
    """Paragraphs with content, each with a newline; tabs and breaks count in either form."""
    parts: list[str] = []
    last = ""
    in_t = content = False

    def newline() -> None:
        nonlocal last
        if last != "\n":
            parts.append("\n")
            last = "\n"

    try:
        for kind, name, raw in X.tokens(data):
            if kind <= X.EMPTY:
                if name == "t":
                    in_t = in_t or kind == X.START
                elif name == "tab":
                    parts.append("\t")
                    last, content = "\t", True
                elif name in ("br", "cr"):
                    newline()
                    content = True
            elif kind == X.END:
                if name == "t":
                    in_t = False
                elif name == "p":
                    if content:
                        newline()
                    content = False
            elif in_t and (text := X.decode(raw)):
                parts.append(text)
                last, content = text[-1], True
    except X.XmlFault as e:
        return "".join(parts), [E.malformed(path, e)]
    return "".join(parts), []


def _prefixed_id(raw: bytes) -> str | None:
    for m in X._ATTRIBUTE.finditer(raw):
        if b":" in m[1] and X.local(m[1]) == "id":
            return X.decode(m[2] if m[2] is not None else m[3])
    return None


def slides(archive: Archive) -> tuple[list[tuple[str, str, str]], list[dict]]:
    """(slide or notes, path, text) of every slide in order, each followed by its notes by relationship id."""
    main = P.main_part(archive, "pptx")
    ids, found = [], []
    try:
        for kind, name, raw in X.tokens(archive.text(main)):
            if kind <= X.EMPTY and name == "sldId":
                own = _prefixed_id(raw)
                if own is None:
                    found.append(E.warning(E.W_OTHER, main, "ignored presentation slide without relationship id"))
                else:
                    ids.append(own)
    except X.XmlFault as e:
        found.append(E.malformed(main, e))
    rels = P.rels_path(main)
    by = P.by_id(P.relationships(archive.text(rels), rels))
    out = []
    for own in ids:
        if own not in by:
            raise E.EngineError(E.MISSING, f"missing required OOXML part: {own}")
        slide = P.resolve(P.parent(main), by[own], rels)
        text, more = part_text(archive.read(slide), slide)
        out.append(("slide", slide, text))
        found += more
        own_rels = P.rels_path(slide)
        if not archive.has(own_rels):
            continue
        notes = P.by_id(P.relationships(archive.text(own_rels), own_rels))
        for _, r in sorted(notes.items()):
            if r.type is not None and r.type.endswith("/notesSlide"):
                path = P.resolve(P.parent(slide), r, own_rels)
                text, more = part_text(archive.read(path), path)
                out.append(("notes", path, text))
                found += more
    return out, found


def text(archive: Archive) -> tuple[str, list[dict]]:
    parts, found = slides(archive)
    out = ""
    for _, _, t in parts:
        if t and out and not out.endswith("\n"):
            out += "\n"
        out += t
    return out, found


def blocks(archive: Archive) -> tuple[list[tuple[str, str, str]], list[dict]]:
    parts, found = slides(archive)
    return [p for p in parts if p[2]], found
