"""A tolerant XML tokenizer: it keeps apart ``<x/>`` and ``<x></x>``, allows the end with open elements, and stops at the first fault, with all tokens before it delivered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

START, EMPTY, END, TEXT, CDATA = range(5)

_TOKEN = re.compile(
    rb"([^<]*)(?:<(?:"
    rb"(/)([^\s<>/]+)\s*>"
    rb"|([^\s<>/!?=\"']+)((?:\s(?:[^<>\"'/]|\"[^\"]*\"|'[^']*'|/(?!>))*)?)(/?)>"
    rb"|!\[CDATA\[(.*?)\]\]>"
    rb"|!--.*?-->|\?.*?\?>|!DOCTYPE(?:[^<>\[]|\[[^\]]*\])*>"
    rb"))",
    re.S,
)
_ATTRIBUTE = re.compile(rb"([^\s=\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_ENTITY = re.compile(r"&([^;&]{0,17});")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


class XmlFault(Exception):
    """What ended the token stream early."""


def _entity(m: re.Match) -> str:
    name = m[1]
    if (known := _NAMED.get(name)) is not None:
        return known
    if name.startswith("#"):
        try:
            code = int(name[2:], 16) if name[1:2] == "x" else int(name[1:], 10)
            return "" if 0xD800 <= code < 0xE000 else chr(code)
        except (ValueError, OverflowError):
            return ""
    return m[0]


def decode(raw: bytes) -> str:
    """Text with its entities resolved; unknown ones stay as they are, invalid numeric ones go, bad UTF-8 is replaced."""
    text = raw.decode("utf-8", "replace")
    return _ENTITY.sub(_entity, text) if "&" in text else text


@lru_cache(4096)
def local(name: bytes) -> str:
    return name.rpartition(b":")[2].decode("utf-8", "replace")


def whole(text: str | None, most: int = (1 << 63) - 1) -> int | None:
    """Plain decimal digits, with a plus or none before them, as a number up to ``most``; else None."""
    if text is None:
        return None
    digits = text[1:] if text.startswith("+") else text
    if not (digits.isascii() and digits.isdigit()) or len(digits := digits.lstrip("0") or "0") > 19:
        return None
    return n if (n := int(digits)) <= most else None


def attributes(raw: bytes) -> dict[str, str]:
    """By local name; the first of each."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(local(m[1]), decode(m[2] if m[2] is not None else m[3]))
    return out


def attribute(raw: bytes, name: str) -> str | None:
    for m in _ATTRIBUTE.finditer(raw):
        if local(m[1]) == name:
            return decode(m[2] if m[2] is not None else m[3])
    return None


def tokens(data: bytes, at: int = 0, end: int | None = None, open_: list[bytes] | None = None) -> Iterator[tuple[int, str, bytes]]:
    """(kind, local name, raw attributes or raw text); XmlFault at the first fault.

    A part of the data can be read: from ``at`` to ``end``, with the elements that are open there, which are kept up to date.
    """
    if data.startswith(b"\xef\xbb\xbf") and at == 0:
        at = 3
    open_ = [] if open_ is None else open_
    end = len(data) if end is None else end
    for m in _TOKEN.finditer(data, at, end):
        if m.start() != at:
            break
        at = m.end()
        text, slash, ended, name, attrs, empty, cdata = m.groups()
        if text:
            yield TEXT, "", text
        if name is not None:
            if empty:
                yield EMPTY, local(name), attrs
            else:
                open_.append(name)
                yield START, local(name), attrs
        elif slash:
            if not open_ or open_[-1] != ended:
                raise XmlFault(f"unexpected end tag {ended.decode('utf-8', 'replace')}")
            open_.pop()
            yield END, local(ended), b""
        elif cdata is not None:
            yield CDATA, "", cdata
    rest = data[at:end]
    if b"<" in rest:
        before, _, after = rest.partition(b"<")
        if before:
            yield TEXT, "", before
        raise XmlFault(f"unclosed or invalid markup at byte {at + len(before)}: {after[:20].decode('utf-8', 'replace')!r}")
    if rest:
        yield TEXT, "", rest
