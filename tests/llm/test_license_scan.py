"""Licence templates against regular expressions over words, and hand-made texts."""

import functools
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import license_scan as L
from foliospark.llm import license_templates


@functools.cache
def expression(template):
    """The template as an expression over words that each end in a blank."""
    def literal(text):
        return "".join(f"{re.escape(w)} " for w in L.words_of(text)[0])

    out = []
    parts = L.MARKUP.split(template)
    for i, part in enumerate(parts):
        if i % 2 == 0:
            out.append(literal(part))
        elif part == "beginOptional":
            out.append("(?:")
        elif part == "endOptional":
            out.append(")?")
        else:
            match = re.search('match="([^"]*)"', part)[1]
            if m := re.fullmatch(r"\.\{(\d+),(\d+)\}", match):
                out.append(r"(?:\S+ ){%s,%s}" % m.groups())
            elif match == ".+":
                until = "".join(f"{re.escape(w)} " for w in L.words_of(parts[i + 1])[0][:2])
                out.append(rf"(?:(?!{until})\S+ )+")
            else:
                out.append("(?:" + "|".join(map(literal, match.split("|"))) + ")")
    return re.compile("".join(out))


def brute(words, templates):
    """For every place and licence the longest match, by trying every end."""
    out = {}
    for i in range(len(words)):
        for n, (_, _, texts) in enumerate(templates):
            for end in range(len(words), i, -1):
                if any(expression(t).fullmatch("".join(f"{w} " for w in words[i:end])) for t in texts):
                    out[i, n] = end
                    break
    return out


SMALL = (
    ("A", "x", ('a b <<beginOptional>>c <<var;name="v";match=".{0,2}">> d<<endOptional>> a', "a b b")),
    ("B", "y", ('b <<var;name="v";match="c|c d|a">> <<beginOptional>>a<<endOptional>> c', '<<beginOptional>>d<<endOptional>> a b <<var;name="w";match=".+">> d d')),
    ("C", "z", ('b b <<var;name="w";match=".+">> a c', 'd c <<var;name="w";match=".+">> b')),
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12))
def test_small_templates_against_expressions(words):
    own = L.Automaton(SMALL)
    _, h = L.words_of(" ".join(words))
    import numpy as np

    h = np.array(h, np.uint64)
    got = {(i, n): end for i in range(len(words)) for n, end in own.longest(h, i, len(words)).items()}
    assert got == brute(words, SMALL)
    found = own.matches(np.zeros(len(words), np.int64), h, 1)
    every = {(i, end, n) for (i, n), end in got.items()}
    best = {(i, e, n) for i, e, n in every if not any((a <= i and e <= b) and (a, b) != (i, e) for a, b, _ in every)}
    assert {(f, e, n) for _, n, f, e in found} == best


MIT = re.sub(r"<<var;name=\"holder\"[^<]*>>", "THE AUTHORS", license_templates._MIT)
MIT = re.sub(r"<<var;name=\"what\"[^<]*>>", "this software and associated documentation files", MIT)
MIT = re.sub(r"<<\w+>>", " ", MIT)


def names(text):
    out = L.scan_batch(pa.record_batch([pa.array([1]), pa.array([text])], names=["doc_id", "text"]), L.automaton())
    return out.column("license").to_pylist()


def test_whole_texts_and_changed_ones():
    assert names(f"// {MIT.lower()} //\nint main() {{}}") == ["MIT"]
    assert names(MIT.replace("free of charge", "for a fee")) == []
    assert names("Licensed under CC BY-NC 4.0. All rights reserved.") == ["CC-BY-NC-4.0", "All-Rights-Reserved"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("This work is licensed under a GNU General Public License, version 3.") == []
    assert names("Licensed under the Apache License") == []
    assert names("") == [] and names(None) == []


def test_wrong_templates_are_refused():
    for text in ("a <<beginOptional>> b", "a b <<endOptional>>", 'a b <<var;name="x";match=".+">>', '<<var;name="x";match=".+">> a b', 'a b <<var;name="x">> c', "a"):
        with pytest.raises(ValueError):
            L.Automaton((("X", "x", (text,)),))


def test_rough_rows(spark, rough, none):
    assert L.scan(rough).collect() == [] and L.scan(none).collect() == []
    docs = spark.createDataFrame([(None, "Released under the MIT License."), (1, "word " * 200_000 + "All rights reserved"), (1, "word " * 200_000 + "All rights reserved")], "doc_id bigint, text string")
    got = L.scan(docs).collect()
    assert [(r.doc_id, r.license, r.first_word) for r in got] == [(None, "MIT", 0), (1, "All-Rights-Reserved", 200_000), (1, "All-Rights-Reserved", 200_000)]


def test_whole_table_against_lines(spark):
    sf = "/root/testdata/sf0.01"
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "All-Rights-Reserved"}
    want = sorted((r.doc_id, lines[x]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in r.text.split("\n") if x in lines)
    assert sorted((r.doc_id, r.license) for r in L.query(spark, sf).collect()) == want


def filled(template, **names):
    """The template as a text: the variables of the given names, else the first alternative; options left out."""
    template = re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>", " ", template)
    return re.sub(r'<<var;name="(\w+)";match="([^"]*)">>', lambda m: names.get(m[1], "Some One" if m[2].startswith(".") else m[2].split("|")[0]), template)


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Unlicense", "MPL-2.0", "Zlib", "BSL-1.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"])
def test_a_text_altered_in_its_last_clause_is_none(name):
    for text in {n: t for n, _, t in license_templates.TEMPLATES}[name]:
        words = filled(text).split()
        if 30 < len(words) < 800:
            assert names(" ".join(words)) == [name]
            assert names(" ".join([*words[:-3], "changed", *words[-2:]])) == []
            assert names(" ".join(words[:-3])) == []


def test_standard_notices_and_tags():
    notice = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
    Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
    version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
    You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free
    Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""
    assert names(notice) == ["LGPL-2.1"]
    affero = notice.replace("Lesser", "Affero").replace("library", "program").replace("2.1", "3")
    assert names(affero) == ["AGPL-3.0"]
    assert names("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0") == ["EPL-2.0"]
    for tag, want in (("MIT", "MIT"), ("MIT-0", "MIT-0"), ("LGPL-2.1-or-later", "LGPL-2.1"), ("0BSD", "0BSD"), ("CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0")):
        assert names(f"# SPDX-License-Identifier: {tag}") == [want]


def test_names_run_to_the_next_mandatory_word():
    text = {n: t for n, _, t in license_templates.TEMPLATES}["BSD-3-Clause"][0]
    long = " ".join(["Institute of Very Long Names"] * 30)
    once = filled(text, holder=long, organisation=long)
    assert names(once) == ["BSD-3-Clause"]
    assert names(f"{once} and {filled(text)}") == ["BSD-3-Clause", "BSD-3-Clause"]


def test_isc_and_mpl_need_their_last_clauses():
    isc = """Copyright (c) 2020, Some One. Permission to use, copy, modify, and/or distribute this software for any purpose with or
    without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
    SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
    CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
    assert names(isc) == ["ISC"] and names(mpl) == ["MPL-2.0"]
    assert names(isc.replace("USE OR PERFORMANCE", "USE")) == [] and names(isc[: isc.index("IN NO EVENT")]) == []
    assert names(mpl.replace("was not", "was")) == []
    assert names("This is free and unencumbered software released into the public domain, for a fee.") == []


def test_refusals_are_none():
    assert names("This work is not licensed under the GNU General Public License, version 3.") == []
    for text in ("It isn't licensed under the MIT License.", "never, in any form, released under the MIT License", "no longer distributed or licensed under the MIT License", "was not\nlicensed under the MIT License"):
        assert names(text) == [], text
    assert names("It costs nothing, or not. Licensed under the MIT License.") == ["MIT"]
    assert names("It was not\nReleased under the MIT License.") == ["MIT"]
    assert names("Not only for some, but for all and for ever: licensed under the MIT License.") == ["MIT"]


def read(name):
    from importlib import resources

    return (resources.files("foliospark.llm") / "license_texts" / f"{name}.txt").read_text().split("\n%%\n")


@pytest.mark.parametrize("name", license_templates._LONG + ("GPL-1.0", "LGPL-2.0", "MPL-1.1", "GFDL-1.2", "GFDL-1.3", "Artistic-1.0-Perl"))
def test_long_texts_whole_bare_and_altered(name):
    head, body, tail = read(name)
    assert names(" ".join((head, body, tail))) == [name]
    assert names(f"words before {body}") == [name]
    words = body.split()
    assert len(words) > 900
    assert name not in names(" ".join([*words[:-2], "changed", *words[-1:]]))
    assert name not in names(" ".join([*words[:700], "changed", *words[701:]]))
    assert name not in names(" ".join(words[: len(words) // 2]))


def test_many_beginnings_take_one_pass():
    import time

    text = "in no event permission is hereby granted free of charge " * 40_000 + "Redistribution and use in source " * 20_000
    began = time.perf_counter()
    assert names(text + MIT) == ["MIT"]
    assert time.perf_counter() - began < 20


def test_a_name_may_hold_the_next_mandatory_word():
    text = filled(license_templates._MIT, holder="THE WILL BE AUTHORS")
    assert names(text) == ["MIT"]
