"""Licence texts and notices as templates in the usual template markup.

``<<beginOptional>> ... <<endOptional>>`` may be absent; ``<<var;name="...";match="...">>`` stands for replaceable
words: ``.+`` for those up to the next two mandatory ones, however many, ``.{a,b}`` for a to b words, and ``x|y`` for one
of the alternatives. All else is mandatory. Punctuation and case don't count. A line of copyright before a text isn't part of it.

The long texts are files in license_texts: what may stand before, the text, and what may follow, parted by lines of ``%%``.
"""

from __future__ import annotations

import re
from importlib import resources

_MIT = (
    '<<beginOptional>>The MIT License<<endOptional>> <<beginOptional>>MIT License<<endOptional>>'
    '<<beginOptional>>(MIT)<<endOptional>>'
    " Permission is hereby granted, free of charge,"
    " to any person obtaining a copy of"
    ' <<var;name="what";match="this software and associated documentation files|this software">>'
    ' <<beginOptional>>(the "Software")<<endOptional>>,'
    " to deal in the Software without restriction,"
    " including without limitation the rights to"
    " use, copy, modify, merge, publish, distribute,"
    " sublicense, and/or sell copies of the Software,"
    " and to permit persons to whom the Software"
    " is furnished to do so, subject to the"
    " following conditions: The above copyright notice"
    " and this permission notice"
    " <<beginOptional>>(including the next paragraph)<<endOptional>>"
    " shall be included in all copies or"
    " substantial portions of the Software."
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT'
    " WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
    " INCLUDING BUT NOT LIMITED TO THE WARRANTIES"
    " OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
    ' PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL'
    ' <<var;name="holder";match=".+">> BE LIABLE FOR ANY'
    " CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN"
    " AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH"
    " THE SOFTWARE OR THE USE OR OTHER DEALINGS"
    " IN THE SOFTWARE."
)

_BSD_HEAD = (
    " Redistribution and use in source and binary forms,"
    " with or without modification, are permitted provided"
    " that the following conditions are met:"
    ' <<beginOptional>><<var;name="bullet";match="1|a">><<endOptional>>'
    ' Redistributions of source code must retain the <<beginOptional>>above<<endOptional>>'
    " copyright notice, this list of conditions and"
    " the following disclaimer."
    ' <<beginOptional>><<var;name="bullet";match="2|b">><<endOptional>>'
    " Redistributions in binary form must reproduce the"
    " <<beginOptional>>above<<endOptional>> copyright notice, this list of conditions"
    " and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    ' <<beginOptional>><<var;name="bullet";match="3|c">><<endOptional>>'
    ' Neither the name of <<var;name="organisation";match=".+">> nor the names of'
    ' <<var;name="its";match="its|their">> contributors may be used to endorse'
    " or promote products derived from this software"
    " without specific prior written permission."
)
_BSD_TAIL = (
    ' THIS SOFTWARE IS PROVIDED BY <<var;name="holder";match=".+">> "AS IS"'
    " AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,"
    " BUT NOT LIMITED TO, THE IMPLIED WARRANTIES"
    " OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR"
    " PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL"
    ' <<var;name="holder";match=".+">> BE LIABLE FOR ANY DIRECT,'
    " INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL"
    " DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT"
    " OF SUBSTITUTE GOODS OR SERVICES; LOSS OF"
    " USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF"
    " LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR"
    " TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN"
    " ANY WAY OUT OF THE USE OF"
    " THIS SOFTWARE, EVEN IF ADVISED OF THE"
    " POSSIBILITY OF SUCH DAMAGE."
)

_ISC_GRANT = (
    " Permission to use, copy, modify,"
    ' <<var;name="and";match="and/or|and">> distribute this software for any'
    " purpose with or without fee is hereby granted"
)
_ISC_TAIL = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";match=".+">>'
    " DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS"
    " SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL"
    ' <<var;name="holder";match=".+">> BE LIABLE FOR ANY'
    " SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR"
    " ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF"
    " USE, DATA OR PROFITS, WHETHER IN AN"
    " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS"
    " ACTION, ARISING OUT OF OR IN CONNECTION"
    " WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC = (
    "<<beginOptional>>ISC License<<endOptional>>" + _ISC_GRANT + ", provided that the above copyright notice and"
    " this permission notice appear in all copies." + _ISC_TAIL
)
_0BSD = "<<beginOptional>>BSD Zero Clause License<<endOptional>>" + _ISC_GRANT + "." + _ISC_TAIL

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain."
    " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,"
    " either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all"
    " copyright interest in the software to the public domain."
    " We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."
    " We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to"
    " this software under copyright law."
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO'
    " THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"
    ' <<var;name="holder";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF'
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS"
    " IN THE SOFTWARE."
    ' <<beginOptional>>For more information, please refer to <<var;name="url";match="https|http">> unlicense.org<<endOptional>>'
)

_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    " If a copy of the MPL was not distributed with this file, You can obtain one at"
    ' <<var;name="url";match="https|http">> <<beginOptional>>www<<endOptional>> mozilla.org/MPL/2.0/'
)

_ZLIB = (
    " This software is provided 'as-is', without any express or implied warranty. In no event will"
    ' <<var;name="holder";match=".+">> be held liable for any damages arising from the use of this software.'
    " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to"
    " alter it and redistribute it freely, subject to the following restrictions:"
    ' <<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that'
    " you wrote the original software. If you use this software in a product, an"
    ' <<var;name="spelling";match="acknowledgment|acknowledgement">> in the product documentation would be appreciated but'
    " is not required."
    " <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be"
    " misrepresented as being the original software."
    " <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution."
)

_BOOST = (
    "<<beginOptional>>Boost Software License - Version 1.0 - August 17th, 2003<<endOptional>>"
    " Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
    ' accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,'
    " and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the"
    " Software is furnished to do so, all subject to the following:"
    " The copyright notices in the Software and this entire statement, including the above license grant, this restriction"
    " and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative"
    " works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code"
    " generated by a source language processor."
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE"
    " COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN"
    " THE SOFTWARE."
)


def _gnu(kind: str, version: str) -> tuple[str, ...]:
    """The one-line grants and the standard notice of a GNU licence."""
    name, what = f"GNU {kind} General Public License", '<<var;name="what";match="program|library|software|file">>'
    line = f"under the <<beginOptional>>terms of the<<endOptional>> {name}<<beginOptional>>,<<endOptional>> version {version}"
    return (
        f'{_GRANTED} <<var;name="verb";match="licensed|released|distributed">> {line}',
        f"Licensed {line}",
        f"<<beginOptional>>This<<endOptional>> {what} is free software; you can redistribute it and/or modify it under the terms of the {name}"
        f" as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
        f" <<beginOptional>>This<<endOptional>> {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        f" implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
        f" You should have received a copy of the {name} along with this {what}"
        ' <<beginOptional>>If not, see <<var;name="url";match="https|http">> www.gnu.org/licenses<<endOptional>>'
        " <<beginOptional>>if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA<<endOptional>>",
    )


def _tag(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {n}" for n in names)


_GRANTED = '<<var;name="subject";match="This work|This software|This program|This file|This project|This document|This code|This content">> is'
_APACHE_NAME = 'Apache License<<beginOptional>>,<<endOptional>> <<beginOptional>>Version<<endOptional>> <<var;name="version";match="2.0|v2.0|2">>'

_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License <<beginOptional>><<var;name=\"v\";match=\"v|version\">><<endOptional>>"
_LATER = ("", "-only", "-or-later")

_TEXTS = (
    ("MIT", "permissive", (_MIT, 'Released under the MIT <<beginOptional>>open source<<endOptional>> License', "Licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License", f"{_GRANTED} <<var;name=\"verb\";match=\"licensed|released|distributed\">> under the <<beginOptional>>terms of the<<endOptional>> MIT License")),
    ("BSD-2-Clause", "permissive", (_BSD_HEAD + _BSD_TAIL,)),
    ("BSD-3-Clause", "permissive", (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL,)),
    ("ISC", "permissive", (_ISC,)),
    (
        "Apache-2.0",
        "permissive",
        (
            f'Licensed under the {_APACHE_NAME} <<beginOptional>>(the "License"); you may not use'
            ' <<var;name="what";match=".+">> except in compliance with the License<<endOptional>>',
            f"Released under the {_APACHE_NAME}",
            f'{_GRANTED} <<var;name="verb";match="licensed|released|distributed">> under the {_APACHE_NAME}',
        ),
    ),
    (
        "GPL-3.0",
        "copyleft",
        (
            f'{_GRANTED} <<var;name="verb";match="licensed|released|distributed">> under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>>,<<endOptional>> version 3<<beginOptional>>.0<<endOptional>>',
            "Licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>>,<<endOptional>> version 3<<beginOptional>>.0<<endOptional>>",
            "This program is free software: you can"
            " redistribute it and/or modify it under the"
            " terms of the GNU General Public License"
            ' as published by the Free Software Foundation, either version 3 of the License,'
            ' <<var;name="later";match="or at your option any later version|or (at your option) any later version">>',
        ),
    ),
    (
        "GPL-2.0",
        "copyleft",
        (
            f'{_GRANTED} <<var;name="verb";match="licensed|released|distributed">> under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>>,<<endOptional>> version 2<<beginOptional>>.0<<endOptional>>',
            "Licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>>,<<endOptional>> version 2<<beginOptional>>.0<<endOptional>>",
            "This program is free software; you can"
            " redistribute it and/or modify it under the"
            " terms of the GNU General Public License"
            ' as published by the Free Software Foundation; either version 2 of the License',
        ),
    ),
    ("LGPL-2.1", "weak copyleft", _gnu("Lesser", "2.1")),
    ("LGPL-3.0", "weak copyleft", _gnu("Lesser", "3") + _gnu("Lesser", "3.0")),
    ("AGPL-3.0", "copyleft", _gnu("Affero", "3") + _gnu("Affero", "3.0")),
    ("Zlib", "permissive", (_ZLIB,)),
    ("0BSD", "permissive", (_0BSD,)),
    ("BSL-1.0", "permissive", (_BOOST, "Distributed under the Boost Software License, Version 1.0")),
    ("EPL-1.0", "weak copyleft", (f"{_EPL} 1.0", f"{_EPL} v1.0")),
    ("EPL-2.0", "weak copyleft", (f"{_EPL} 2.0", f"{_EPL} v2.0")),
    ("MPL-2.0", "weak copyleft", (_MPL,)),
    ("Unlicense", "public domain", (_UNLICENSE,)),
    ("CC0-1.0", "public domain", ("Licensed under <<beginOptional>>the<<endOptional>> CC0 <<beginOptional>>1.0<<endOptional>>", f"{_GRANTED} <<var;name=\"verb\";match=\"licensed|released\">> under CC0 <<beginOptional>>1.0<<endOptional>>")),
    *(
        (
            f"CC-{kind}-4.0",
            category,
            (
                f"Licensed under <<beginOptional>>the<<endOptional>> CC {kind} 4.0",
                f'{_GRANTED} <<var;name="verb";match="licensed|released">> under <<beginOptional>>the<<endOptional>> CC {kind} 4.0',
                f'{_GRANTED} <<var;name="verb";match="licensed|released">> under <<var;name="article";match="a|the">> Creative Commons {words} 4.0 International License',
                f"Licensed under <<beginOptional>>a<<endOptional>> Creative Commons {words} 4.0 International <<beginOptional>>License<<endOptional>>",
            ),
        )
        for kind, words, category in (
            ("BY", "Attribution", "permissive"),
            ("BY-SA", "Attribution-ShareAlike", "copyleft"),
            ("BY-NC", "Attribution-NonCommercial", "non-commercial"),
            ("BY-ND", "Attribution-NoDerivatives", "no derivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "non-commercial"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "non-commercial"),
        )
    ),
    ("All-Rights-Reserved", "proprietary", ("All rights reserved",)),
)



def _whole(name: str) -> str:
    """A long text as a template: its head and tail are optional, and links may go by either scheme."""
    head, body, tail = (resources.files("foliospark.llm") / "license_texts" / f"{name}.txt").read_text(encoding="utf-8").split("\n%%\n")
    parts = (f"<<beginOptional>> {head} <<endOptional>>" if head.strip() else "", body, f"<<beginOptional>> {tail} <<endOptional>>" if tail.strip() else "")
    return re.sub(r"\bhttps?\b", '<<var;name="url";match="https|http">>', " ".join(parts))


_LONG = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
_TEXTS = tuple((name, category, (*texts, _whole(name)) if name in _LONG else texts) for name, category, texts in _TEXTS) + (
    ("GPL-1.0", "copyleft", (_whole("GPL-1.0"),)),
    ("LGPL-2.0", "weak copyleft", (*_gnu("Library", "2"), *_gnu("Library", "2.0"), _whole("LGPL-2.0"))),
    ("MPL-1.1", "weak copyleft", (_whole("MPL-1.1"),)),
    ("GFDL-1.2", "copyleft", (_whole("GFDL-1.2"),)),
    ("GFDL-1.3", "copyleft", (_whole("GFDL-1.3"),)),
    ("Artistic-1.0-Perl", "permissive", (_whole("Artistic-1.0-Perl"),)),
)

#: (identifier, category, templates), each with its tags; the last ones have only tags, so that no shorter one stands for them.
TEMPLATES = (
    *((name, category, texts + (() if name == "All-Rights-Reserved" else _tag(*(name + x for x in (_LATER if "GPL" in name or "GFDL" in name else ("",)))))) for name, category, texts in _TEXTS),
    *((name, "permissive", _tag(name)) for name in ("MIT-0", "BSD-2-Clause-Patent", "BSD-3-Clause-Clear", "BSD-3-Clause-LBNL")),
)
