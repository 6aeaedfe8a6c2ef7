"""Licence texts as they stand in source files: wrapped at some width, behind comment signs."""

from __future__ import annotations

import textwrap

import duckdb
import pytest

from sparkloom.llm import licences

ASIS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT = [
    "MIT License",
    "Copyright (c) 2021 Some One",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ASIS,
]
ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
ISC = ["Copyright 2020 A Person", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ISC_END]
ZERO = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ISC_END]
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD2 = [
    "Copyright (c) 2019, A Company",
    "All rights  reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    BSD_END,
]
BSD3 = [*BSD2[:5], "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", BSD_END]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
GNU = [
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation; either version {3} of the License, or (at your option) any later version.",
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details.",
]
ZLIB = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "3. This notice may not be removed or altered from any source distribution.",
]
BOOST = ["Boost Software License - Version 1.0 - August 17th, 2003", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:']
UNLICENSE = ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
EPL = ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"]
GENERAL = "General Public License"
TEXTS = {
    "MIT": MIT,
    "ISC": ISC,
    "0BSD": ZERO,
    "BSD-2-Clause": BSD2,
    "BSD-3-Clause": BSD3,
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": [x.format("program", ":", GENERAL, "3") for x in GNU],
    "GPL-2.0-or-later": [x.format("program", ";", GENERAL, "2") for x in GNU],
    "LGPL-2.1-or-later": [x.format("library", ";", "Lesser " + GENERAL, "2.1") for x in GNU],
    "LGPL-3.0-or-later": [x.format("program", ":", "Lesser " + GENERAL, "3") for x in GNU],
    "AGPL-3.0-or-later": [x.format("program", ":", "Affero " + GENERAL, "3") for x in GNU],
    "Zlib": ZLIB,
    "BSL-1.0": BOOST,
    "Unlicense": UNLICENSE,
    "MPL-2.0": MPL,
    "EPL-2.0": EPL,
}


def written(paragraphs, width, sign, gap):
    out = []
    for p in paragraphs:
        out += [f"{sign}{x}".rstrip() for x in textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)]
        out += [sign.rstrip()] * gap
    return "\n".join(out)


@pytest.mark.parametrize("width, sign, gap", [(10_000, "", 1), (72, "", 1), (72, "// ", 1), (60, " * ", 1), (30, "# ", 1), (72, "", 0)])
def test_wrapped_and_commented_texts(spark, width, sign, gap):
    rows = [(n, written(t, width, sign, gap), name) for n, (name, t) in enumerate(TEXTS.items())]
    rows = [(n, f"Some words before\r\n\r\n{t}\n\nint main() {{ return 0; }}\n", name) for n, t, name in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = {r["doc_id"]: (r["licences"], r["left_over"]) for r in licences.scan_licences(docs).collect()}
    assert got == {n: (name, "") for n, _, name in rows}
    frame = docs.toPandas()  # noqa: F841
    assert sorted(duckdb.sql(licences.scan_sql("frame")).fetchall()) == sorted(tuple(r) for r in licences.scan_licences(docs).collect())


def test_sentences_of_a_long_text_in_order(spark):
    lines = ["Released under the MIT License", "word " * 200, "Licensed under CC BY 4.0", "See the license", "not Licensed under CC BY 4.0 at all", "ALL\u00a0RIGHTS  RESERVED"] * 3000
    got = licences.scan_licences(spark.createDataFrame([(1, "\n".join(lines)), (1, None)], "doc_id long, text string")).orderBy("n_sentences").collect()
    assert [r["n_sentences"] for r in got] == [0, 9000] and got[1]["licences"] == "MIT;CC-BY-4.0"
    assert got[1]["sentence_ids"].startswith("MIT-SHORT,CC-BY4,RESERVED,MIT-SHORT")
