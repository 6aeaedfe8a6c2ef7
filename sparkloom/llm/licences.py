"""Licence scan by sentence rules, in DataFrame functions only.

A text loses the comment signs and bullets at its lines' beginnings and is cut into sentences at full stops, semicolons, colons,
question or exclamation marks before white space, and at blank lines. Its normal form is ASCII letters and digits in
lower case with one space between runs; line ends stay as marks. A known sentence (``SENTENCES``) begins and
ends at a cut or a line end and may go over any number of lines. Known ones map to sentence identifiers; ``PATTERNS`` name sentences
with free parts, on one line. A document's
identifiers, in order, are matched against ``RULES``: an identifier sequence in a row stands for a licence.
Rules apply in their order, so longer sequences come first, and what a rule matched is taken away. Copyright and
reservation notices are read past when sequences are matched. Identifiers that no rule took are left over.

Every known sentence has an anchor within one of its words, so texts without any can't hold one and aren't cut. Everything is
done within a row, nothing is shuffled. Null and empty texts have no sentences. Upper case means A-Z.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normal forms of sentences in public licence texts and notices, by identifier.
SENTENCES = {
    "APACHE2-SHORT": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "APACHE2-MAYNOT": ["you may not use this file except in compliance with the license"],
    "APACHE2-OBTAIN": ["you may obtain a copy of the license at"],
    "APACHE2-ASIS": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "APACHE2-SEE": ["see the license for the specific language governing permissions and limitations under the license"],
    "MIT-SHORT": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "MIT-GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT-NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MIT-ASIS": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MIT-LIABLE": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "BSD-GRANT": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD-SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD-BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD-SHORT": ["licensed under the bsd license", "released under the bsd license", "licensed under the bsd 3 clause license"],
    "GPL-SHORT2": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "GPL-SHORT3": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "GPL-FREE": ["this program is free software"],
    "GPL-MAY2": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "GPL-OR3": ["either version 3 of the license or at your option any later version"],
    "GPL-OR2": ["either version 2 of the license or at your option any later version"],
    "GPL-HOPE": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "GPL-MERCH": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GPL-SEE": ["see the gnu general public license for more details"],
    "LGPL-SHORT": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1"],
    "MPL2-SUBJECT": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "MPL2-OBTAIN": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "BSD-NAME": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD-ASIS": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "BSD-LIABLE": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"],
    "BSD-CAUSED": ["or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "LGPL-MAY": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "LGPL-OR21": ["either version 2 1 of the license or at your option any later version"],
    "LGPL-LIBRARY": ["this library is free software"],
    "LGPL-HOPE": ["this library is distributed in the hope that it will be useful but without any warranty"],
    "LGPL-SEE": ["see the gnu lesser general public license for more details"],
    "AGPL-MAY": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "AGPL-SEE": ["see the gnu affero general public license for more details"],
    "AGPL-SHORT3": ["licensed under the gnu affero general public license version 3"],
    "EPL2-MADE": ["this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at http www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "ZLIB-ASIS": ["this software is provided as is without any express or implied warranty"],
    "ZLIB-LIABLE": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "ZLIB-GRANT": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "ZLIB-ORIGIN": ["the origin of this software must not be misrepresented"],
    "ZLIB-ALTERED": ["altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
    "ZLIB-NOTICE": ["this notice may not be removed or altered from any source distribution"],
    "BOOST-SHORT": ["distributed under the boost software license version 1 0"],
    "BOOST-GRANT": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "ISC-ASIS": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "ISC-LIABLE": ["in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "ZERO-GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "UNLICENSE-ANYONE": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "ISC-GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "UNLICENSE-FREE": ["this is free and unencumbered software released into the public domain"],
    "CC-BY-NC4": ["licensed under cc by nc 4 0"],
    "CC-BY-SA4": ["licensed under cc by sa 4 0"],
    "CC-BY-ND4": ["licensed under cc by nd 4 0"],
    "CC-BY-NC-SA4": ["licensed under cc by nc sa 4 0"],
    "CC-BY4": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC0": ["licensed under cc0 1 0", "dedicated to the public domain under cc0 1 0"],
    "RESERVED": ["all rights reserved"],
}
# Normal forms with free parts, on one line.
PATTERNS = {"COPYRIGHT": r"copyright(?: c)?(?: [0-9]{4})+(?: [a-z0-9 ]*)?"}
#: Ordered rules: licence and identifier sequence.
RULES = [
    ("Apache-2.0", ["APACHE2-SHORT", "APACHE2-MAYNOT", "APACHE2-OBTAIN", "APACHE2-ASIS", "APACHE2-SEE"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE", "MIT-ASIS", "MIT-LIABLE"]),
    ("BSD-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAME", "BSD-ASIS", "BSD-LIABLE", "BSD-CAUSED"]),
    ("BSD-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAME"]),
    ("BSD-2-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ASIS", "BSD-LIABLE", "BSD-CAUSED"]),
    ("BSD-2-or-3-Clause", ["BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"]),
    ("ISC", ["ISC-GRANT", "ISC-ASIS", "ISC-LIABLE"]),
    ("0BSD", ["ZERO-GRANT", "ISC-ASIS", "ISC-LIABLE"]),
    ("Zlib", ["ZLIB-ASIS", "ZLIB-LIABLE", "ZLIB-GRANT", "ZLIB-ORIGIN", "ZLIB-ALTERED", "ZLIB-NOTICE"]),
    ("AGPL-3.0-or-later", ["GPL-FREE", "AGPL-MAY", "GPL-OR3", "GPL-HOPE", "GPL-MERCH", "AGPL-SEE"]),
    ("LGPL-3.0-or-later", ["GPL-FREE", "LGPL-MAY", "GPL-OR3", "GPL-HOPE", "GPL-MERCH", "LGPL-SEE"]),
    ("LGPL-2.1-or-later", ["LGPL-LIBRARY", "LGPL-MAY", "LGPL-OR21", "LGPL-HOPE", "GPL-MERCH", "LGPL-SEE"]),
    ("Unlicense", ["UNLICENSE-FREE", "UNLICENSE-ANYONE"]),
    ("GPL-3.0-or-later", ["GPL-FREE", "GPL-MAY2", "GPL-OR3", "GPL-HOPE", "GPL-MERCH", "GPL-SEE"]),
    ("GPL-2.0-or-later", ["GPL-FREE", "GPL-MAY2", "GPL-OR2", "GPL-HOPE", "GPL-MERCH", "GPL-SEE"]),
    ("GPL-3.0-or-later", ["GPL-FREE", "GPL-MAY2", "GPL-OR3"]),
    ("GPL-2.0-or-later", ["GPL-FREE", "GPL-MAY2", "GPL-OR2"]),
    ("MPL-2.0", ["MPL2-SUBJECT", "MPL2-OBTAIN"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE"]),
    ("Apache-2.0", ["APACHE2-SHORT"]),
    ("MIT", ["MIT-SHORT"]),
    ("BSD", ["BSD-SHORT"]),
    ("GPL-2.0", ["GPL-SHORT2"]),
    ("GPL-3.0", ["GPL-SHORT3"]),
    ("LGPL", ["LGPL-SHORT"]),
    ("MPL-2.0", ["MPL2-SUBJECT"]),
    ("ISC", ["ISC-GRANT"]),
    ("Unlicense", ["UNLICENSE-FREE"]),
    ("EPL-2.0", ["EPL2-MADE"]),
    ("BSL-1.0", ["BOOST-GRANT"]),
    ("BSL-1.0", ["BOOST-SHORT"]),
    ("AGPL-3.0", ["AGPL-SHORT3"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC4"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA4"]),
    ("CC-BY-ND-4.0", ["CC-BY-ND4"]),
    ("CC-BY-NC-SA-4.0", ["CC-BY-NC-SA4"]),
    ("CC-BY-4.0", ["CC-BY4"]),
    ("CC0-1.0", ["CC0"]),
]
#: Notices that sequences are read past.
NOTICES = ["COPYRIGHT", "RESERVED"]
#: Every known sentence has one of these within a word; they're looked for before a text is cut.
ANCHORS = ["licens", "permission", "redistribut", "copyright", "warrant", "reserved", "unencumbered", "liable", "software", "cc0", "mozilla", "misrepresented", "altered", "liability"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks of a cut and of a line end. They are doubled, so that two sentences side by side have one each.
HARD, SOFT = "\x01\x01", "\n\n"
#: What makes the normal form: (pattern, replacement) in turn, of a text in lower case with a line end behind it. ``(1)`` is the first group.
STEPS = [
    ("\x01", " "),
    ("\r\n?", "\n"),
    (r"(^|\n)[ \t]*(?:(?://+|/\*+|\*+/|[*#;%!>]+|-+|\.\.)[ \t]*)+", "(1)"),
    (r"[.;:!?]+[ \t]+|[.;:!?]+\n|\n[ \t]*\n", "\x01"),
    (r"[^a-z0-9\n\x01]+", " "),
    (r"[ \n]*\x01[ \n\x01]*", HARD),
    (r" *\n[ \n]*", SOFT),
]


def _anchored() -> bool:
    return all(any(a in s for a in ANCHORS) for forms in SENTENCES.values() for s in forms)


def sentence_pattern() -> str:
    """A known sentence between two marks, the longest first."""
    forms = sorted((s for forms in SENTENCES.values() for s in forms), key=len, reverse=True)
    return "[\\n\\x01](" + "|".join([*(s.replace(" ", "(?: |\\n\\n)") for s in forms), *PATTERNS.values()]) + ")[\\n\\x01]"


def _steps(text: Column) -> Column:
    for pattern, new in STEPS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(new.replace("(1)", "$1")))
    return text


def scan_licences(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text; others ignored) to doc_id, n_sentences (known ones), sentence_ids (in order, joined by
    ','), licences (in the order of the rules, joined by ';', each once), left_over (identifiers that no rule took, by ','). Repeated rows
    repeat; an empty table gives no rows."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    # at least as many texts as by ``low``, which takes far longer
    hopeful = reduce(Column.__or__, (F.lower(F.coalesce("text", F.lit(""))).contains(a) for a in ANCHORS))
    marked = F.concat(F.lit(HARD), F.ltrim(_steps(F.concat(low, F.lit("\n")))), F.lit(HARD))
    found = F.when(hopeful, F.regexp_extract_all(marked, F.lit(sentence_pattern()), F.lit(1))).otherwise(F.array().cast("array<string>"))
    known = F.create_map(*(F.lit(x) for i, forms in SENTENCES.items() for s in forms for x in (s, i)))

    def identify(s: Column) -> Column:
        by_pattern = reduce(lambda c, p: c.when(s.rlike(f"^{p[1]}$"), F.lit(p[0])), PATTERNS.items(), F)
        return F.coalesce(F.element_at(known, F.replace(s, F.lit(SOFT), F.lit(" "))), by_pattern)

    at = docs.select("doc_id", F.transform(found, identify).alias("_ids"))
    plain = F.filter("_ids", lambda x: ~x.isin(NOTICES))
    # each identifier between commas of its own, so that sequences can be taken away
    state = F.when(F.size(plain) > 0, F.concat(F.lit(","), F.array_join(plain, ",,"), F.lit(","))).otherwise(F.lit(""))
    at = at.withColumn("_left", state).withColumn("_found", F.array().cast("array<string>"))
    for licence, sequence in RULES:
        rule = F.lit("".join(f",{x}," for x in sequence))
        hit = F.col("_left").contains(rule)
        found = F.when(hit, F.array_union("_found", F.array(F.lit(licence)))).otherwise(F.col("_found"))
        at = at.select("doc_id", "_ids", F.when(hit, F.replace("_left", rule, F.lit("|"))).otherwise(F.col("_left")).alias("_left"), found.alias("_found"))
    left = F.array_join(F.array_remove(F.split("_left", "[|,]+"), ""), ",")
    return at.select("doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join("_found", ";").alias("licences"), left.alias("left_over"))


def scan_sql(documents: str = "documents") -> str:
    """The same in DuckDB SQL."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    keys = ", ".join(q(s) for forms in SENTENCES.values() for s in forms)
    values = ", ".join(q(i) for i, forms in SENTENCES.items() for _ in forms)
    text = f"concat(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10))"
    for pattern, new in STEPS:
        new = q(new.replace("(1)", "\\1")) if new.isprintable() else " || ".join(f"chr({ord(c)})" for c in new)
        text = f"regexp_replace({text}, {q(pattern.replace(chr(1), '[\\x01]').replace(chr(13), '\\r').replace(chr(10), '\\n'))}, {new}, 'g')"
    patterns = " ".join(f"when regexp_full_match(s, {q(p)}) then {q(i)}" for i, p in PATTERNS.items())
    steps, name = [], "s0"
    for n, (licence, sequence) in enumerate(RULES, 1):
        rule = q("".join(f",{x}," for x in sequence))
        steps.append(f"s{n} as (select doc_id, ids, replace(rest, {rule}, '|') rest, case when contains(rest, {rule}) and not list_contains(found, {q(licence)}) then list_append(found, {q(licence)}) else found end found from {name})")
        name = f"s{n}"
    notices = ", ".join(q(x) for x in NOTICES)
    return f"""
        with known as (select unnest([{keys}]) k, unnest([{values}]) v),
        cut as (select doc_id, regexp_extract_all(chr(1) || chr(1) || ltrim({text}) || chr(1) || chr(1), {q(sentence_pattern())}, 1) x from {documents}),
        each as (select doc_id, replace(unnest(x), chr(10) || chr(10), ' ') s, generate_subscripts(x, 1) n from cut),
        named as (select doc_id, n, coalesce(v, case {patterns} end) id from each left join known on s = k),
        ids as (select doc_id, list(id order by n) ids from named group by doc_id),
        s0 as (select doc_id, coalesce(ids, []) ids, list_filter(coalesce(ids, []), lambda x: x not in ({notices})) plain,
            case when len(plain) > 0 then concat(',', array_to_string(plain, ',,'), ',') else '' end rest, []::varchar[] found from {documents} left join ids using (doc_id)),
        {', '.join(steps)}
        select doc_id, cast(len(ids) as bigint) n_sentences, coalesce(array_to_string(ids, ','), '') sentence_ids, coalesce(array_to_string(found, ';'), '') licences,
            coalesce(array_to_string(list_filter(regexp_split_to_array(rest, '[|,]+'), lambda x: x <> ''), ','), '') left_over from {name}"""
