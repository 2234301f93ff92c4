"""Licence recognition by sentence rules.

A text is split into pieces at lines' ends and closing marks, each normalised (lower case, letters and digits, single
spaces). A known licence sentence is met where neighbouring pieces together give its words, wherever its lines break or
marks stand inside; the longest counts. A licence is an ordered rule over sentence identifiers; rules are matched,
longest first, against the identifiers a text holds in order. Between two sentences of a rule up to ``gap``
sentences may stand that no rule knows (a copyright line, a heading).

Every known sentence holds one of ``ANCHORS``, so only texts with an anchor leave the JVM; no text is shortened.

Defined results: texts that are null, empty or without a known sentence give no rows; repeated rows give repeated
results; null ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

ANCHORS = ("licen", "permission", "warrant", "redistribut", "copyright", "domain", "released", "distributed", "reserved")  # single words: white space may be anything

#: Identifier -> sentences, as licences and their usual notices word them. Fixed values.
SENTENCES = {
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ],
    "mit-liable": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "mit-0-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "isc-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "isc-free": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "apache-text": ["Apache License Version 2.0, January 2004"],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "bsd-head": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-notice": ["Licensed under the BSD License", "Released under the BSD License"],
    "bsd-2-notice": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License"],
    "bsd-3-notice": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"],
    "bsd-as-is": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ],
    "bsd-liable": [
        f"IN NO EVENT SHALL THE COPYRIGHT {who} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
        for who in ("HOLDER", "HOLDERS", "OWNER")
    ],
    "gpl3-text": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-text": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl21-text": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-text": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl3-text": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0"],
    "boost-grant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    ],
    "mpl-text": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "epl-text": ["Eclipse Public License - v 2.0"],
    "epl-notice": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    ],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc0": ["Licensed under CC0 1.0", "This work is dedicated to the public domain", "This work is licensed under CC0 1.0"],
    "all-rights": ["All rights reserved"],
}

#: Licence -> ordered rules over identifiers.
RULES: dict[str, list[tuple[str, ...]]] = {
    "MIT": [("mit-title", "mit-grant", "mit-condition", "as-is", "mit-liable"), ("mit-grant", "mit-condition", "as-is", "mit-liable"), ("mit-title", "mit-grant", "mit-condition", "as-is"), ("mit-grant", "mit-condition", "as-is"), ("mit-title", "mit-grant", "mit-condition"), ("mit-grant", "mit-condition"), ("mit-grant",), ("mit-notice",)],
    "MIT-0": [("mit-0-grant", "as-is", "mit-liable"), ("mit-0-grant", "as-is")],
    "ISC": [("isc-grant", "isc-as-is"), ("isc-grant",)],
    "0BSD": [("isc-free", "isc-as-is")],
    "Apache-2.0": [("apache-text",), ("apache-notice", "apache-use", "apache-copy", "apache-as-is"), ("apache-notice", "apache-as-is"), ("apache-notice",)],
    "BSD-3-Clause": [("bsd-head", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liable"), ("bsd-head", "bsd-source", "bsd-binary", "bsd-names"), ("bsd-3-notice",)],
    "BSD-2-Clause": [("bsd-head", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable"), ("bsd-head", "bsd-source", "bsd-binary"), ("bsd-2-notice",)],
    "BSD": [("bsd-notice",)],
    "GPL-3.0-or-later": [("gpl-free", "gpl-hope"), ("gpl-free",)],
    "GPL-2.0-or-later": [("gpl2-free", "gpl-hope"), ("gpl2-free",)],
    "GPL-3.0": [("gpl3-text",)],
    "GPL-2.0": [("gpl2-text",)],
    "LGPL-2.1": [("lgpl21-text",)],
    "LGPL-3.0": [("lgpl3-text",)],
    "AGPL-3.0": [("agpl3-text",)],
    "LGPL-2.1-or-later": [("lgpl21-free", "lgpl-hope"), ("lgpl21-free",)],
    "LGPL-3.0-or-later": [("lgpl3-free", "lgpl-hope"), ("lgpl3-free",)],
    "AGPL-3.0-or-later": [("agpl-free", "gpl-hope"), ("agpl-free",)],
    "Zlib": [("zlib-as-is", "zlib-grant"), ("zlib-grant",)],
    "BSL-1.0": [("boost-title", "boost-grant", "as-is"), ("boost-title", "boost-grant"), ("boost-grant",), ("boost-title",), ("boost-notice",)],
    "EPL-2.0": [("epl-text",), ("epl-notice",)],
    "MPL-2.0": [("mpl-notice",), ("mpl-text",)],
    "Unlicense": [("unlicense",)],
    "CC0-1.0": [("cc0",)],
    "All-Rights-Reserved": [("all-rights",)],
}
# A licence's text often has this line between its copyright line and its grant.
for _name in ("MIT", "ISC", "BSD-3-Clause", "BSD-2-Clause"):
    RULES[_name] += [("all-rights", *rule) for rule in RULES[_name] if len(rule) > 1 and rule[0] != "mit-title"]

LEADS = ("Licensed under", "Released under", "This work is licensed under", "Distributed under")
for _name, _short, _versions in (("GNU General Public License", "GPL", ("2", "3")), ("GNU Lesser General Public License", "LGPL", ("2.1", "3")), ("GNU Affero General Public License", "AGPL", ("3",))):
    for _v in _versions:
        _key = f"{_short}-{_v if '.' in _v else _v + '.0'}-only"
        SENTENCES[_key] = [f"{lead} the {_name}, version {_v}" for lead in LEADS]
        RULES[_key] = [(_key,)]
for _kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _key = f"CC-{_kind}-{_v}"
        SENTENCES[_key] = [f"{lead} CC {_kind} {_v}" for lead in LEADS] + [f"{lead} a Creative Commons {_kind} {_v} License" for lead in LEADS]
        RULES[_key] = [(_key,)]

# The line that names a licence by its identifier, for all of them.
for _key in RULES:
    if _key not in ("BSD", "All-Rights-Reserved"):
        SENTENCES[f"spdx-{_key}"] = [f"SPDX-License-Identifier: {_key}"]
        RULES[_key].append((f"spdx-{_key}",))

#: A sentence ends at a line's end, or at a closing mark that white space follows; a mark within 2.0 or v3 does not.
ENDS = re.compile(r"[.!?;:]+(?=\s)|[.!?;:]*\s*\n\s*|[.!?;:]+\Z|, (?=you may not use)")
PLAIN = re.compile(r"[^a-z0-9]+")
WRAPPED = re.compile(r"(?<=[a-z,]) *\n *(?=[a-z\"(])")


def normalise(sentence: str) -> str:
    return PLAIN.sub(" ", sentence.lower()).strip()


KNOWN = {normalise(s): key for key, texts in SENTENCES.items() for s in texts}
assert all(any(a in s for a in ANCHORS) for s in KNOWN), "a known sentence without an anchor"
ORDERED = sorted(((rule, name) for name, rules in RULES.items() for rule in rules), key=lambda x: (-len(x[0]), x[1]))


STARTS = {s.split(" ", 1)[0] for s in KNOWN}
LISTED = sorted(KNOWN)
FIRST = re.compile(r"[a-z0-9]+")
#: What begins a line of a comment.
LEADER = re.compile(r"^[ \t]*(?:(?:#+|//+|/\*+|\*+/?|--+|;+|%+|>+|<!--+)(?=\s)|(?:dnl|rem|REM)(?=[ \t]))", re.M)


def pieces(text: str, lowered: str):
    """(begin, end, sentence) of every piece with letters or digits, in order. A line that goes on in lower case stays in its sentence."""
    wrapped = {m.start() for m in WRAPPED.finditer(text)}
    at, number = 0, 1
    for m in (*ENDS.finditer(text), None):
        end = m.start() if m else len(text)
        if words := FIRST.search(lowered, at, end):
            yield at, end, number, words[0]
        if m:
            number += end not in wrapped
            at = m.end()


def known_sentences(text: str):
    """(first sentence, last sentence, key, begin, end) of every known sentence, in order."""
    text = LEADER.sub(lambda m: " " * len(m[0]), text)
    lowered = text.lower() if len(text.lower()) == len(text) else re.sub("[A-Z]", lambda m: m[0].lower(), text)
    cut = list(pieces(text, lowered))
    at = 0
    while at < len(cut):
        best = None
        if cut[at][3] in STARTS:
            said = ""
            for k in range(at, len(cut)):
                said = f"{said} {normalise(lowered[cut[k][0] : cut[k][1]])}".lstrip()
                place = bisect_left(LISTED, said)
                if place < len(LISTED) and LISTED[place] == said:
                    best = k, KNOWN[said]
                    place += 1
                if place == bisect_left(LISTED, said + "!"):  # no known sentence goes on from here
                    break
        if best:
            begin, end = cut[at][0], cut[best[0]][1]
            yield cut[at][2], cut[best[0]][2], best[1], begin + len(text[begin:end]) - len(text[begin:end].lstrip()), end
            at = best[0]
        at += 1


def scan(text: str, gap: int = 3) -> list[dict]:
    """Licences of a text, in order: license, start, end (characters), sentence_ids."""
    met = list(known_sentences(text))
    out, at = [], 0
    while at < len(met):
        for rule, name in ORDERED:
            if len(rule) <= len(met) - at and all(met[at + i][2] == key for i, key in enumerate(rule)):
                hit = met[at : at + len(rule)]
                if all(b[0] - a[1] - 1 <= gap for a, b in zip(hit, hit[1:])):
                    out.append({"license": name, "start": hit[0][3], "end": hit[-1][4], "sentence_ids": list(rule)})
                    at += len(rule)
                    break
        else:
            at += 1
    return out


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 3) -> DataFrame:
    """One row per licence found: id, match (from 0), license, start, end (characters), sentence_ids."""

    def find(batches):
        for batch in batches:
            ids, texts = column(batch, "id").to_pylist(), column(batch, "text")
            rows = [(i, k, m) for i, t in zip(ids, texts) for k, m in enumerate(scan(t.as_py(), gap))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[2][k] for r in rows], t) for k, t in (("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentence_ids", pa.list_(pa.string()))))],
                ["id", "match", "license", "start", "end", "sentence_ids"],
            )

    lower = F.lower(F.col(text_col).cast("string"))
    anchored = F.lit(False)
    for a in ANCHORS:
        anchored = anchored | lower.contains(a)
    named = docs.where(anchored).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(find, "id long, match int, license string, start long, end long, sentence_ids array<string>")
