"""Licence scans by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, letters and digits only, single spaces) and
looked up among known licence sentences, which gives a sequence of sentence identifiers. Ordered rules are then matched
against that sequence: a rule's sentences must come in order, with at most ``gap`` other sentences between neighbours.
Of matches that overlap, the one with more sentences stays, then the earlier, then the rule that is listed first.

Defined cases. Null or empty text: no sentences and empty lists. Texts are scanned whole. A rule may match a text several
times; each match is reported. Repeated rows give repeated results; null ids stay null. Invalid UTF-8 is read with replacement characters. Extra columns pass through
``scan`` unchanged, and a name that is taken raises ``ValueError``. No rows: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import python_texts

#: Sentences of public licences and licence notices, as identifier and text.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-spdx": "SPDX-License-Identifier: GPL-3.0-only",
    "gpl3-spdx-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl2-spdx": "SPDX-License-Identifier: GPL-2.0-only",
    "gpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0.",
    "cc-by-licensed": "Licensed under CC BY 4.0.",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0.",
    "cc0-spdx": "SPDX-License-Identifier: CC0-1.0",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "zlib-provided": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl-do": "You just DO WHAT THE FUCK YOU WANT TO.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
}

#: Licences as SPDX identifier and the names that notices call them by.
NAMED = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Modified BSD License", "New BSD License"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}

#: Other identifiers that an SPDX line may name.
SPDX = ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "0BSD", "Artistic-2.0", "BSD-4-Clause", "CDDL-1.0", "EPL-1.0", "EUPL-1.2", "MIT-0", "MPL-1.1", "MS-PL", "MulanPSL-2.0", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Vim", "W3C", "WTFPL", "X11")

#: How a notice names a licence.
NOTICES = ("Licensed under {}.", "Licensed under the {}.", "Licensed under a {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the {}.", "This software is licensed under the {}.")


def notices() -> tuple[dict[str, str], list[tuple[str, str, tuple[str, ...]]]]:
    """Sentences and rules of all short notices and SPDX lines."""
    known, rules = {}, []
    for licence in (*NAMED, *SPDX):
        lines = [f"SPDX-License-Identifier: {licence}", *(n.format(name) for name in NAMED.get(licence, ()) for n in NOTICES)]
        for k, line in enumerate(lines):
            name = f"{licence.lower()}-{'spdx' if k == 0 else f'notice-{k}'}"
            known[name] = line
            rules.append((name, licence, (name,)))
    return known, rules


#: Ordered rules as name, licence (SPDX identifier) and sentence identifiers.
RULES = [
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("mit-grant", "MIT", ("mit-grant",)),
    ("mit-released", "MIT", ("mit-released",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("mit-spdx", "MIT", ("mit-spdx",)),
    ("apache-header", "Apache-2.0", ("apache-header", "apache-use", "apache-copy", "apache-as-is", "apache-see")),
    ("apache-header-short", "Apache-2.0", ("apache-header",)),
    ("apache-licensed", "Apache-2.0", ("apache-licensed",)),
    ("apache-spdx", "Apache-2.0", ("apache-spdx",)),
    ("gpl3-notice", "GPL-3.0-or-later", ("gpl3-redistribute", "gpl-hope", "gpl-details")),
    ("gpl3-redistribute", "GPL-3.0-or-later", ("gpl3-redistribute",)),
    ("gpl3-licensed", "GPL-3.0-only", ("gpl3-licensed",)),
    ("gpl3-spdx", "GPL-3.0-only", ("gpl3-spdx",)),
    ("gpl3-spdx-later", "GPL-3.0-or-later", ("gpl3-spdx-later",)),
    ("gpl2-notice", "GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope", "gpl-details")),
    ("gpl2-redistribute", "GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("gpl2-spdx", "GPL-2.0-only", ("gpl2-spdx",)),
    ("bsd-3", "BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd-2", "BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("cc-by-nc-licensed", "CC-BY-NC-4.0", ("cc-by-nc-licensed",)),
    ("cc-by-licensed", "CC-BY-4.0", ("cc-by-licensed",)),
    ("cc-by-sa-licensed", "CC-BY-SA-4.0", ("cc-by-sa-licensed",)),
    ("cc0-spdx", "CC0-1.0", ("cc0-spdx",)),
    ("unlicense", "Unlicense", ("unlicense-domain",)),
    ("lgpl21-notice", "LGPL-2.1-or-later", ("lgpl21-redistribute", "lgpl-hope", "lgpl-details")),
    ("lgpl21-redistribute", "LGPL-2.1-or-later", ("lgpl21-redistribute",)),
    ("lgpl3-notice", "LGPL-3.0-or-later", ("lgpl3-redistribute", "gpl-hope", "lgpl-details")),
    ("lgpl3-redistribute", "LGPL-3.0-or-later", ("lgpl3-redistribute",)),
    ("agpl3-notice", "AGPL-3.0-or-later", ("agpl3-redistribute", "gpl-hope", "agpl-details")),
    ("agpl3-redistribute", "AGPL-3.0-or-later", ("agpl3-redistribute",)),
    ("mpl2-header", "MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("mpl2-subject", "MPL-2.0", ("mpl2-subject",)),
    ("epl2-header", "EPL-2.0", ("epl2-available",)),
    ("zlib-text", "Zlib", ("zlib-provided", "zlib-liable", "zlib-permission")),
    ("boost-grant", "BSL-1.0", ("boost-grant",)),
    ("boost-distributed", "BSL-1.0", ("boost-distributed",)),
    ("wtfpl", "WTFPL", ("wtfpl-do",)),
    ("0bsd-grant", "0BSD", ("0bsd-grant",)),
]

_END = re.compile(r"(?<=[.!?;:])[\s]+|[\r\n]+")
_OTHER = re.compile(r"[\W_]+")
_COMMENT = re.compile(r"^[^\S\n]*(?://|#|\*(?!/)|--|;+)[^\S\n]?", re.M)


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence: they end at ``. ! ? ; :`` before white space, and at line ends."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


class Scanner:
    """Known sentences and rules, ready to match.

    A licence sentence may run over several lines, so a candidate joins consecutive pieces for as long as they begin
    some known sentence; of the known sentences that it passes, the longest counts. The notices of ``notices`` are
    always known; a text that is known under two names has the first.
    """

    def __init__(self, known: dict[str, str] = SENTENCES, rules=RULES, gap: int = 2):
        self.gap = gap
        more, more_rules = notices()
        rules = [*rules, *more_rules]
        self.ids: dict[str, str] = {}
        for name, text in (known | more).items():
            self.ids.setdefault(normalised(text), name)
        self.starts: dict[str, list[str]] = {}
        for text in self.ids:
            self.starts.setdefault(text.split(" ", 1)[0], []).append(text)
        self.rules = [(k, name, licence, steps) for k, (name, licence, steps) in enumerate(rules)]
        self.by_first: dict[str, list] = {}
        for rule in self.rules:
            self.by_first.setdefault(rule[3][0], []).append(rule)
        firsts = sorted({s for s in self.starts}, key=len, reverse=True)
        self.hint = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, firsts)) + r")(?![^\W_])", re.I)

    def identified(self, text: str) -> list[tuple[int, str, int, int]]:
        """Sentence number, identifier, start and end of every known sentence."""
        spans = sentences(text)
        out, k = [], 0
        while k < len(spans):
            start, end = spans[k]
            first = self.hint.search(text, start, end)
            piece = normalised(_COMMENT.sub("", text[start:end])) if first else ""
            wanted = self.starts.get(piece.split(" ", 1)[0], ()) if piece else ()
            step = 1
            joined, more = piece, 0
            while wanted:
                if joined in self.ids:
                    if step > 1 or (out and out[-1][0] == k):
                        out.pop()
                    out.append((k, self.ids[joined], start, spans[k + more][1]))
                    step = more + 1
                more += 1
                if k + more >= len(spans) or not any(len(w) > len(joined) and w.startswith(joined) for w in wanted):
                    break
                lo, hi = spans[k + more]
                joined = f"{joined} {normalised(_COMMENT.sub('', text[lo:hi]))}".strip()
            k += step
        return out

    def matches(self, found: list[tuple[int, str, int, int]]) -> list[dict]:
        """Non-overlapping rule matches over a sequence of known sentences, in text order."""
        possible = []
        for at, (_, name, _, _) in enumerate(found):
            for order, rule, licence, steps in self.by_first.get(name, ()):
                used, here = [at], at
                for step in steps[1:]:
                    nxt = next((j for j in range(here + 1, len(found)) if found[j][0] - found[here][0] - 1 > self.gap or found[j][1] == step), None)
                    if nxt is None or found[nxt][1] != step or found[nxt][0] - found[here][0] - 1 > self.gap:
                        break
                    used.append(nxt)
                    here = nxt
                else:
                    possible.append((-len(used), at, order, rule, licence, used))
        taken: set[int] = set()
        out = []
        for _, _, _, rule, licence, used in sorted(possible, key=lambda p: p[:3]):
            if taken.isdisjoint(used):
                taken.update(used)
                out.append({"licence": licence, "rule": rule, "start": found[used[0]][2], "end": found[used[-1]][3], "sentences": [found[j][1] for j in used]})
        return sorted(out, key=lambda m: m["start"])

    def scan(self, text: str | None) -> list[dict]:
        if not text or not self.hint.search(text):
            return []
        found = self.identified(text)
        return self.matches(found) if found else []


MATCH = T.StructType().add("licence", "string").add("rule", "string").add("start", "long").add("end", "long").add("sentences", T.ArrayType(T.StringType()))
_MATCHES = pa.list_(pa.struct([("licence", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.list_(pa.string()))]))


def scan(df: DataFrame, text: str = "text", out: str = "matches", known: dict[str, str] = SENTENCES, rules=RULES, gap: int = 2) -> DataFrame:
    """``df`` with its licence matches: licence, rule, character span and sentence identifiers. No shuffle."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column already there: {out}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, rules, gap)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([scanner.scan(t) for t in python_texts(part.column(text))], _MATCHES)], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(MATCH))]))
