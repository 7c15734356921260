"""License scan by conditional compression.

Candidate blocks are runs of lines with license wording. Each template is looked for among the words around the
wording, as many on both sides as the longest template has, and confirmed by the exact differences in wording
on a stretch of these words. The stretch is compressed alone and once more with the template as a raw
zstandard dictionary; the drop is measured against what the template costs alone, so it does not depend on
the words around. Among many words of prose the drop of a short notice is lost, so no template is dismissed
for it; it ranks templates that differ equally, and says of a block without license how near it comes to one.
Words that name a license or its version must agree in all.

Defined cases: null, empty and unlicensed texts have no row. Every block has a row, and one for each license
if several are confirmed on disjoint stretches, of which the longer go first; a block that no template
explains has no license. Blocks that one stretch covers are one block, which reaches as far as the stretch.
SPDX identifiers count as the licenses they name, without -only, -or-later and +. The opening sentence that
BSD licenses share is BSD where the clauses do not follow. Repeated rows are scanned one by one. Extra columns
are ignored. Whole texts are scanned, block by block. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
CLAUSES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
NO_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES'
DISCLAIMED = "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
GNU_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
MIT_REST = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
UNLICENSE = "This is free and unencumbered software released into the public domain."
UNLICENSE_REST = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def _gnu(name: str, version: float) -> tuple[str, str]:
    """A program's notice, without and with the paragraphs that follow it."""
    first = GNU.format(name, version)
    return first, f"{first} {GNU_REST.format(name)}"


#: Public license notices, whole texts of the short licenses, and opening terms.
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero General Public License", 3)),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD": (BSD,),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", f"{BSD} {CLAUSES} {AS_IS}", f"{BSD} {CLAUSES} {AS_IS} {DISCLAIMED}"),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        f"{BSD} {CLAUSES} {NO_NAME}",
        f"{BSD} {CLAUSES} {NO_NAME} {AS_IS} {DISCLAIMED}",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *_gnu("General Public License", 2)),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        *_gnu("General Public License", 3),
    ),
    "ISC": ("Released under the ISC License.", ISC, f"{ISC} {ISC_REST}"),
    "LGPL-2.1": _gnu("Lesser General Public License", 2.1),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public License", 3)),
    "MIT": (
        "Released under the MIT License.",
        MIT,
        f"{MIT} {MIT_REST}",
    ),
    "MPL-2.0": (MPL, f"{MPL} If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": (UNLICENSE, f"{UNLICENSE} {UNLICENSE_REST}"),
    "Zlib": (ZLIB,),
}

WORDING = r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|SPDX|Creative Commons|public domain|all rights reserved|\bCC0\b"
#: Lines without license wording that may lie inside a block.
GAP = 2
#: Share of a template's words that may differ; none of NAMES, and no word after VERSION.
DIFFERENT = 0.1
NAMES = {"isc", "affero", "lesser", "library", "gnu", "gpl", "lgpl", "agpl", "mit", "apache", "mozilla", "bsd", "neither", "endorse", "2-clause", "3-clause", "noncommercial", "sharealike", "noderivatives"}
VERSION = {"version", "v"}
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([\w.+\-() \t]+)", re.I)

FOUND = "doc_id long, first_line int, last_line int, license string, reduction double, n_missing int, n_extra int"


def blocks(text: str, wording: re.Pattern) -> list[list[int]]:
    """First and last line of each block."""
    out: list[list[int]] = []
    for i, line in enumerate(text.split("\n")):
        if wording.search(line):
            if out and i - out[-1][1] <= GAP + 1:
                out[-1][1] = i
            else:
                out.append([i, i])
    return out


WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def wording_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def naming(words: list[str]) -> list[str]:
    return [w for i, w in enumerate(words) if w in NAMES or i and words[i - 1] in VERSION and w[0].isdigit()]


def identifiers(expression: str) -> list[str]:
    """The licenses of an SPDX expression, up to its first word that is no operator where one must be."""
    out, operand = [], True
    for x in re.findall(r"[\w.+\-]+", expression):
        if x.upper() in ("AND", "OR", "WITH"):
            operand = x.upper()
        elif operand:
            if operand != "WITH":
                out.append(re.sub(r"(-only|-or-later|\+)$", "", x))
            operand = False
        else:
            break
    return out


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        self.rows, self.names = [], {n.lower(): n for n in templates}
        for name, wordings in sorted(templates.items()):
            for text in wordings:
                words = wording_of(text)
                raw = " ".join(words).encode()
                shape = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                pack = zstandard.ZstdCompressor(level=19, dict_data=shape, write_content_size=False)
                self.rows.append((name, words, naming(words), len(self.plain.compress(raw)), pack))
        self.longest = max((len(x[1]) for x in self.rows), default=0)
        self.wording = re.compile(WORDING)

    def stretches(self, template: list[str], names: list[str], words: list[str]):
        """Start, end, missing and extra words of every stretch of words that is the template but for a few."""
        # Short notices differ in a word or two from those of other licenses: these must agree in all.
        few, words = int(DIFFERENT * len(template)) * (len(template) >= 20), list(words)
        match = SequenceMatcher(None, autojunk=False)
        match.set_seq2(template)
        while True:
            match.set_seq1(words)
            at, where, size = match.find_longest_match()
            # Of a template in few + 1 pieces or less, one piece has at least so many words.
            if size < max(1, (len(template) - few) // (few + 1)):
                return
            low = max(0, at - where - few)
            some = words[low : at - where + len(template) + few]
            same = [m for m in SequenceMatcher(None, template, some, autojunk=False).get_matching_blocks() if m.size]
            start, end, shared = low + same[0].b, low + same[-1].b + same[-1].size, sum(m.size for m in same)
            missing, extra = len(template) - shared, end - start - shared
            if missing + extra <= few and naming(words[start:end]) == names:
                yield start, end, missing, extra
            else:
                start, end = at, at + size
            words[start:end] = [""] * (end - start)

    def drops(self, words: list[str], which) -> float:
        """The largest share of its own cost that one of these templates saves of the words."""
        raw = " ".join(words).encode()
        alone = len(self.plain.compress(raw))
        return max(((alone - len(self.rows[i][4].compress(raw))) / self.rows[i][3] for i in which), default=0.0)

    def scan(self, text: str) -> list[tuple]:
        """First line, last line, license, drop, missing and extra words of all that is found."""
        found = list(WORD.finditer(text))
        words, starts = [m.group().lower() for m in found], [m.start() for m in found]
        ends = [i for i, c in enumerate(text) if c == "\n"]
        line = lambda at: bisect_left(ends, at)
        regions: list[list[int]] = []
        for m in self.wording.finditer(text):
            a, b = max(0, bisect_right(starts, m.start()) - 1 - self.longest), min(len(words), bisect_left(starts, m.end()) + self.longest)
            if regions and a <= regions[-1][1]:
                regions[-1][1] = b
            else:
                regions.append([a, b])
        hits = []
        for a, b in regions:
            for i, (name, template, names, *_) in enumerate(self.rows):
                for start, end, missing, extra in self.stretches(template, names, words[a:b]):
                    drop = self.drops(words[a + start : a + end], (i,))
                    hits.append((missing + extra - (end - start), -drop, a + start, a + end, name, drop, missing, extra))
        taken: list[tuple] = []  # first line, last line, license, drop, missing, extra
        used: list[tuple[int, int]] = []
        for _, _, start, end, name, drop, missing, extra in sorted(hits):
            if all(end <= x or y <= start for x, y in used):
                used.append((start, end))
                taken.append((line(starts[start]), line(starts[end - 1]), name, drop, missing, extra))
        for m in SPDX.finditer(text):
            taken += [(line(m.start()), line(m.start()), self.names.get(x.lower(), x), 1.0, 0, 0) for x in identifiers(m.group(1))]
        spans: list[list[int]] = []
        for x in sorted([*blocks(text, self.wording), *([t[0], t[1]] for t in taken)]):
            if spans and x[0] <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], x[1])
            else:
                spans.append(list(x))
        out = []
        for first, last in spans:
            of = {}
            for t in sorted((t for t in taken if first <= t[0] <= last), key=lambda t: (t[4] + t[5], t[0], -t[3])):
                of.setdefault(t[2], t)
            out += [(first, last, *t[2:]) for t in sorted(of.values(), key=lambda t: (t[0], t[2]))]
            if not of:
                lines = wording_of("\n".join(text.split("\n")[first : last + 1]))
                out.append((first, last, None, self.drops(lines, range(len(self.rows))), None, None))
        return out


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A row for each block and license: its lines (from 0), the license confirmed, the share of the template's cost that it saves, and wording differences."""

    def run(batches):
        scanner = Scanner(templates or TEMPLATES)
        for batch in batches:
            rows = [(doc, *x) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for x in scanner.scan(text.as_py())]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                names = ["doc_id", "first_line", "last_line", "license", "reduction", "n_missing", "n_extra"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(WORDING)).mapInArrow(run, FOUND)
