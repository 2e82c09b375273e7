"""Licence scans by Dice coefficients over word bigrams [operator 6].

Text is normalised (lower case, anything but letters and digits a blank) and compared with licence templates as sets of
word bigrams: 2 |x & y| / (|x| + |y|). The units compared are a document's lines, its paragraphs (runs of lines that are
not blank) and, where it has several of these, the whole. A unit of x bigrams can reach a threshold t with a template of
y only if min(x, y) / ((x + y) / 2) >= t, so templates are kept by size and only those within bounds are looked at, and
of these only such as share a bigram.

Whole licence texts are found wherever they stand, too: for each template of WINDOW words or more, every run of as many
words of the document is compared, and of runs that overlap the best (then the first) counts. A run that reaches t shares
t y / (2 - t) bigrams or more, so only documents that share as many are gone through, in one pass that counts as it moves.

Templates are a few dozen texts at most (a parameter), each a few hundred words: they are held by every task.

Cases: a null or empty text has no match; a unit of one word has that word as its only gram; equal coefficients go to the
earlier template; ids may be null or repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.common import batch, text_of

#: Words from which on a template is looked for in runs of words.
WINDOW = 30
#: Public licence texts and notices, by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
TEMPLATES |= {"MIT-paragraph": _MIT[0], "MIT-text": "\n\n".join(("MIT License", *_MIT))}
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    TEMPLATES["BSD"],
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
TEMPLATES |= {
    "BSD-2-Clause-text": "\n\n".join((*_BSD[:3], _AS_IS)),
    "BSD-3-Clause-text": "\n\n".join((*_BSD, _AS_IS)),
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Apache-2.0-header": TEMPLATES["Apache-2.0-notice"] + "\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": TEMPLATES["GPL-3.0-notice"] + "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}


def _gnu(name: str, version: str, thing: str = "program", sep: str = ",", older: bool = False) -> str:
    """The notice of a licence of the GNU family, which differ in names, versions and marks."""
    free = "free software;" if older else "free software:"
    return f"This {thing} is {free} you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation{sep} either version {version} of the License, or (at your option) any later version."


def _unwarranted(name: str, thing: str = "program") -> str:
    return f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."


TEMPLATES |= {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": _gnu("Affero General", "3"),
    "AGPL-3.0-header": "\n\n".join((_gnu("Affero General", "3"), _unwarranted("Affero General"), "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.")),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": _gnu("Lesser General", "3"),
    "LGPL-2.1-notice": _gnu("Lesser General", "2.1", "library", ";", older=True),
    "LGPL-2.1-header": "\n\n".join((_gnu("Lesser General", "2.1", "library", ";", older=True), _unwarranted("Lesser General", "library"))),
    "GPL-2.0-notice": _gnu("General", "2", sep=";", older=True),
}
THRESHOLD = 0.8
SCHEMA = "doc_id bigint, licence string, dice double, n_matches bigint, matches string"
_OUT = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("dice", pa.float64()), ("n_matches", pa.int64()), ("matches", pa.string())])
_WORD = re.compile(r"[^\W_]+")


def grams(text: str) -> frozenset:
    ws = _WORD.findall(text.lower())
    return frozenset(zip(ws, ws[1:])) if len(ws) > 1 else frozenset(ws)


def dice(x: frozenset, y: frozenset) -> float:
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        found = sorted((len(g), k, name, g) for k, (name, text) in enumerate(templates.items()) if (g := grams(text)))
        self.sizes = [x[0] for x in found]
        self.templates = [x[1:] for x in found]
        self.having: dict = {}
        for at, (_, _, g) in enumerate(self.templates):
            for x in g:
                self.having.setdefault(x, []).append(at)
        t = threshold
        # place, number of words and least number of shared bigrams of the templates that are looked for in runs of words
        words = {name: len(_WORD.findall(text.lower())) for name, text in templates.items()}
        self.long = [(at, words[name], len(g) * t / (2 - t) - 1e-9) for at, (_, name, g) in enumerate(self.templates) if words[name] >= WINDOW]
        self.largest = max(self.sizes, default=0) * (2 - t) / t if t else float("inf")

    def best(self, unit: str) -> tuple[float, str] | None:
        """The best template at the threshold or above."""
        x = grams(unit)
        n, t = len(x), self.threshold
        if not n or n > self.largest:
            return None
        lo, hi = bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        if lo >= hi:
            return None
        shared = Counter(at for g in x if g in self.having for at in self.having[g] if lo <= at < hi)
        found = [(-2 * c / (n + self.sizes[at]), *self.templates[at][:2]) for at, c in shared.items()]
        found = [f for f in found if -f[0] >= t]
        if not found:
            return None
        score, _, name = min(found)
        return -score, name

    def runs(self, text: str, x: frozenset) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coefficient) of the best runs of words; x: the text's bigrams."""
        shared = Counter(at for g in x if g in self.having for at in self.having[g])
        wanted = [f for f in self.long if shared[f[0]] >= f[2]]
        if not wanted:
            return []
        found = list(_WORD.finditer(text))
        ws = [m[0].lower() for m in found]
        pairs = list(zip(ws, ws[1:]))
        out = []
        for at, n, least in wanted:
            _, name, g = self.templates[at]
            size, hits, held = len(g), 0, Counter()
            good = []
            for k, p in enumerate(pairs):
                held[p] += 1
                hits += held[p] == 1 and p in g
                if k >= n - 1:
                    old = pairs[k - n + 1]
                    held[old] -= 1
                    if not held[old]:
                        del held[old]
                        hits -= old in g
                if hits >= least and k >= n - 2:
                    score = 2 * hits / (len(held) + size)
                    if score >= self.threshold:
                        good.append((-score, k - n + 2))
            taken: list[int] = []
            for score, k in sorted(good):
                # runs taken are kept in order: only the neighbours can be too near
                i = bisect_left(taken, k)
                if (i == 0 or k - taken[i - 1] >= n) and (i == len(taken) or taken[i] - k >= n):
                    taken.insert(i, k)
                    out.append((found[k].start(), found[k + n - 1].end(), name, -score))
        return sorted(out)

    def matches(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coefficient) of each unit that matches, in code points: lines, then longer units, then runs
        of words that are no such unit."""
        out, start, block, blocks = [], 0, None, []
        lines = text.split("\n")
        spans = []
        for line in lines:
            end = start + len(line)
            spans.append((start, end))
            if line and not line.isspace():
                block = [start, end, 1] if block is None else [block[0], end, block[2] + 1]
            elif block is not None:
                blocks.append(block)
                block = None
            start = end + 1
        if block is not None:
            blocks.append(block)
        units = [s for s in spans if s[1] > s[0]] + [(a, b) for a, b, n in blocks if n > 1]
        if len(blocks) > 1:
            units.append((0, len(text)))
        for a, b in units:
            got = self.best(text[a:b])
            if got:
                out.append((a, b, got[1], got[0]))
        seen = {(text[a:b].strip(), name) for a, b, name, _ in out}
        return out + [r for r in self.runs(text, grams(text)) if (text[r[0] : r[1]], r[2]) not in seen]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the best matching licence and its coefficient (null without one), how many units match, and all of them
    as name:start:end, joined by commas."""
    held = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held, threshold)
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = matcher.matches(text) if text else []
                top = min(found, key=lambda f: (-f[3], f[0], f[1]), default=None)
                rows.append((i, top and top[2], top and top[3], len(found), ",".join(f"{n}:{a}:{z}" for a, z, n, _ in found)))
            yield batch(_OUT, list(zip(*rows, strict=True)) or [[]] * 5)

    return text_of(docs).mapInArrow(run, SCHEMA)
