"""Licence texts and notices found by Dice's coefficient over word bigrams.

Texts and templates are normalised alike: lower case, words of letters and
digits, British "licence" as "license". For a template of n bigrams and a window
of m, Dice's 2 * common / (n + m) can reach ``least`` only if
n * least / (2 - least) <= m <= n * (2 - least) / least, and only with at least
n * least / (2 - least) common bigrams. These bounds prune twice: a template whose
bigrams a text holds too few of is no candidate, and of a candidate only windows
of such sizes are compared, each from one common bigram to another, as the best
window begins and ends with one. Windows that overlap go to the highest
coefficient, then the longer template.

Nulls and empties: a null or empty text has no match. Repeated rows are separate
rows. Texts are scanned whole, in time that grows with the bigrams they share
with templates. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import map_arrow, renamed

#: Least coefficient of a match.
LEAST = 0.8
WORDS = re.compile(r"[a-z0-9]+")

# Public licence notices and short licence texts.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "All-rights-reserved": ["All rights reserved."],
}
#: The full texts, one file each.
for _file in sorted(resources.files("siltstone.llm").joinpath("licenses").iterdir(), key=lambda f: f.name):
    TEMPLATES.setdefault(_file.name.removesuffix(".txt"), []).append(_file.read_text(encoding="utf-8"))


def normalise(text: str) -> list[str]:
    return WORDS.findall(text.lower().replace("licence", "license"))


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, least: float = LEAST):
        self.least = least
        self.templates: list[tuple[str, Counter]] = []
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for name, texts in (TEMPLATES if templates is None else templates).items():
            for text in texts:
                words = normalise(text)
                if len(words) > 1:
                    bigrams = Counter(zip(words, words[1:], strict=False))
                    for b in bigrams:
                        self.holders[b].append(len(self.templates))
                    self.templates.append((name, bigrams))
        self.first = {a for a, _ in self.holders}

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first word, words) of every match, in order."""
        words = normalise(text or "")
        first, holders = self.first, self.holders
        hits: dict[int, list[int]] = defaultdict(list)
        for i in [i for i, w in enumerate(words) if w in first]:
            if i + 1 < len(words):
                for t in holders.get((words[i], words[i + 1]), ()):
                    hits[t].append(i)
        found = []
        for t, places in hits.items():
            name, bigrams = self.templates[t]
            n = bigrams.total()
            need, most = n * self.least / (2 - self.least), n * (2 - self.least) / self.least
            if len(places) >= need - 1e-9:
                found += [(dice, n, t, name, a, m) for dice, a, m in self._windows(words, bigrams, n, places, need, most)]
        taken = bytearray(len(words))
        out = []
        for dice, _, _, name, a, m in sorted(found, key=lambda x: (-x[0], -x[1], x[4], x[2])):
            if 1 not in taken[a : a + m]:
                taken[a : a + m] = b"\1" * m
                out.append((name, dice, a, m))
        return sorted(out, key=lambda x: x[2])

    def _windows(self, words: list[str], bigrams: Counter, n: int, places: list[int], need: float, most: float) -> list[tuple[float, int, int]]:
        """For each common bigram the best window that begins with it: coefficient, first word, words."""
        # a place counts in a window unless the window already has as many of its bigram as the template
        seen: dict[tuple[str, str], list[int]] = defaultdict(list)
        before = np.empty(len(places), np.int64)
        for k, place in enumerate(places):
            b = (words[place], words[place + 1])
            held = seen[b]
            before[k] = held[-bigrams[b]] if len(held) >= bigrams[b] else -1
            held.append(k)
        at = np.array(places, np.int64)
        out = []
        for k, a in enumerate(places):
            # places within the largest window from here; too few common ones prune it
            end = bisect_right(places, a + most - 1 + 1e-9)
            if end - k < need - 1e-9:
                continue
            m = at[k:end] - a + 1
            dice = 2 * np.cumsum(before[k:end] < k) / (n + m)
            dice[(m < need - 1e-9) | (dice < self.least - 1e-12)] = 0
            best = int(dice.argmax())
            if dice[best] > 0:
                out.append((float(dice[best]), a, int(m[best]) + 1))
        return out


MATCH = "doc_id long, licenses string, n_matches long, best_dice double, spans array<struct<license:string,dice:double,first_word:int,words:int>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its licences (sorted, joined by ";"; null if none) and every match."""
    span = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("words", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [scanner.matches(t) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("doc_id"),
                pa.array([";".join(sorted({m[0] for m in x})) or None for x in found], pa.string()),
                pa.array(list(map(len, found)), pa.int64()),
                pa.array([max((m[1] for m in x), default=None) for x in found], pa.float64()),
                pa.array([[dict(zip(("license", "dice", "first_word", "words"), m, strict=True)) for m in x] for x in found], pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "licenses", "n_matches", "best_dice", "spans"])

    return map_arrow(renamed(docs, **{doc_id: "doc_id", text: "text"}), rows, MATCH)


def op3(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "licenses", "n_matches", "best_dice", "spans")
