"""License scans by patience alignment.

A text is searched for each license template in two steps. Regions: a telling word of the template (one that occurs
once in it, and that little prose uses), or a run of three words of any kind that occurs once in it, tells where a copy would begin and end; that stretch of the text is aligned with
the template, the best alignments stand, and what they leave of the text is searched with wider windows; so n copies side by
side are n regions. Alignment: within a region, words that occur once in the region and once in the template are anchors; the longest increasing subsequence
of their places is kept; the gaps between neighbouring anchors, and those before and after, are aligned in the same
way, after equal words at their ends have been matched. Coverage is the share of the template's words that are matched.

Every text is cut into words whole; texts with neither a telling word nor such a run of a template are not aligned with it, as
nothing tells where.

Defined results: null, empty and unlicensed texts have no rows in ``scan`` and license ``none`` with coverage 0 in
``best``; ties go to the longer template, then to the earlier name, then to the earlier place; repeated rows get their
rows each. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
THRESHOLD = 0.6
#: Words of a run that tells where a copy lies.
RUN = 3

_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Short notices by which documents name a license, headers, and whole license texts; a caller may pass its own.
TEMPLATES = {
    "0BSD-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": _BSD_OPENING + _BSD_WARRANTY,
    "BSD-3-Clause": (
        _BSD_OPENING + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _BSD_WARRANTY
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
        "all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in "
        "all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by "
        "a source language processor. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
        "act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
#: Words that prose uses too and that therefore do not open a region.
COMMON = frozenset("1 2 3 a above act action all along alter an anyone appreciated and any are as at authors be been before business but being by can case caused charge claim code commercial conditions connection contract copy data deal details direct do either even event except file files following for forms free from general goods granted have holder hope however if in including is it its kind later law liable limited list loss may met more must name names neither no nor not notice obtain of on or other otherwise out part particular person persons portions possibility products program provided public purpose received rights see sell services shall should so software source special specific strict subject such that the theory thereof these they this those to under use used useful way whether whom will with without work written you your".split())


def words(text: str) -> list[str]:
    return [m[0].lower() for m in WORD.finditer(text)]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), both increasing."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        out += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            stack += [(x0 + 1, x1, y0 + 1, y1) for (x0, y0), (x1, y1) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second places increase (the first ones do already), by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = j, k
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    counted: Counter
    #: Places in the template of its telling words that occur once in it.
    place: dict[str, int]
    #: Places in the template of its runs of ``RUN`` words that occur once in it.
    runs: dict[tuple[str, ...], int]

    @classmethod
    def of(cls, name: str, text: str) -> Template:
        w = words(text)
        counted = Counter(w)
        runs = list(zip(*(w[k:] for k in range(RUN)), strict=False))
        often = Counter(runs)
        return cls(name, w, counted, {x: i for i, x in enumerate(w) if counted[x] == 1 and x not in COMMON}, {x: i for i, x in enumerate(runs) if often[x] == 1})


@lru_cache(maxsize=8)
def _prepared(templates: tuple[tuple[str, str], ...]) -> tuple[list[Template], dict[str, list[tuple[int, int]]], dict[tuple[str, ...], list[tuple[int, int]]]]:
    """The templates; for each telling word, and for each telling run, the templates (by number) that have it, and where."""
    out = [Template.of(name, text) for name, text in sorted(templates)]
    telling, runs = {}, {}
    for k, t in enumerate(out):
        for of, found_in in ((t.place, telling), (t.runs, runs)):
            for x, i in of.items():
                found_in.setdefault(x, []).append((k, i))
    return out, telling, runs


def _aligned(lowered: list[str], a0: int, a1: int, template: Template) -> list[tuple[int, int]]:
    """Matched places in a window of the text; none if they cover less than ``THRESHOLD`` of the template."""
    least = THRESHOLD * len(template.words)
    part = lowered[a0:a1]
    # No alignment matches more words than the two have in common.
    if (Counter(part) & template.counted).total() < least:
        return []
    pairs = [(a0 + i, j) for i, j in patience(part, template.words)]
    # A word at either end that lies far off from the rest belongs to something else.
    far = 2 + len(template.words) // 8
    while len(pairs) > 1 and pairs[-1][0] - pairs[-2][0] > pairs[-1][1] - pairs[-2][1] + far:
        pairs.pop()
    while len(pairs) > 1 and pairs[1][0] - pairs[0][0] > pairs[1][1] - pairs[0][1] + far:
        pairs.pop(0)
    return pairs if len(pairs) >= least else []


def _copies(lowered: list[str], template: Template, seeds: list[tuple[int, int, bool]]) -> list[list[tuple[int, int]]]:
    """The matched places of each copy; no two copies overlap. ``seeds`` are places in the text and in the template that agree, and whether a word tells so.

    A seed tells where its copy begins if nothing is missing or added before it. Each such beginning is tried,
    and the best alignments stand first; what they leave of the text is then searched with wider windows.
    """
    length = len(template.words)
    slack = 2 + length // 4
    starts: list[int] = []
    ends: list[int] = []
    out = []

    def accept(i: int, reach: tuple[int, int]) -> None:
        k = bisect_right(starts, i)
        if k and ends[k - 1] > i:
            return
        a0 = max(reach[0], ends[k - 1] if k else 0)
        a1 = min(reach[1], starts[k] if k < len(starts) else len(lowered))
        if pairs := _aligned(lowered, a0, a1, template):
            # The pairs lie between two accepted copies, so the lists stay sorted.
            starts.insert(k, pairs[0][0])
            ends.insert(k, pairs[-1][0] + 1)
            out.append(pairs)

    tried = []
    begins = {i - j: i for i, j, _ in reversed(seeds)}
    for begin, i in begins.items():
        # Words before the beginning take part only where that matches more.
        sizes = [(-len(_aligned(lowered, a0, begin + length + slack, template)), -a0) for a0 in (max(0, begin), max(0, begin - slack))]
        if min(sizes)[0]:
            tried.append((*min(sizes), begin + length + slack, i))
    for _, a0, a1, i in sorted(tried):
        accept(i, (-a0, a1))
    # Runs of one copy begin it at the same place, if nothing is missing between them; the first of them stands for the rest.
    for i in sorted({i for i, _, word in seeds if word} | set(begins.values())):
        accept(i, (i - length, i + 2 * length))
    return out


def found(text: str | None, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items())) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of every copy that covers at least ``THRESHOLD`` of a template."""
    known, telling, runs = _prepared(templates)
    matches = list(WORD.finditer(text or ""))
    lowered = [m[0].lower() for m in matches]
    seeds: dict[int, list[tuple[int, int, bool]]] = {}
    for i, w in enumerate(lowered):
        for k, j in telling.get(w, ()):
            seeds.setdefault(k, []).append((i, j, True))
    for i, run in enumerate(zip(*(lowered[k:] for k in range(RUN)), strict=False)):
        for k, j in runs.get(run, ()):
            seeds.setdefault(k, []).append((i, j, False))
    out = []
    for k, own in sorted(seeds.items()):
        template = known[k]
        for pairs in _copies(lowered, template, sorted(own)):
            s, e = pairs[0][0], pairs[-1][0]
            out.append((len(pairs) / len(template.words), len(template.words), template.name, matches[s].start(), matches[e].end()))
    return [(name, share, s, e) for share, _, name, s, e in sorted(out, key=lambda x: (-x[0], -x[1], x[2], x[3]))]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for every license found in every row of ``docs``: doc_id, license, coverage, start, end."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                got = found(t, listed)
                ids += [i] * len(got)
                rows += got
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64())))],
                ["doc_id", "license", "coverage", "start", "end"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, license string, coverage double, start long, end long")


def best(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for every row of ``docs``: its best-covered license, where it is, and how many were found."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(got[0], len(got)) if (got := found(t, listed)) else (("none", 0.0, None, None), 0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[0][k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))), pa.array([r[1] for r in rows], pa.int64())],
                ["doc_id", "license", "coverage", "start", "end", "n_found"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, license string, coverage double, start long, end long, n_found long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(common.table(spark, sf_dir, "documents"))
