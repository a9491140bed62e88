"""Licence scans by patience alignment.

A licence's text is a template. Words that occur once in the template and once
in a stretch of a document are anchors; the longest run of anchors in the same
order in both (by patience piles) is kept, and the gaps between them are aligned
the same way. Coverage is the share of matched words among the template's and
those that a document has in between, so a stretch has at most words / least
words and is looked for in a window of that size on both sides of a word that
tells of the licence. Where stretches overlap, the one of greatest coverage
holds, so that a licence isn't taken for one whose text is part of it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import documents
from .toxicity import Tokens

#: Public licence texts and notices (fixed values).
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = "This software is provided \'as-is\', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"


def _gnu(name: str, versions: str, spdx: str) -> list[tuple[str, str, str]]:
    """Notices of a licence of the GNU family in one version."""
    short = name.replace("GNU ", "").split(" ")[0].lower() if name.split(" ")[1] != "General" else ""
    return [
        (spdx, f"This work is licensed under the {name}, version {versions}.", f"{short} {versions.replace('.', ' ')}"),
        (spdx, f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {versions} of the License, or (at your option) any later version.", f"{short} {versions.replace('.', ' ')}"),
    ]


def _cc(part: str) -> list[tuple[str, str, str]]:
    """Notices of a Creative Commons 4.0 licence, by the short names of its parts."""
    long = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    named = "-".join(long[x] for x in part.split("-"))
    return [
        (f"CC-{part}-4.0", f"Licensed under CC {part} 4.0.", "cc 4 " + part.replace("-", " ").lower()),
        (f"CC-{part}-4.0", f"This work is licensed under a Creative Commons {named} 4.0 International License.", "creative 4 " + named.replace("-", " ").lower()),
    ]


#: (SPDX name, text, words without which it isn't this licence); a name may have several texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", _MIT, ""),
    ("LicenseRef-BSD", "Released under the BSD License.", "bsd"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}", ""),
    ("BSD-2-Clause", _BSD, ""),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_WARRANTY}", "endorse"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES}", "endorse"),
    ("LicenseRef-BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("ISC", f"{_ISC}{_ISC_NOTICE} {_ISC_WARRANTY}", "appear"),
    ("ISC", f"{_ISC}{_ISC_NOTICE}", "appear"),
    ("0BSD", f"{_ISC}. {_ISC_WARRANTY}", ""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    ("Apache-2.0", _APACHE, "apache"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    *_gnu("GNU General Public License", "2", "GPL-2.0"), *_gnu("GNU General Public License", "3", "GPL-3.0"),
    *_gnu("GNU Lesser General Public License", "2.1", "LGPL-2.1"), *_gnu("GNU Lesser General Public License", "3", "LGPL-3.0"),
    *_gnu("GNU Affero General Public License", "3", "AGPL-3.0"),
    ("MPL-2.0", _MPL, "mozilla 2"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
    ("Unlicense", _UNLICENSE, ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ""),
    ("Zlib", _ZLIB, ""),
    *[x for part in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for x in _cc(part)],
    ("LicenseRef-Reserved", "All rights reserved.", "reserved"),
]
#: Words that alone don't make a stretch worth aligning.
COMMON = "a all an and any are as at be by copy do following for free from in is it may met not of on or out person sell that the this to under use v version without with work you your 0 2 3 4"


def hashes(texts: list[str]) -> list[list[int]]:
    tokens = Tokens(pa.array(texts, pa.string()))
    found = tokens.hashes(0)[1].tolist()
    return [found[a:b] for a, b in zip(tokens.first.tolist(), tokens.first[1:].tolist())]


def rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    below = [-1] * len(places)
    for i, p in enumerate(places):
        pile = bisect_left(tops, p)
        below[i] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(p)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = p, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def once(words: list[int], a: int, b: int) -> dict[int, int]:
    """Places of the words that occur once in words[a:b]."""
    seen: dict[int, int] = {}
    for i in range(a, b):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def align(template: list[int], words: list[int], a: int, b: int) -> list[tuple[int, int]]:
    """Matched places (in the template, in words) of the stretch words[a:b]."""
    matched, todo = [], [(0, len(template), a, b)]
    while todo:
        t0, t1, d0, d1 = todo.pop()
        if t0 >= t1 or d0 >= d1:
            continue
        mine, theirs = once(template, t0, t1), once(words, d0, d1)
        anchors = [(i, theirs[w]) for w, i in sorted(mine.items(), key=lambda x: x[1]) if w in theirs]
        if not anchors:
            # alike ends need no anchor
            while t0 < t1 and d0 < d1 and template[t0] == words[d0]:
                matched.append((t0, d0))
                t0, d0 = t0 + 1, d0 + 1
            while t0 < t1 and d0 < d1 and template[t1 - 1] == words[d1 - 1]:
                t1, d1 = t1 - 1, d1 - 1
                matched.append((t1, d1))
            continue
        kept = [anchors[i] for i in rising([d for _, d in anchors])]
        matched += kept
        edges = [(t0 - 1, max(d0, kept[0][1] - 2 * (kept[0][0] - t0) - 2) - 1), *kept, (t1, min(d1, kept[-1][1] + 2 * (t1 - kept[-1][0]) + 2))]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(matched)


def find(template: list[int], keys: dict[int, int], needed: set[int], words: list[int], hits: list[int], least: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word + 1) of each stretch that covers at least so much of the template and has all needed words matched."""
    found, until, n = [], 0, len(template)
    reach = int(n / least) + 1  # no stretch is longer
    for hit in hits:
        if hit < until or words[hit] not in keys:
            continue
        # first as if the text were the template, then with all words that coverage allows
        lead = keys[words[hit]]
        for before, after in ((lead + 2, n - lead + 2), (reach, reach)):
            a, b = max(until, hit - before), min(len(words), hit + after)
            coverage, first, last = best_part(template, align(template, words, a, b), needed, least)
            if coverage >= least:
                found.append((coverage, first, last))
                until = last
                break
    return found


def best_part(template: list[int], matched: list[tuple[int, int]], needed: set[int], least: float) -> tuple[float, int, int]:
    """(coverage, first word, last word + 1) of the part of an alignment that covers most, ends left out where they cost more than they match."""
    n, best = len(template), (0.0, 0, 0)
    few = int(np.ceil(least * n - 1e-9))
    for i in range(len(matched) - few + 1):
        for j in range(i + few, len(matched) + 1):
            first, last = matched[i][1], matched[j - 1][1] + 1
            coverage = (j - i) / (n + (last - first) - (j - i))
            if coverage > best[0] and needed <= {template[t] for t, _ in matched[i:j]}:
                best = (coverage, first, last)
    return best


def apart(found: list[dict]) -> list[dict]:
    """Of stretches that overlap, those of greatest coverage, then of most words."""
    kept: list[dict] = []
    for x in sorted(found, key=lambda x: (-x["coverage"], x["start"] - x["end"], x["start"], x["license"])):
        if all(x["end"] <= k["start"] or k["end"] <= x["start"] for k in kept):
            kept.append(x)
    # a full text holds over a notice inside it even where a word of it differs
    longer = [k for k in found if any(k["start"] <= x["start"] and x["end"] <= k["end"] and k["end"] - k["start"] > 2 * (x["end"] - x["start"]) for x in kept)]
    if longer:
        best = max(longer, key=lambda x: (x["coverage"], x["end"] - x["start"]))
        rest = [x for x in found if x["end"] <= best["start"] or best["end"] <= x["start"]]
        return sorted([best, *apart(rest)], key=lambda x: (x["start"], x["license"]))
    return sorted(kept, key=lambda x: (x["start"], x["license"]))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(id_col, license, coverage, found) for each row of docs.

    found lists the stretches that cover at least least of a template, as
    (license, coverage, start, end), the ends in words, in the order of the
    text; they don't overlap. license is the one of greatest coverage, then of
    most words, then of first place. A text without any, empty or null, has null and 0.0. Rows
    stand alone; repeated rows and null ids stay; other columns play no part.
    """
    texts = hashes([t for _, t, _ in templates])
    needed = [set(x) for x in hashes([x for _, _, x in templates])]
    common = set(hashes([COMMON])[0])
    keys = [{w: t.index(w) for w in t if w not in common} for t in texts]
    worth = np.array(sorted({w for k in keys for w in k}), np.uint64)

    def run(batches):
        for big in batches:
            for batch in slices(big):
                tokens = Tokens(batch.column(1))
                which, own = tokens.hashes(0)
                place = np.minimum(np.searchsorted(worth, own), len(worth) - 1)
                hit = np.flatnonzero(worth[place] == own)
                best, cover, found = [None] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
                rows, at = np.unique(tokens.row[hit], return_index=True)
                for row, a, b in zip(rows.tolist(), at.tolist(), [*at[1:].tolist(), len(hit)]):
                    first, last = int(tokens.first[row]), int(tokens.first[row + 1])
                    words, hits = own[first:last].tolist(), (hit[a:b] - first).tolist()
                    present = {words[i] for i in hits}
                    for (name, _, _), template, key, need in zip(templates, texts, keys, needed, strict=True):
                        # what isn't matched is at most a fifth (1 - least) of the template, telling words among it
                        if len(key.keys() - present) <= (1 - least) * len(template) + 1e-9 and need & key.keys() <= present:
                            found[row] += [{"license": name, "coverage": c, "start": s, "end": e} for c, s, e in find(template, key, need, words, hits, least)]
                    if found[row]:
                        found[row] = apart(found[row])
                        top = max(found[row], key=lambda x: (x["coverage"], x["end"] - x["start"], -x["start"]))
                        best[row], cover[row] = top["license"], top["coverage"]
                kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(cover, pa.float64()), pa.array(found, kind)], ["id", "license", "coverage", "found"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, license string, coverage double, found array<struct<license:string,coverage:double,start:long,end:long>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op4_licenses(spark, sf_dir):
    return licenses(documents(spark, sf_dir))
