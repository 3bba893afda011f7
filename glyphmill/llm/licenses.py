"""License scans: MinHash bands over overlapping windows find templates, shingle containment verifies them.

Words are lower-cased (A-Z) and lose ASCII punctuation at their ends; shingles are five words. Templates
are put into classes by length; a class's windows are half as long again as its longest template and
start every third of that, so a whole template lies in some window and its Jaccard similarity with it
is bounded from below. Rows and bands are chosen for that bound, so that a window misses a template that
it contains with a probability below MISS. A match is a window that holds at least CONTAINED of the
template's distinct shingles; of matches of several templates on the same shingles, the one that holds most counts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.arrays import U, Hasher, Words, chunks, mix, released, stream, text_bytes, windows, words_of

SHINGLE, CONTAINED, MISS = 5, (4, 5), 1e-4
GROWTH = 1.5

# Public licenses and their notices as their publishers word them (-notice: short forms that documents use).
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": f"{_REDISTRIBUTION} {_AS_IS}",
    "BSD-3-Clause": f"{_REDISTRIBUTION} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_HASHER = Hasher(31)


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """(hash, row) of every shingle, in order; a shingle's number in its row is its first word's."""
    words = words_of(data, offsets, lower=True)
    start, end = words.start.copy(), words.end.copy()
    while True:
        left = (start < end) & _PUNCTUATION[words.data[np.minimum(start, len(words.data) - 1)]] if len(start) else np.zeros(0, bool)
        right = (start < end) & ~left & _PUNCTUATION[words.data[end - 1]] if len(start) else left
        if not left.any() and not right.any():
            break
        start += left
        end -= right
    kept = start < end
    before = np.concatenate([[0], np.cumsum(kept)])
    words = Words(words.data, start[kept], end[kept], before[words.first])
    at, row = windows(words, SHINGLE)
    return _HASHER.runs(_HASHER.spans(words.data, words.start, words.end), at, SHINGLE), row, words


def settings(jaccard: float, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the fewest hashes for which a pair at this similarity shares no band with probability miss at most."""
    best = min((r * math.ceil(math.log(miss) / math.log1p(-(jaccard**r))), r) for r in range(1, 5))
    return best[1], best[0] // best[1]


@dataclass
class Level:
    """Templates of similar length, with the band index over their signatures."""

    window: int
    stride: int
    rows: int
    bands: int
    salts: np.ndarray
    index: dict

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        return mix(shingles[None, :] ^ self.salts[:, None]).min(1)

    def keys(self, shingles: np.ndarray) -> list[tuple]:
        least = self.signature(shingles).tolist()
        return [(b, *least[b * self.rows : (b + 1) * self.rows]) for b in range(self.bands)]


class Scanner:
    """Finds templates in texts. Templates of fewer than five words can't be found and are refused."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.sets = []
        for name in self.names:
            data, offsets = text_bytes(pa.array([templates[name]]))
            found = np.unique(_shingles(data, offsets)[0])
            if not len(found):
                raise ValueError(f"{name} has fewer than {SHINGLE} words")
            self.sets.append(found)
        self.known = np.unique(np.concatenate(self.sets))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.known >> U(48)).astype(np.int64)] = True
        sizes, self.levels = sorted({len(s) for s in self.sets}), []
        while sizes:
            most = max(s for s in sizes if s <= max(sizes[0] + 1, int(sizes[0] * GROWTH)))
            own = [i for i, s in enumerate(self.sets) if sizes[0] <= len(s) <= most]
            window = max(most + 1, int(most * 1.5))
            stride = max(1, window - most)
            least = CONTAINED[0] * sizes[0] / CONTAINED[1]
            rows, bands = settings(least / (window + sizes[0] - least))
            level = Level(window, stride, rows, bands, stream(41, rows * bands), defaultdict(list))
            for i in own:
                for key in level.keys(self.sets[i]):
                    level.index[key].append(i)
            self.levels.append(level)
            sizes = [s for s in sizes if s > most]

    def matches(self, shingles: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, from word, to word) in one text, overlapping ones of a template joined."""
        hit = np.flatnonzero(self.filter[(shingles >> U(48)).astype(np.int64)])
        hit = hit[np.isin(shingles[hit], self.known)]
        found: dict[int, list] = defaultdict(list)
        for level in self.levels if len(hit) else ():
            # windows that hold no template's shingle can't match
            last = hit // level.stride
            first = np.maximum(0, -(-(hit - level.window + 1) // level.stride))
            for k in sorted({x for a, b in set(zip(first.tolist(), last.tolist(), strict=True)) for x in range(a, b + 1)}):
                s = k * level.stride
                part = shingles[s : s + level.window]
                near = {i for key in level.keys(part) for i in level.index.get(key, ())}
                for i in near:
                    at = np.flatnonzero(np.isin(part, self.sets[i]))
                    held = len(np.unique(part[at]))
                    if len(at) and CONTAINED[1] * held >= CONTAINED[0] * len(self.sets[i]):
                        found[i].append((s + int(at[0]), s + int(at[-1]) + SHINGLE, held, frozenset((s + at).tolist())))
        out = []
        for i, spans in found.items():
            spans.sort(key=lambda x: x[:3])
            joined = [spans[0]]
            for s, e, held, at in spans[1:]:
                first, last, most, own = joined[-1]
                if s < last:
                    joined[-1] = first, max(e, last), max(held, most), own | at
                else:
                    joined.append((s, e, held, at))
            out += [(s, e, i, held, at) for s, e, held, at in joined]
        return [(i, s, e) for s, e, i in _best(sorted(out, key=lambda x: x[:4]))]


def _best(matches: list[tuple[int, int, int, int, frozenset]]) -> list[tuple[int, int, int]]:
    """Sorted (from, to, template, shingles held, their places) without those half of whose places are also
    a match's that holds more: licenses of one family hold most of each other."""
    out, longest = [], max((e - s for s, e, *_ in matches), default=0)
    for k, (s, e, i, held, at) in enumerate(matches):
        low = high = k
        while low and matches[low - 1][0] > s - longest:
            low -= 1
        while high < len(matches) and matches[high][0] < e:
            high += 1
        if not any(other > held and 2 * len(at & places) >= len(at) for *_, other, places in matches[low:high]):
            out.append((s, e, i))
    return out


def license_scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_matches, licenses, spans) of each whole text.

    licenses are the distinct template names by name, spans are name:from:to in words (punctuation alone
    is no word), both comma-joined. Of two licenses of a family so close that a window holds both, the
    fuller one counts. Null, empty and clean texts have none. Templates travel with the task;
    rows stand alone, so repeated rows and null ids come out as they are.
    """
    templates = TEMPLATES if templates is None else templates
    names = ["doc_id", "n_matches", "licenses", "spans"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                shingles, row, _ = _shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                edges = np.searchsorted(row, np.arange(b - a + 1))
                found = [scanner.matches(shingles[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([",".join(sorted({scanner.names[i] for i, _, _ in x})) for x in found], pa.string()),
                        pa.array([",".join(f"{scanner.names[i]}:{s}:{e}" for i, s, e in x) for x in found], pa.string()),
                    ],
                    names,
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_matches long, licenses string, spans string")
