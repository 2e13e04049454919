"""License scans by conditional compression.

A text's candidate blocks are its lines with license wording and, around wording that no single line explains, what lies within twice the
longest template's words: wherever the lines are cut, a template's words are placed there. Each block is compressed alone and with each template as a
zstandard raw dictionary; templates are ranked by the share of the block's size that they save. The leading ones are then
compared with the block word by word: the winner is the one with the fewest differences, if none of its required words is missing
and enough of the template is there. Differences are returned, so that an altered notice can be told from an exact one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common notices and whole short licenses by SPDX identifier, several to a license; the words after the bar tell it from its kin and must be there.
TEMPLATES = """
Apache-2.0 | apache 2.0 | Licensed under the Apache License, Version 2.0.
Apache-2.0 | apache 2.0 | Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Apache-2.0 | apache 2.0 | Licensed under Apache 2.0.
Apache-2.0 | | Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
MIT | mit | Released under the MIT License.
MIT | mit | This project is licensed under the MIT License.
MIT | | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
GPL-2.0 | gplv2 | License: GPLv2+
GPL-2.0 | gplv2 | Licensed under the GPLv2.
GPL-3.0 | gplv3 | License: GPLv3+
GPL-3.0 | gplv3 | Licensed under the GPLv3.
GPL-2.0 | general 2 | This work is licensed under the GNU General Public License, version 2.
GPL-2.0 | general 2 | This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
GPL-3.0 | general 3 | This work is licensed under the GNU General Public License, version 3.
GPL-3.0 | general 3 | This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
LGPL-2.1 | lesser 2.1 | This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
LGPL-3.0 | lesser 3 | This work is licensed under the GNU Lesser General Public License, version 3.
AGPL-3.0 | affero 3 | This work is licensed under the GNU Affero General Public License, version 3.
BSD-2-Clause | bsd 2 | Licensed under the BSD 2-Clause License.
BSD-3-Clause | bsd 3 | Licensed under the BSD 3-Clause License.
BSD-3-Clause | neither | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
ISC | isc | Licensed under the ISC License.
ISC | fee | Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
MPL-2.0 | mozilla 2.0 | This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
EPL-2.0 | eclipse 2.0 | This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.
Unlicense | public domain | This is free and unencumbered software released into the public domain.
CC0-1.0 | cc0 | Released under CC0 1.0 Universal, public domain dedication.
CC-BY-4.0 | cc by 4.0 !nc !sa !nd | Licensed under CC BY 4.0.
CC-BY-SA-4.0 | cc by sa 4.0 !nc | Licensed under CC BY-SA 4.0.
CC-BY-NC-4.0 | cc by nc 4.0 !sa !nd | Licensed under CC BY-NC 4.0.
CC-BY-NC-SA-4.0 | cc by nc sa 4.0 | Licensed under CC BY-NC-SA 4.0.
CC-BY-ND-4.0 | cc by nd 4.0 !nc | Licensed under CC BY-ND 4.0.
CC-BY-NC-ND-4.0 | cc by nc nd 4.0 | Licensed under CC BY-NC-ND 4.0.
Proprietary | rights reserved | All rights reserved.
Apache-2.0 | apache 2.0 | Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
MIT | sublicense | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
GPL-3.0 | general 3 | This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.
BSD-2-Clause | redistributions !neither | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
BSD-3-Clause | redistributions neither | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
ISC | fee | Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
BSL-1.0 | boost 1.0 | Distributed under the Boost Software License, Version 1.0.
BSL-1.0 | organization derivative | Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
Zlib | misrepresented | This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.
Unlicense | unencumbered domain | This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
#: Wording that makes a candidate, in one line or wrapped.
CUES = r"(?i)licen[sc]e|copyright|all\W+rights\W+reserved|permission\W+(?:is\W+hereby|to\W+use)|redistribut|warrant(?:y|ies)|public\W+domain|creative\W+commons|\bCC\W+BY|\bCC0|\bSPDX\b"
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


@dataclass(frozen=True)
class LicenseParams:
    templates: str = TEMPLATES
    cues: str = CUES
    ranked: int = 4  # leading templates of a block that are compared word by word
    saving: float = 0.2  # least share of a block's size that a template must save
    coverage: float = 0.6  # least share of a template's words that the block must hold in order
    level: int = 3


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    required: frozenset[str]
    barred: frozenset[str]
    words: tuple[str, ...] = field(default=())


def words_of(text: str) -> tuple[str, ...]:
    return tuple(WORD.findall(text.lower()))


def parsed(templates: str) -> list[Template]:
    out = []
    for line in templates.strip().splitlines():
        name, marks, text = (x.strip() for x in line.split("|", 2))
        marks = marks.split()
        out.append(Template(name, text, frozenset(m for m in marks if m[0] != "!"), frozenset(m[1:] for m in marks if m[0] == "!"), words_of(text)))
    return out


def tags(templates: list[Template]) -> list[Template]:
    """The SPDX tag of each license; a tag with a further word of a kindred one (nc, sa, nd) is that one's."""
    out = []
    for name in dict.fromkeys(t.license for t in templates if t.license != "Proprietary"):
        text, own = f"SPDX-License-Identifier: {name}", frozenset(words_of(name))
        out.append(Template(name, text, own | {"spdx"}, frozenset({"nc", "sa", "nd"} - own if "cc" in own else ()), words_of(text)))
    return out


def differences(template: tuple[str, ...], block: tuple[str, ...]) -> tuple[int, int, int, int]:
    """(words in common, in order; words of the template that are missing; first and last place in the block), by a longest common subsequence.

    Of equal ones the alignment that ends first is taken, then the shortest.
    """
    here = np.array(block, object)
    best, start = np.zeros(len(block) + 1, np.int64), np.arange(len(block) + 1)
    for word in template:
        same = here == word
        row, from_ = best.copy(), start.copy()
        take = np.zeros(len(row), bool)
        take[1:] = same & (best[:-1] + 1 > best[1:])
        row[take] = best[:-1][take[1:]] + 1
        from_[take] = np.where(best[:-1] == 0, np.arange(len(block)), start[:-1])[take[1:]]
        peak = np.maximum.accumulate(row)
        at = np.maximum.accumulate(np.where((row == peak) & np.concatenate([[True], peak[1:] > peak[:-1]]), np.arange(len(row)), 0))
        best, start = peak, from_[at]
    common = int(best[-1])
    end = int(np.argmax(best == common))
    return common, len(template) - common, int(start[end]) if common else 0, end


def common_words(template: tuple[str, ...], places: dict[str, int], n: int) -> int:
    """The length of a longest common subsequence with a stretch of n words, given as bits of each word's places: a step of long integers for each word of the template."""
    whole = (1 << n) - 1
    open_ = whole
    for word in template:
        hit = open_ & places.get(word, 0)
        if hit:
            open_ = (open_ + hit | open_ - hit) & whole
    return n - open_.bit_count()


class Scanner:
    """Compares blocks with all templates; equal blocks are compared once."""

    def __init__(self, params: LicenseParams):
        self.params, self.templates = params, parsed(params.templates)
        self.templates += tags(self.templates)
        plain = {"level": params.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        self.given = []
        for t in self.templates:
            raw = zstandard.ZstdCompressionDict(t.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(dict_data=raw, **plain))
        self.cue = re.compile(params.cues)
        self.longest, self.counts = max(len(t.words) for t in self.templates), [Counter(t.words) for t in self.templates]
        self.best = lru_cache(20_000)(self._best)

    def _best(self, block: str) -> tuple[str, float, float, tuple[str, ...], tuple[str, ...], int] | None:
        data, params = block.encode(), self.params
        alone = len(self.alone.compress(data))
        saved = sorted(((1 - len(c.compress(data)) / alone, -k) for k, c in enumerate(self.given)), reverse=True)
        words, found = words_of(block), []
        held = set(words)
        for saving, k in saved:
            template = self.templates[-k]
            if saving < params.saving or len(found) == params.ranked:
                break
            common, missing, first, end = differences(template.words, words)
            if template.required <= held and not template.barred & held and common >= params.coverage * len(template.words):
                mine, theirs = list(template.words), list(words[first:end])
                extra = tuple(w for w in theirs if w not in mine)
                lost = tuple(w for w in mine if w not in theirs)
                found.append((missing + len(extra), -common, -saving, -k, template.license, saving, common / len(template.words), lost, extra, common - missing - len(extra)))
        return min(found)[4:] if found else None

    def blocks(self, text: str):
        """(start, end, block) of each candidate block, in code points."""
        start, lines, taken = 0, [], []
        for line in text.splitlines(keepends=True):
            if self.cue.search(line) and (b := self.best(line.strip())):
                lines.append((start, start + len(line.rstrip()), b))
            start += len(line)
        words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
        # A line that a template explains is one notice, unless it is part of a longer one that explains more.
        for one in lines:
            if taken and one[0] < taken[-1][1]:
                continue
            wide = self._around(text, words, taken, one[0], one)
            if wide and wide[2][5] > sum(b[5] for s, e, b in lines if s < wide[1] and wide[0] < e):
                one = wide
            taken.append(one)
        barren = set()  # stretches of words in which no template was found: cues that stand in one share the search
        for cue in self.cue.finditer(text):
            while not any(s < cue.end() and cue.start() < e for s, e, _ in self._near(taken, cue.start())):
                if (found := self._around(text, words, taken, cue.start(), barren=barren)) is None:
                    break
                insort(taken, found, key=lambda x: x[0])
        for s, e, b in taken:
            yield s, e, b[:5]

    @staticmethod
    def _near(taken, at: int):
        """The notices before and after a place."""
        k = bisect_right(taken, at, key=lambda x: x[0])
        return taken[max(0, k - 1) : k + 1]

    def _around(self, text, words, taken, at: int, over=None, barren=None):
        """The notice with the most words in common, less the differences, among the words around a place that no notice holds yet; over: what it must overlap. The words are those of two
        longest templates before and behind the place, from and to the next multiple of one, so that places near one another have the same."""
        middle = bisect_right(words, at, key=lambda x: x[1]) // self.longest
        low, high = max(0, (middle - 2) * self.longest), min(len(words), (middle + 3) * self.longest + 1)
        for s, e, _ in self._near(taken, at):
            if e <= at:
                low = max(low, bisect_left(words, e, key=lambda x: x[0]))
            else:
                high = min(high, bisect_right(words, s, key=lambda x: x[1]))
        if barren is not None and (low, high) in barren:
            return None
        region = tuple(w for _, _, w in words[low:high])
        counts, found, places = Counter(region), [], {}
        for k, word in enumerate(region):
            places[word] = places.get(word, 0) | 1 << k
        for template, wanted in zip(self.templates, self.counts, strict=True):
            least = self.params.coverage * len(template.words)
            if sum(min(n, counts[w]) for w, n in wanted.items()) < least or not template.required <= counts.keys():
                continue
            if common_words(template.words, places, len(region)) >= least:
                _, _, first, end = differences(template.words, region)
                start, stop = words[low + first][0], words[low + end - 1][1]
                if (over is None or start < over[1] and over[0] < stop) and (b := self.best(text[start:stop])):
                    found.append((b[5], -start, stop, b))
        if not found:
            if barren is not None:
                barren.add((low, high))
            return None
        _, start, stop, b = max(found, key=lambda x: x[:3])
        return -start, stop, b


def scan(docs: DataFrame, params: LicenseParams | None = None) -> DataFrame:
    """doc_id, license, start, end (code points of the block), saving, coverage, missing and extra (words): a row for each block with a license.

    Null and empty texts give no rows; repeated rows and null doc_ids give theirs; equal rankings go to the template with fewer
    differences, then more words in common, then the earlier one. Other columns are ignored.
    """
    params = params or LicenseParams()

    def search(batches):
        scanner = Scanner(params)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for start, end, (name, saving, coverage, missing, extra) in scanner.blocks(text.as_py()):
                    rows.append((doc_id, name, start, end, saving, coverage, list(missing), list(extra)))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            strings = pa.list_(pa.string())
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), strings, strings)
            names = ["doc_id", "license", "start", "end", "saving", "coverage", "missing", "extra"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(text.rlike(params.cues))
    return rows.mapInArrow(search, "doc_id long, license string, start long, end long, saving double, coverage double, missing array<string>, extra array<string>")
