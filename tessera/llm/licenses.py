"""License scan: passages of normalised text compared to licence templates by the Dice coefficient of word bigrams.

A passage of m bigrams can reach the threshold t against a template of k only if m is between k * t / (2 - t) and
k * (2 - t) / t, and then shares t * (m + k) / 2 of them. So templates that a text shares too few bigrams with are pruned
at once, and of the others only passages between shared bigrams, of a length within the bounds, are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontamination import word_hashes
from tessera.llm.shared import slices, small_batches
from tessera.llm.text import windows

THRESHOLD = 0.8

#: Notices and short licence texts, in the wording in common use. Name, and the licence's short name.
TEMPLATES: dict[str, tuple[str, str]] = {
    "apache-line": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-notice": (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "mit-line": ("MIT", "Released under the MIT License."),
    "mit-line-licensed": ("MIT", "This project is licensed under the terms of the MIT License."),
    "mit": (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "gpl3-line": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl2-line": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    "gpl3-notice": (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "isc": (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "bsd": (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "mpl2-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "cc-by": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-line": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "cc-by-sa": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-sa-line": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc": ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nc-line": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc0": ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "rights": ("Proprietary", "Copyright. All rights reserved."),
}

#: The GNU licences' notices differ in a few words only, so each has its own.
_GNU = 'This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} License for more details.'
TEMPLATES["gpl2-notice"] = ("GPL-2.0", _GNU.format("program", "General Public", "2"))
for _short, _name, _version in (("LGPL", "Library General Public", "2"), ("LGPL", "Lesser General Public", "2.1"), ("LGPL", "Lesser General Public", "3"), ("AGPL", "Affero General Public", "3")):
    _licence = f"{_short}-{_version}" if "." in _version else f"{_short}-{_version}.0"
    TEMPLATES[f"{_short.lower()}{_version}-line"] = (_licence, f"This work is licensed under the GNU {_name} License, version {_version}.")
    for _thing in ("program", "library"):
        TEMPLATES[f"{_short.lower()}{_version}-notice-{_thing}"] = (_licence, _GNU.format(_thing, _name, _version))

#: Further clauses behind those of BSD-2-Clause.
_ENDORSE = "Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD = TEMPLATES["bsd"][1]
TEMPLATES["bsd3"] = ("BSD-3-Clause", f"{_BSD} 3. {_ENDORSE.format('copyright holder')}")
TEMPLATES["bsd3-author"] = ("BSD-3-Clause", f"{_BSD} 3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.")
TEMPLATES["bsd4"] = (
    "BSD-4-Clause",
    f"{_BSD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California, Berkeley and its contributors. 4. {_ENDORSE.format('University')}",
)

#: The other Creative Commons licences, and their versions before 4.0.
for _version, _port, _nd in (("4.0", "International", "NoDerivatives"), ("3.0", "Unported", "NoDerivs"), ("2.5", "Generic", "NoDerivs"), ("2.0", "Generic", "NoDerivs")):
    for _parts in ((), ("SA",), ("NC",), ("ND",), ("NC", "SA"), ("NC", "ND")):
        _short = "-".join(("BY", *_parts))
        _name = "-".join(("Attribution", *({"SA": "ShareAlike", "NC": "NonCommercial", "ND": _nd}[x] for x in _parts)))
        _key = f"cc-{_short.lower()}" + ("" if _version == "4.0" else f"-{_version}")
        TEMPLATES.setdefault(_key, (f"CC-{_short}-{_version}", f"This work is licensed under a Creative Commons {_name} {_version} {_port} License."))
        TEMPLATES.setdefault(f"{_key}-line", (f"CC-{_short}-{_version}", f"Licensed under CC {_short} {_version}."))
#: Further notices, a short text, and the identifiers that files name their licence by; those of one word are too short to tell apart.
TEMPLATES["epl2-notice"] = ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/")
TEMPLATES["epl1-notice"] = ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html")
TEMPLATES["boost-line"] = ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)")
TEMPLATES["zlib"] = (
    "Zlib",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
)
for _id in "Apache-2.0 BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-1.0 EPL-2.0 BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split():
    TEMPLATES[f"spdx-{_id.lower()}"] = (_id.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {_id}")
#: Years and the copyright sign differ from one use of a licence to the next.
_VARIES = re.compile(r"\(c\)|©|\b(?:19|20)\d\d(?:\s*[-–,]\s*(?:19|20)\d\d)*\b", re.I)


def normalised(text: str | None) -> str:
    """The text without what differs from use to use."""
    return _VARIES.sub(" ", text or "")


def _within(part: np.ndarray, whole: np.ndarray) -> bool:
    return any(np.array_equal(whole[p : p + len(part)], part) for p in np.flatnonzero(whole == part[0]))


class _Taken:
    """Passages without overlaps."""

    def __init__(self, n: int):
        self.at = bytearray(n + 1)

    def apart(self, x: tuple[int, int, int, float]) -> bool:
        return self.at.find(1, x[1], x[1] + x[2] + 1) < 0

    def add(self, x: tuple[int, int, int, float]) -> None:
        self.at[x[1] : x[1] + x[2] + 1] = b"\1" * (x[2] + 1)


def _best(found: list[tuple[int, int, int, float]], n: int) -> list[tuple[int, int, int, float]]:
    """The best first, without overlaps, of a text of n bigrams."""
    kept, taken = [], _Taken(n)
    for x in sorted(found, key=lambda x: (-x[3], -x[2], x[1], x[0])):
        if taken.apart(x):
            taken.add(x)
            kept.append(x)
    return kept


def _nth_before(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place, that of the n-th value before it that equals it; -1 where there are fewer."""
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], code[order])
    rank = np.arange(len(code)) - n[order]
    out = np.full(len(code), -1, np.int64)
    has = rank >= first
    out[order[has]] = order[rank[has]]
    return out


class Templates:
    """Bigrams of licence templates: how often each has each, and the bounds for passages."""

    def __init__(self, templates: Mapping[str, tuple[str, str]], threshold: float):
        self.names = list(templates)
        self.licences = [templates[n][0] for n in self.names]
        self.threshold = threshold
        words, first = word_hashes([normalised(templates[n][1]) for n in self.names])
        grams = [windows(words[a:b], 2) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.sizes = [len(g) for g in grams]
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]))
        self.counts = np.zeros((len(grams), len(self.codes) + 1), np.int64)
        for k, g in enumerate(grams):
            np.add.at(self.counts[k], np.searchsorted(self.codes, g), 1)
        self.has = (self.counts > 0).astype(np.float64)
        # For each template those of other licences whose whole text it continues.
        self.continues = [[j for j in range(len(grams)) if self.licences[j] != self.licences[k] and 0 < self.sizes[j] < self.sizes[k] and _within(grams[j], grams[k])] for k in range(len(grams))]

    def bounds(self, k: int) -> tuple[float, float]:
        """Lengths of passages that can reach the threshold against template k."""
        t = self.threshold
        return self.sizes[k] * t / (2 - t), self.sizes[k] * (2 - t) / t

    def passages(self, code: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first bigram, bigrams, Dice), the best first, without overlaps. code: index of each bigram, len(codes) if no template has it."""
        found = []
        known = np.flatnonzero(code < len(self.codes))
        if not len(known):
            return []
        hits = self.has[:, :-1] @ np.bincount(code[known], minlength=len(self.codes))
        for k in range(len(self.names)):
            low, high = self.bounds(k)
            # The size bound: a passage shares at least threshold * (low + size) / 2 bigrams with the template.
            need = self.threshold * (low + self.sizes[k]) / 2
            if hits[k] < need - 1e-9:
                continue
            at = known[self.counts[k, code[known]] > 0]
            upto = np.searchsorted(at, at + high, "left")
            p = np.flatnonzero(upto - np.arange(len(at)) >= need - 1e-9)
            if not len(p):
                continue
            # A bigram counts in passages that begin behind the occurrence of it that has used up the template's count.
            back = _nth_before(code[at], self.counts[k, code[at]])
            both, best, length = np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros(len(p), np.int64)
            on = np.arange(len(p))
            for step in range(int((upto[p] - p).max())):
                on = on[p[on] + step < upto[p[on]]]
                e = p[on] + step
                both[on] += back[e] < p[on]
                m = at[e] - at[p[on]] + 1
                dice = 2 * both[on] / (m + self.sizes[k])
                good = (low - 1e-9 <= m) & (dice >= self.threshold - 1e-12) & (dice > best[on])
                best[on[good]], length[on[good]] = dice[good], m[good]
            hit = length > 0
            found += zip([k] * int(hit.sum()), at[p[hit]].tolist(), length[hit].tolist(), best[hit].tolist(), strict=True)
        # Where a passage holds what a template adds to another's text, it is no passage of that other.
        taken: dict[int, _Taken] = {}
        for y in _best([x for x in found if self.continues[x[0]] and self._continued(code, x)], len(code)):
            for j in self.continues[y[0]]:
                taken.setdefault(j, _Taken(len(code))).add(y)
        return _best([x for x in found if x[0] not in taken or taken[x[0]].apart(x)], len(code))

    def _continued(self, code: np.ndarray, x: tuple[int, int, int, float]) -> bool:
        """Whether a passage shares the threshold's part of what its template adds to each that it continues."""
        k, start, m, _ = x
        n = np.bincount(code[start : start + m], minlength=len(self.codes) + 1)
        both = np.minimum(n, self.counts[k]).sum()
        return all(both - np.minimum(n, self.counts[j]).sum() >= self.threshold * (self.sizes[k] - self.sizes[j]) - 1e-9 for j in self.continues[k])


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in slices(batches):
            words, first = word_hashes([normalised(x) for x in batch.column("text").to_pylist()])
            grams = windows(words, 2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            code = np.minimum(np.searchsorted(t.codes, grams), len(t.codes) - 1) if len(t.codes) else np.zeros(len(grams), np.int64)
            inside = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
            hit = (t.codes[code] == grams) & inside if len(t.codes) else np.zeros(len(grams), bool)
            code = np.where(hit, code, len(t.codes))
            ids, out = batch.column("id").to_pylist(), []
            for r in np.unique(row[np.flatnonzero(hit)]) if hit.any() else []:
                for k, start, m, dice in t.passages(code[first[r] : max(first[r], first[r + 1] - 1)]):
                    out.append((ids[r], t.licences[k], t.names[k], dice, start, m + 1))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], ["id", "license", "template", "dice", "first_word", "n_words"])

    return run


@small_batches
def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, template, dice, first_word, n_words): every passage of docs that a template matches, the best of those that overlap.

    Words are runs of letters and digits, lower-cased; years and copyright signs are left out. A passage starts and
    ends with a bigram of its template; dice counts a bigram as often as both have it. Null and empty texts, and those
    of one word, match nothing; whole texts are read, and each is done where it is. Repeated rows give their rows
    again; ids may be null; other columns are ignored. At equal coefficients the longer passage, then the earlier one, then the
    earlier template wins. A template whose text another's continues (BSD-2-Clause in BSD-3-Clause) gives way to it where
    the passage holds the threshold's part of what the other adds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, threshold))
    return rows.mapInArrow(_scan(shared), "id long, license string, template string, dice double, first_word long, n_words long")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence passages in documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
