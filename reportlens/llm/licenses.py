"""License scan: texts of public licenses are found by MinHash over overlapping windows.

Templates are passages of licenses, and lines made by a rule of verbs and names. Templates and documents are cut into five-word shingles of lower-cased
letters and digits. A passage of WINDOW shingles or more is searched by overlapping windows of that length, a shorter one by windows
of the next of LENGTHS. All document windows of these lengths get BANDS x 2 minima, sliding by doubling; one that agrees with a template window in a
band is a candidate. A window that holds 0.8 of a template window has a Jaccard similarity of 0.67 or more and is missed with a chance of (1 - 0.67^2)^16 = 0.008 %;
overlapping windows have their own chances. Documents without any shingle of a template have no such window and are passed over.

Candidates are verified by exact containment of the whole passage in the place where it would stand, widened by a quarter: LEAST of its shingles, for passages
under STRICT shingles all of them, since there one word is a version. Of matches that overlap the one with most shingles wins, so a text is
reported under its own version and a line is not reported inside its notice.

Defined cases: null and empty texts match nothing; null ids are carried along; repeated rows are scanned each; of overlapping matches with equally many shingles the
more complete, then the earlier name wins; very long texts are scanned whole, in pieces of whole documents; other columns are not read, whatever their names; an empty table gives
no row. Tags of fewer than five words (`SPDX-License-Identifier: MIT`) have no shingle of their own and are not found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlens.llm.arrays import PLAIN, U, Words, constants, mix, pieces, shingles, words

WORDS, BANDS, LEAST, STRICT = 5, 16, 0.8, 14
#: Window lengths in shingles; the last is that of long passages.
LENGTHS = (1, 2, 3, 4, 6, 9, 13, 20)
WINDOW = LENGTHS[-1]

#: Passages of public licenses.
PASSAGES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
        "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    ],
    "GPL": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ],
}
#: What lines say, and the names that they give.
VERBS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This file is licensed under",
         "This software is licensed under", "under the terms of", "SPDX-License-Identifier:")
NAMES = {
    "MIT": ["the MIT License", "the MIT license terms"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "BSD-3-Clause"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPL version 2", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPL version 3", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the LGPL version 2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the LGPL version 3", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the AGPL version 3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License v2.0", "EPL-2.0"],
}
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("3.0", "4.0")


def default_templates() -> list[tuple[str, str]]:
    """(license, text): passages, and each verb with each name; of equal word sequences one stays."""
    names = {k: list(v) for k, v in NAMES.items()}
    for part, title in CC_PARTS.items():
        for v in CC_VERSIONS:
            kind = "International" if v == "4.0" else "Unported"
            names[f"CC-{part}-{v}"] = [f"CC {part} {v}", f"the CC {part} {v} license", f"a CC {part} {v} license", f"a Creative Commons {title} {v} {kind} License",
                                       f"the Creative Commons {title} {v} {kind} License", f"Creative Commons {title} {v} {kind}"]
    return [(k, t) for k, texts in PASSAGES.items() for t in texts] + [(k, f"{verb} {name}") for k, own in names.items() for name in own for verb in VERBS]


def window_minima(x: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Minima of all windows of each length; position k covers k to k + n - 1."""
    out, level, size = {}, x, 1
    for n in sorted(lengths):
        if n > len(x):
            out[n] = np.full(1, x.min(), x.dtype) if len(x) else x
            continue
        while 2 * size <= n:
            level = np.minimum(level[: len(level) - size], level[size:])
            size *= 2
        out[n] = np.minimum(level[: len(x) - n + 1], level[n - size: len(x) - size + 1])
    return out


def _shingled(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    w = words(raw, np.array([0, len(raw)]), PLAIN)
    return shingles(w, WORDS)[0] if len(w.hash) >= WORDS else np.zeros(0, U)


@dataclass
class Index:
    """Shingle sets of templates, and the bands of their windows by length."""

    names: list[str]
    sets: list[np.ndarray]
    sizes: list[int]  # shingles of the text of the template, repeats counted
    windows: dict[int, np.ndarray]  # by length: rows of (template, place in it)
    bands: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # by length and band: sorted values and their windows
    known: np.ndarray  # shingles of all templates, sorted
    factors: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, templates: list[tuple[str, str]]) -> Index:
        factors = (constants(51, 2 * BANDS), constants(52, 2 * BANDS))
        names, sets, sizes, seen = [], [], [], set()
        windows: dict[int, list[tuple[int, int]]] = {}
        values: dict[int, list[np.ndarray]] = {}
        for name, text in templates:
            h = _shingled(text)
            key = h.tobytes()
            if not len(h) or key in seen:
                continue
            seen.add(key)
            t, n = len(names), len(h)
            names.append(name)
            sets.append(np.unique(h))
            sizes.append(n)
            length = next((x for x in LENGTHS if x >= n), WINDOW)
            places = sorted({*range(0, n - WINDOW + 1, WINDOW // 2), n - WINDOW}) if n > WINDOW else [0]
            for p in places:
                own = h[p: p + WINDOW]
                low = np.array([(own * a + b).min() for a, b in zip(*factors, strict=True)], U)
                windows.setdefault(length, []).append((t, p))
                values.setdefault(length, []).append(mix(low[::2] * U(3) + low[1::2]))
        bands = {}
        for n, rows in values.items():
            table = np.array(rows)
            bands[n] = [(table[o, k], o) for k in range(BANDS) for o in [np.argsort(table[:, k])]]
        known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, U)
        return cls(names, sets, sizes, {n: np.array(w) for n, w in windows.items()}, bands, known, factors)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows of (document, where the template would begin, template) of windows that agree in a band. Documents are set apart, so no window reaches into the next."""
        docs = len(first) - 1
        apart = first + np.arange(docs + 1) * WINDOW
        place = np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(first)) * WINDOW
        x = np.full(apart[-1], np.iinfo(U).max, U)
        found = [np.zeros((0, 3), np.int64)]
        for band in range(BANDS):
            pair = []
            for k in (2 * band, 2 * band + 1):
                x[place] = h * self.factors[0][k] + self.factors[1][k]
                pair.append(window_minima(x, list(self.bands)))
            for n, by_band in self.bands.items():
                value = mix(pair[0][n] * U(3) + pair[1][n])
                keys, rows = by_band[band]
                marks = np.zeros(1 << 16, bool)
                marks[(keys >> U(48)).astype(np.int64)] = True
                at = np.flatnonzero(marks[(value >> U(48)).astype(np.int64)])
                low, high = np.searchsorted(keys, value[at], "left"), np.searchsorted(keys, value[at], "right")
                many = high - low
                at, nth = np.repeat(at, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                window = self.windows[n][rows[np.repeat(low, many) + nth]]
                doc = np.searchsorted(apart, at, side="right") - 1
                inside = at - apart[doc] < np.diff(first)[doc]
                found.append(np.column_stack([doc, at - apart[doc] - window[:, 1], window[:, 0]])[inside])
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, w: Words) -> list[tuple[int, int, int, int, float]]:
        """(document, template, first word, last word + 1, containment); of overlapping ones the best."""
        h, first = shingles(w, WORDS)
        # A window that holds a share of a template holds one of its shingles; most documents have none.
        hit = np.zeros(len(h), bool)
        spot = np.searchsorted(self.known, h)
        spot[spot == len(self.known)] = 0
        if len(self.known):
            hit = self.known[spot] == h
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        docs = np.unique(doc_of[hit])
        if not len(docs):
            return []
        some = np.isin(doc_of, docs)
        h, sizes = h[some], np.diff(first)[docs]
        first = np.concatenate([[0], np.cumsum(sizes)])
        ranked = []
        for d, p, t in self.candidates(h, first).tolist():
            own, n, low, high = self.sets[t], self.sizes[t], int(first[d]), int(first[d + 1])
            slack = max(n // 4, next((x for x in LENGTHS if x >= n), n) - n)
            a, b = max(low + p - slack, low), min(low + p + n + slack, high)
            inside = np.isin(h[a:b], own)
            common = len(np.unique(h[a:b][inside])) if b > a else 0
            if common and common >= (LEAST if n >= STRICT else 1) * len(own):
                at = np.flatnonzero(inside) + a - low
                ranked.append((d, -common, -common / len(own), self.names[t], int(at[0]), int(at[-1]) + WORDS, t))
        out, taken = [], []
        for d, _, share, _, start, stop, t in sorted(ranked):
            taken = [x for x in taken if x[0] == d]
            if not any(start < b and a < stop for _, a, b in taken):
                taken.append((d, start, stop))
                out.append((int(docs[d]), t, start, stop, -share))
        return sorted(out, key=lambda m: (m[0], m[2]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, start and stop (words), containment; a row per match."""
    chosen = list(templates.items()) if templates else default_templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(chosen)
        for batch in batches:
            ids = batch.column("doc_id")
            for k, _, w in pieces(batch.column("text"), PLAIN):
                found = index.matches(w)
                doc, t, start, stop, share = zip(*found, strict=True) if found else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.array(doc, np.int64) + k)), pa.array([index.names[x] for x in t], pa.string()), pa.array(start, pa.int64()),
                    pa.array(stop, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "license", "start", "stop", "containment"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, license string, start long, stop long, containment double")
