"""Licence scans: normalised text compared with licence templates by Dice coefficient over word bigrams.

The units of a text that are compared are its lines, its paragraphs (lines up to one without ink) and
the whole. A unit of n bigrams can only reach the threshold t with a template of m bigrams if
t / (2 - t) <= n / m <= (2 - t) / t, which prunes most; of the rest, the number of bigrams that are
in the template at all bounds the coefficient; what is left is compared exactly, with bigrams
counted as often as they are there. Beside the units, runs of words anywhere in the text are compared
(notices inside a line, headers in paragraphs, whole licences), with blank lines of no meaning.

Cases: null and empty texts, and units of fewer than two words, match nothing; units with the same
words (a line that is the whole text) are reported once; of the templates that a unit reaches (versions of a licence are
alike) the best is reported, all of them if they tie; very long texts are searched whole; repeated rows give a row each; an empty table gives an empty result; columns named licences or passages are replaced.
"""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .arrow import add_columns
from .words import _ODD, Texts, blocks, mix

THRESHOLD = 0.8

#: Notices and texts of public licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "EPL-1.0-header": """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html""",
    "EPL-2.0-header": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0""",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "GFDL-1.3-header": """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts. A copy of the license is included in the section entitled "GNU Free Documentation License".""",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
}

#: Whole licence texts, in the folder beside this file.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def _bigrams(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _ODD + h[1:])


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.names, self.threshold = list(templates), threshold
        self.counts = []
        for text in templates.values():
            data = np.frombuffer(text.encode(), np.uint8)
            self.counts.append(Counter(_bigrams(Texts(data, np.array([0, len(data)])).hashes()).tolist()))
        self.sizes = np.array([sum(c.values()) for c in self.counts])
        self.known = np.array(sorted({g for c in self.counts for g in c}), np.uint64)
        self.times = np.array([[c[g] for g in self.known.tolist()] for c in self.counts])
        self.member = self.times > 0

    def matches(self, texts: Texts) -> list[list[tuple]]:
        """For each text (template, dice, first word, words) of its units that reach the threshold."""
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        h = texts.hashes()
        if len(h) < 2:
            return out
        grams = _bigrams(h)
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        hit = self.known[at] == grams
        starts, stops, owner = self._units(texts)
        n = stops - starts - 1
        running = np.zeros(len(grams) + 1, np.int64)
        np.cumsum(hit, out=running[1:])
        low, high = self.threshold / (2 - self.threshold), (2 - self.threshold) / self.threshold
        fits = (n > 0) & (n >= low * self.sizes.min()) & (n <= high * self.sizes.max()) & (running[np.maximum(stops - 1, starts)] > running[starts])
        seen: set[tuple] = set()
        for u in np.flatnonzero(fits):
            a, b = starts[u], stops[u] - 1
            size = b - a
            if (key := (int(owner[u]), int(a), int(b))) in seen:
                continue
            seen.add(key)
            possible = (self.sizes >= low * size) & (self.sizes <= high * size)
            if not possible.any():
                continue
            inside = at[a:b][hit[a:b]]
            bound = 2 * np.minimum(self.member[:, inside].sum(axis=1), self.sizes) >= self.threshold * (self.sizes + size)
            own = Counter(grams[a:b].tolist()) if (possible & bound).any() else Counter()
            dice = {t: 2 * sum((own & self.counts[t]).values()) / (size + int(self.sizes[t])) for t in np.flatnonzero(possible & bound)}
            best = max(dice.values(), default=0.0)
            if best >= self.threshold:
                out[key[0]] += [(self.names[t], best, int(a - texts.word_offsets[key[0]]), int(size + 1)) for t, d in dice.items() if d == best]
        return [sorted(x, key=lambda m: (m[2], m[3], m[0])) for x in out]

    def passages(self, texts: Texts) -> list[list[tuple]]:
        """For each text (template, dice, first word, words) of runs of words that reach the threshold, best first where runs of a template overlap;
        a run that a better one of another template covers by half or more is that other licence.

        A run begins where template bigrams begin. A bigram counts in it if it is there no more often
        than in the template, so it must not be the (count + 1)th since the run's start.
        """
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        h = texts.hashes()
        if len(h) < 2:
            return out
        grams = _bigrams(h)
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        hit = self.known[at] == grams
        for d in np.flatnonzero(np.diff(texts.word_offsets) > 1):
            first, last = texts.word_offsets[d], texts.word_offsets[d + 1] - 1
            places = np.flatnonzero(hit[first:last])
            if not len(places):
                continue
            ids = at[first:last][places]
            one, there = np.unique(ids, return_counts=True)
            for t in np.flatnonzero(2 * np.minimum(self.times[:, one], there).sum(axis=1) >= self.threshold * self.sizes):
                m, often = int(self.sizes[t]), np.minimum(self.times[t, one], there).sum()
                # n >= overlap in 2 * overlap >= threshold * (n + m)
                if often * (2 - self.threshold) < self.threshold * m:
                    continue
                own = self.times[t, ids] > 0
                found = self._runs(places[own], ids[own], t, last - first)
                out[d] += [(self.names[t], dice, int(a), int(b - a + 1)) for dice, a, b in found]
        return [sorted(self._best(x), key=lambda m: (m[2], m[3], m[0])) for x in out]

    @staticmethod
    def _best(runs: list[tuple]) -> list[tuple]:
        common = lambda r, o: min(r[2] + r[3], o[2] + o[3]) - max(r[2], o[2])
        return [r for r in runs if not any(o[1] > r[1] and 2 * common(r, o) >= r[3] for o in runs)]

    def _runs(self, places: np.ndarray, ids: np.ndarray, t: int, n: int) -> list[tuple]:
        """(dice, first bigram, bigram after the last) of the best runs that don't overlap."""
        m = int(self.sizes[t])
        longest = int((2 - self.threshold) / self.threshold * m)
        # the bigram that a run must begin after if place i is to count in it
        before = np.full(len(places), -1)
        order = np.argsort(ids, kind="stable")
        back = self.times[t, ids[order]]
        k = np.arange(len(order)) - back
        same = (k >= 0) & (ids[order][np.maximum(k, 0)] == ids[order])
        before[order[same]] = order[k[same]]
        stops = np.searchsorted(places, places + longest)
        best = []
        for i, e in enumerate(stops):
            if (e - i) * (2 - self.threshold) < self.threshold * m:
                continue
            overlap = np.cumsum(before[i:e] < i)
            dice = 2 * overlap / (places[i:e] - places[i] + 1 + m)
            j = int(dice.argmax())
            if dice[j] >= self.threshold:
                best.append((float(dice[j]), int(places[i]), int(places[i + j]) + 1))
        taken = []
        for dice, a, b in sorted(best, key=lambda x: (-x[0], x[1])):
            if all(b <= c or a >= e for _, c, e in taken):
                taken.append((dice, a, b))
        return taken

    @staticmethod
    def _units(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, word after the last, and text of each line, paragraph and whole text."""
        lines = np.flatnonzero(texts.data == 10)
        ink = np.cumsum(texts.data > 32)[lines]
        blank = lines[1:][np.diff(ink) == 0]
        out = []
        for cuts in (lines, blank, lines[:0]):
            bounds = np.union1d(np.searchsorted(texts.starts, cuts), texts.word_offsets)
            a, b = bounds[:-1], bounds[1:]
            out.append((a, b, np.searchsorted(texts.word_offsets, a, "right") - 1))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_FOUND = StructType([StructField("licence", StringType()), StructField("dice", DoubleType()), StructField("first_word", LongType()), StructField("n_words", LongType())])
_NAMES = ("licence", "dice", "first_word", "n_words")


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with licences: licence, dice, first_word, n_words of each unit that matches a template; and passages: the same of runs of words
    anywhere in the text that match a template or a whole text, where they overlap none of the licence's licences."""
    short = templates or TEMPLATES
    every = templates or {**TEMPLATES, **TEXTS}

    def make():
        units, runs = Templates(short, threshold), Templates(every, threshold)
        kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        array = lambda rows: pa.array([[dict(zip(_NAMES, m, strict=True)) for m in row] for row in rows], kind)

        def work(column):
            found, more = [], []
            for _, _, texts in blocks(column):
                found += units.matches(texts)
                more += runs.passages(texts)
            apart = lambda p, row: all(p[0] != u[0] or p[2] + p[3] <= u[2] or p[2] >= u[2] + u[3] for u in row)
            return [array(found), array([[p for p in row if apart(p, own)] for row, own in zip(more, found, strict=True)])]

        return work

    return add_columns(docs, text_col, [("licences", ArrayType(_FOUND)), ("passages", ArrayType(_FOUND))], make)


def op6(docs: DataFrame) -> DataFrame:
    """The licences of each document; the best is that of the highest coefficient, the longest of these, the first by name."""
    found = scan(docs.select("doc_id", "text")).withColumn("licences", F.concat("licences", "passages"))
    names = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["licence"])))
    ranked = F.array_sort(F.transform("licences", lambda x: F.struct((-x["dice"]).alias("d"), (-x["n_words"]).alias("n"), x["licence"].alias("licence"))))
    first = F.get(ranked, F.lit(0))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licences"), F.round(-first["d"], 6).alias("best_dice"), first["licence"].alias("best_licence"))
