"""Licence scans: Dice coefficient over word bigrams against licence templates.

Both sides are normalised to lower-case words. Every stretch of a document's words is
compared, over line ends and with foreign words in it: of each template the stretch with
the best Dice counts, and of licences that claim the same words the one with the better. With a bigrams in a stretch, b in a template and c in both, Dice is
2c / (a + b) with c <= min(a, b). So a document can reach a threshold t only if it has
t b / (2 - t) of the template's bigrams, and a stretch only if at most b (2 / t - 2) of its
bigrams aren't the template's. Both bounds prune before any comparison and lose nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import prepare

THRESHOLD = 0.8

#: Public licence notices, and what full licence texts begin with or consist
#: of, (licence, text).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
)

_WORDS = re.compile(r"[a-z0-9]+").findall


def normalised(text: str) -> list[str]:
    return _WORDS(text.lower())


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    """Pairs of adjacent words; a single word is a pair with nothing."""
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w, "") for w in words)


class Templates:
    """Templates by falling size, and the bigrams of all."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies in (0, 1]")
        self.threshold = threshold
        made = [(n, bigrams(normalised(t))) for n, t in templates]
        self.sets = sorted(((n, b) for n, b in made if b), key=lambda x: len(x[1]))
        self.sizes = [len(b) for _, b in self.sets]
        self.all = frozenset(p for _, b in self.sets for p in b)
        self.owners: dict[tuple[str, str], list[int]] = {}
        for i, (_, b) in enumerate(self.sets):
            for p in b:
                self.owners.setdefault(p, []).append(i)
        self.single = frozenset(a for a, b in self.all if not b)
        self.bound = threshold / (2 - threshold)
        self.most = self.sizes[-1] / self.bound if self.sizes else 0

    def matches(self, words: list[str]) -> dict[str, float]:
        """The best Dice of each licence that reaches the threshold."""
        if not words or not self.sizes:
            return {}
        a = bigrams(words)
        if len(a) > self.most or len(a & self.all) < self.bound * len(a):
            return {}
        out: dict[str, float] = {}
        low = bisect_left(self.sizes, self.bound * len(a) - 1e-9)
        high = bisect_right(self.sizes, len(a) / self.bound + 1e-9)
        for name, b in self.sets[low:high]:
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= self.threshold:
                out[name] = max(dice, out.get(name, 0.0))
        return out

    def scan(self, text: str) -> dict[str, float]:
        """The best Dice of each licence whose words no other licence fits better.

        The stretches with the highest Dice of all are taken, of equal ones the longest and of
        those all; then those of what their words leave, and so on, until nothing reaches the
        threshold. So a weaker or shorter reading of another licence's notice falls away.
        """
        words = normalised(text)
        out: dict[str, float] = {}
        open_ = [(0, len(words))]
        while open_:
            found = [(s, span) for span in open_ for s in self._stretches(words[span[0] : span[1]], span[0])]
            top = max(((dice, stop - start) for (dice, start, stop, _), _ in found), default=None)
            taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for (dice, start, stop, name), span in found:
                places = taken.setdefault(span, [])
                if (dice, stop - start) == top:
                    out.setdefault(name, dice)
                    places.append((start, stop))
            open_ = []
            for (low, high), places in taken.items():
                for start, stop in sorted(places):
                    if low < start:
                        open_.append((low, start))
                    low = max(low, stop)
                if low < high:
                    open_.append((low, high))
        return out

    def _stretches(self, words: list[str], first: int) -> Iterator[tuple[float, int, int, str]]:
        """(Dice, start, stop, licence) of the best stretches of words from each start that
        reach the threshold; first is the number of the first word."""
        pairs = list(zip(words, words[1:]))
        shared = Counter(i for p in self.all.intersection(pairs) for i in self.owners[p])
        for i, count in shared.items():
            name, b = self.sets[i]
            if count >= self.bound * len(b) - 1e-9:
                for dice, start, stop in self._best(pairs, b):
                    yield dice, first + start, first + stop, name
        # A single word is a pair with nothing: a stretch of its own.
        if self.single and not self.single.isdisjoint(words):
            for at, w in enumerate(words):
                if w in self.single:
                    for i in self.owners[w, ""]:
                        yield 1.0, first + at, first + at + 1, self.sets[i][0]

    def _best(self, pairs: list[tuple[str, str]], b: frozenset[tuple[str, str]]) -> Iterator[tuple[float, int, int]]:
        """Of each start, the longest stretch of words with the best Dice, if it reaches the threshold.

        From right to left, the pairs from a place on are held with the place where they
        first come from there, the nearest last: the stretches that start at the place are
        what is read back from it.
        """
        most = len(b) * (2 / self.threshold - 2) + 1e-9
        later: dict[tuple[str, str], int] = {}
        for start in range(len(pairs) - 1, -1, -1):
            pair = pairs[start]
            later.pop(pair, None)
            later[pair] = start
            if pair not in b:
                continue
            common = foreign = 0
            best = (0.0, 0, 0)
            for p in reversed(later):
                if p in b:
                    common += 1
                    dice = 2 * common / (common + foreign + len(b))
                    if dice >= best[0]:
                        best = (dice, start, later[p] + 2)
                else:
                    foreign += 1
                    if foreign > most:
                        break
            if best[0] >= self.threshold:
                yield best


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, licenses, best_license, best_dice).

    licenses is sorted; the best has the highest Dice, then the first name. Of templates that
    fit overlapping words only the best counts, ties all. Null, empty and unlicensed texts have none (an empty array, nulls). Row for row: repeated rows and
    null ids stay; an empty table gives an empty one; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            found = [known.scan(t) if t else {} for t in batch.column("text").to_pylist()]
            best = [min(f.items(), key=lambda x: (-x[1], x[0]), default=(None, None)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], ["doc_id", "licenses", "best_license", "best_dice"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, licenses array<string>, best_license string, best_dice double")
