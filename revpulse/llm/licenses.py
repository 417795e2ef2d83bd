"""License notices: units of a text compared to templates by the Dice coefficient of their word bigrams.

Units are every line, the whole text, and windows of words anywhere in it, so that notices wrapped over lines or standing
inside longer ones are found too.  Words are lower-cased runs of letters and digits, so punctuation
and spacing do not matter.  A unit is looked at closely only if it shares bigrams with templates at all; then
the sizes of the two bigram sets bound the coefficient and rule out most templates before any set is compared.

A window begins and ends with a bigram of the template (anything else at its ends only lowers the coefficient) and is no longer
than the largest set that could still match.  Only places with enough of the template's bigrams so close together are tried.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from revpulse.llm import words
from revpulse.llm.decontaminate import Lookup

# Notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0 boilerplate": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0 long": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 long": "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 long": "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
THRESHOLD = 0.8
WHOLE = -1  # the line number that stands for the whole text
_CELLS = 1 << 16  # (start, end) pairs of windows looked at in one go

_MATCH = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("line", pa.int32())]))


def _bigrams(w: words.Words, i: int, j: int) -> frozenset:
    said = [w.data[s:e].tobytes() for s, e in zip(w.start[i:j], w.end[i:j])]
    return frozenset(zip(said, said[1:]))


class Scanner:
    def __init__(self, templates: Mapping[str, str], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        self.threshold = threshold
        w = words.words_of(words.texts_of(pa.array(list(templates.values()), pa.string())), words.ALNUM, lower=True)
        self.sets = [(n, s) for d, n in enumerate(templates) if (s := _bigrams(w, w.first[d], w.first[d + 1]))]
        pairs = words.grams(w.hashes(), 2)[w.room() >= 2] if len(w.doc) else np.zeros(0, np.uint64)
        self.known = Lookup(pairs)
        self.keys = []  # per template: its bigrams' places among the known ones
        for d, name in enumerate(templates):
            if w.first[d + 1] - w.first[d] > 1:
                own = words.grams(w.hashes(), 2)[w.first[d]:w.first[d + 1] - 1]
                self.keys.append(np.unique(np.searchsorted(self.known.keys, own)))
        self.least = min((len(s) for _, s in self.sets), default=0)

    def compare(self, unit: frozenset) -> list[tuple[str, float]]:
        """(template, coefficient) of all templates similar enough, in the order of the templates."""
        out, t, size = [], self.threshold, len(unit)
        for name, s in self.sets:
            if 2 * min(size, len(s)) >= t * (size + len(s)):  # the coefficient cannot be larger than this allows
                dice = 2 * len(unit & s) / (size + len(s))
                if dice >= t:
                    out.append((name, dice))
        return out

    def scan(self, texts: words.Texts) -> list[list[dict]]:
        w = words.words_of(texts, words.ALNUM, lower=True)
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        told: dict[str, list[tuple[int, int]]] = {}
        if not self.sets or not len(w.doc):
            return found
        pair = words.grams(w.hashes(), 2)
        at, key = self.known.find(pair)
        inside = w.room()[at] >= 2
        at, key = at[inside], key[inside]
        breaks = np.flatnonzero(texts.data == 10)
        line = np.searchsorted(breaks, w.start) + w.doc  # distinct for every line of every text
        first_line = np.searchsorted(breaks, texts.at[:-1]) + np.arange(len(texts))
        same = line[at] == line[np.minimum(at + 1, len(line) - 1)]
        starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        for a, b in self._near(line[starts], starts, len(line), line[at[same]], key[same], pair):
            d = w.doc[a]
            for n, x in self.compare(_bigrams(w, a, b)):
                found[d].append({"license": n, "dice": x, "line": int(line[a] - first_line[d])})
                told.setdefault(n, []).append((a, b))
        docs = np.flatnonzero(np.diff(w.first))
        for a, b in self._near(docs, w.first[docs], len(line), w.doc[at], key, pair):
            d = w.doc[a]
            if line[a] != line[b - 1]:  # else its only line with words has been compared
                for n, x in self.compare(_bigrams(w, a, b)):
                    found[d].append({"license": n, "dice": x, "line": WHOLE})
                    told.setdefault(n, []).append((a, b))
        for (name, s), keys in zip(self.sets, self.keys):
            mine = np.zeros(len(self.known.keys), bool)
            mine[keys] = True
            for a, x in self._windows(w, s, at[mine[key]], told.get(name, [])):
                d = w.doc[a]
                found[d].append({"license": name, "dice": x, "line": int(line[a] - first_line[d])})
        return found

    def _windows(self, w: words.Words, template: frozenset, hits: np.ndarray, told: list[tuple[int, int]]) -> Iterator[tuple[int, float]]:
        """(first word, coefficient) of the windows similar to one template, clear of the word ranges in ``told``.

        ``hits`` are the places of its bigrams.  Windows are taken from the left: of those that begin inside the first one
        that is similar enough, the most similar (then the leftmost, the shortest); the next begins after it.
        """
        t, size = self.threshold, len(template)
        most, need = int((2 - t) / t * size + 1e-9), int(np.ceil(t * size / (2 - t) - 1e-9))
        starts, last = hits[:max(len(hits) - need + 1, 0)], hits[need - 1:]
        starts = starts[(last - starts < most) & (w.doc[last] == w.doc[starts])]
        if not len(starts):
            return
        taken = np.zeros(len(w.doc) + 1, bool)
        for a, b in told:
            taken[a:b] = True
        starts = starts[~taken[starts]]
        barred = np.r_[np.flatnonzero(taken), len(w.doc)]
        stop = np.minimum(w.first[w.doc[starts] + 1], barred[np.searchsorted(barred, starts)]) - 1  # bigrams begin before it
        stop = np.minimum(stop, starts + most)
        rows = max(1, _CELLS // most)
        free = 0
        ready: list[tuple[int, int, float]] = []
        for i in range(0, len(starts), rows):
            ready += self._best(w, template, starts[i:i + rows], stop[i:i + rows], most)
        k = 0
        while k < len(ready):
            if ready[k][0] < free:
                k += 1
                continue
            j = k
            while j < len(ready) and ready[j][0] <= ready[k][1]:
                j += 1
            a, b, dice = max(ready[k:j], key=lambda r: r[2])
            yield a, dice
            free, k = b + 2, k + 1

    def _best(self, w: words.Words, template: frozenset, starts: np.ndarray, stop: np.ndarray, most: int) -> list[tuple[int, int, float]]:
        """(first bigram, last bigram, coefficient) of the best window from each start, if similar enough."""
        places = np.unique(np.minimum(starts[:, None] + np.arange(most), stop[:, None] - 1))
        ids: dict[tuple[bytes, bytes], int] = {}
        before, hit = np.full(len(places), -1), np.zeros(len(places), bool)
        data, begin, end = w.data, w.start, w.end
        for n, p in enumerate(places.tolist()):
            gram = data[begin[p]:end[p]].tobytes(), data[begin[p + 1]:end[p + 1]].tobytes()
            before[n], hit[n] = ids.get(gram, -1), gram in template
            ids[gram] = p
        at = starts[:, None] + np.arange(most)
        inside = at < stop[:, None]
        place = np.searchsorted(places, np.where(inside, at, starts[:, None]))
        new = inside & (before[place] < starts[:, None])  # not met before in this window
        dice = 2 * np.cumsum(new & hit[place], axis=1) / (np.cumsum(new, axis=1) + len(template))
        dice[~(inside & hit[place])] = 0
        end_at = dice.argmax(axis=1)
        best = dice[np.arange(len(starts)), end_at]
        good = (best >= self.threshold) & hit[np.searchsorted(places, starts)]
        return [(int(a), int(a + e), float(x)) for a, e, x in zip(starts[good], end_at[good], best[good])]

    def _near(self, units, starts, n, hit_units, hit_keys, pair) -> Iterator[tuple[int, int]]:
        """Word ranges of the units that share enough known bigrams for some template of any size."""
        if not len(hit_units):
            return
        both = np.unique(np.stack([hit_units, hit_keys]), axis=1)
        unit, shared = np.unique(both[0], return_counts=True)
        t = self.threshold
        few = 2 * shared < t * (shared + self.least)  # even if the unit had no other bigram
        unit, shared = unit[~few], shared[~few]
        place = np.searchsorted(units, unit)
        for p, s in zip(place, shared):
            a, b = int(starts[p]), int(starts[p + 1]) if p + 1 < len(starts) else n
            if 2 * s >= t * (len(np.unique(pair[a:b - 1])) + self.least):
                yield a, b


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` (text) with ``licenses``: an array of (license, dice, line).

    ``line`` counts from 0; -1 is the whole text, told only if its words span several lines.  A window is told with the line on
    which it begins, and only if it shares no word with a line or whole text told for the same template.  A unit may match several
    templates; lines come first, then the whole text, then windows, each by the order of the templates.  Null and empty texts and units
    of fewer than two words match nothing.  Other columns are kept; one named ``licenses`` is replaced.
    """
    scanner = Scanner(templates, threshold)
    kept = [c for c in docs.columns if c != "licenses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(scanner.scan(words.texts_of(batch["text"])), _MATCH)], names=[*kept, "licenses"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], "licenses array<struct<license:string,dice:double,line:int>>"])
    return docs.select(*kept).mapInArrow(run, schema)
