"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are runs between white space and ASCII punctuation, A-Z lower-cased; shingles take five words. Templates fall in
classes by their number of shingles m, up to 4, 8, 16 and so on. For a class of c a text is cut into blocks of c shingles,
and two neighbours make a window, so every run of c shingles lies whole in some window. A window that holds the share q of
a template's shingles in such a run has with it a Jaccard similarity of at least q * m / (2 c + (1 - q) * m) > q / (5 - q):
0.25 for a whole template, 0.176 at the accepted ``CONTAINMENT``. ``BANDS`` bands of one MinHash each then meet it with a
probability over 1 - 1e-8, and 1 - 5e-6. A class's blocks are pairs of the class below, so all classes cost one pass. A
retrieved template is held against the exact shingles of the window and the two blocks beside it: it counts if
``CONTAINMENT`` of its shingles are there.

A template under five words is one shingle, its whole sequence, with windows of its own length at every word: those of
its hash are held against its words, and the first that equals them counts, with containment 1.

Texts are searched whole, where they lie, in runs of some megabytes of whole documents; nothing is shuffled. The template
list is a parameter of fixed size and goes to the tasks; ``templates_in`` reads one from a folder of texts. Null and empty
texts, and templates without a word, match nothing. Of equally good places in a text the first is given. Repeated rows
give repeated results; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.words import SHINGLE, SYMBOLS, chunks, ngram_hashes, word_hashes, word_spans

BANDS = 64
CONTAINMENT = 0.75
SMALLEST_CLASS = 4
FOUND = "doc_id long, license string, containment double, first_word long, n_words long"

# Public license statements and notices.
TEMPLATES = {
    "Apache-2.0 short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT short": "Released under the MIT License.",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0 short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0 short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 short": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 short": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
    "All rights reserved short": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause no-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

_SEEDS = np.random.Generator(np.random.PCG64(71)).integers(1, 2**32, (2, BANDS), dtype=np.uint32) | np.uint32(1)


def _minhash(shingles: np.ndarray, k: int) -> np.ndarray:
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    h = (h ^ _SEEDS[0, k]) * _SEEDS[1, k]
    return h ^ (h >> np.uint32(15))


class _Templates:
    def __init__(self, templates: Mapping[str, str]):
        self.names, self.sets, self.order = [], [], []
        self.by_class: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[str, np.uint64, list[bytes]]]] = {}  # by number of words
        for name, text in templates.items():
            data, ends = _one(text)
            words, _ = word_hashes(data, ends, SYMBOLS)
            grams = ngram_hashes(words, SHINGLE)
            if 0 < len(words) < SHINGLE:
                self.short.setdefault(len(words), []).append((name, ngram_hashes(words, len(words))[0], _spelled(data, *word_spans(data, ends, SYMBOLS)[:2])))
            if not len(grams):
                continue
            size = SMALLEST_CLASS
            while size < len(grams):
                size *= 2
            self.by_class.setdefault(size, []).append(len(self.sets))
            self.names.append(name)
            self.sets.append(np.unique(grams))
        # for each class and band: the templates by MinHash value
        self.bands = {}
        for size, members in self.by_class.items():
            for k in range(BANDS):
                value = np.array([_minhash(self.sets[m], k).min() for m in members], np.uint32)
                order = np.argsort(value, kind="stable")
                there = np.zeros(1 << 16, bool)
                there[value >> np.uint32(16)] = True
                self.bands[size, k] = (value[order], np.array(members)[order], there)

    def retrieved(self, grams: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first and last-plus-one gram of the window and a block at each side); ``ends``: offsets of each document's grams."""
        if not self.by_class or not len(grams):
            return
        n, size, low = np.diff(ends), SMALLEST_CLASS, None
        while size <= max(self.by_class):
            blocks = -(-n // size)
            first = np.concatenate([[0], np.cumsum(blocks)])
            doc = np.repeat(np.arange(len(n)), blocks)
            if low is None:
                starts = ends[doc] + (np.arange(len(doc)) - first[doc]) * size
                low = np.stack([np.minimum.reduceat(_minhash(grams, k), starts) for k in range(BANDS)])
            else:
                low = np.minimum.reduceat(low, finer[doc] + 2 * (np.arange(len(doc)) - first[doc]), axis=1)
            finer = first
            if size in self.by_class:
                after = np.minimum(np.arange(len(doc)) + 1, first[doc + 1] - 1)  # the last block stands alone
                found: set[tuple[int, int]] = set()
                for k in range(BANDS):
                    window = np.minimum(low[k], low[k][after])
                    value, member, there = self.bands[size, k]
                    maybe = np.flatnonzero(there[window >> np.uint32(16)])
                    a, b = (np.searchsorted(value, window[maybe], side) for side in ("left", "right"))
                    for w, x, y in zip(maybe.tolist(), a.tolist(), b.tolist(), strict=True):
                        found.update((int(m), w) for m in member[x:y])
                for m, w in sorted(found):
                    d = doc[w]
                    start = int(ends[d]) + (w - int(first[d])) * size
                    yield m, max(int(ends[d]), start - size), min(int(ends[d + 1]), start + 3 * size)
            size *= 2

    def statements(self, data: np.ndarray, bytes_ends: np.ndarray, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
        """(document, template's name, first word, words) of the first place of each short template in each document."""
        spans = None
        for size, members in self.short.items():
            grams = ngram_hashes(words, size)
            for name, value, spelled in members:
                hits = np.flatnonzero(grams == value)
                docs = np.searchsorted(at, hits, "right") - 1
                seen = set()
                for p, d in zip(hits.tolist(), docs.tolist(), strict=True):
                    if d in seen or p + size > at[d + 1]:
                        continue
                    spans = spans or word_spans(data, bytes_ends, SYMBOLS)
                    if _spelled(data, spans[0][p : p + size], spans[1][p : p + size]) == spelled:
                        seen.add(d)
                        yield d, name, p - int(at[d]), size


def _spelled(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """The words of these spans, A-Z lower-cased."""
    return [data[a:b].tobytes().lower() for a, b in zip(starts, stops, strict=True)]


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def best_match(grams: np.ndarray, template: np.ndarray) -> tuple[float, int, int]:
    """(containment, first gram, last gram) of a template in a run of grams."""
    at = np.flatnonzero(np.isin(grams, template))
    return (len(np.unique(grams[at])) / len(template), int(at[0]), int(at[-1])) if len(at) else (0.0, 0, 0)


def templates_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """The texts of a folder's files by file name: a template list, which the driver and each task hold whole."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1), "value").collect()
    return {name: text for name, text in sorted(rows)}


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row for each document (doc_id, text) and license found in it: the best match's containment and place."""
    given = dict(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates(given)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for first, _, data, bytes_ends in chunks(batch.column(1)):
                words, at = word_hashes(data, bytes_ends, SYMBOLS)
                every = ngram_hashes(words, SHINGLE)
                n = np.maximum(0, np.diff(at) - SHINGLE + 1)
                ends = np.concatenate([[0], np.cumsum(n)])
                grams = every[np.repeat(at[:-1] - ends[:-1], n) + np.arange(ends[-1])]
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for m, a, b in known.retrieved(grams, ends):
                    share, x, y = best_match(grams[a:b], known.sets[m])
                    d = int(np.searchsorted(ends, a, "right")) - 1
                    if share >= CONTAINMENT and share > best.get((d, m), (0.0,))[0]:
                        best[d, m] = (share, a + x - int(ends[d]), y - x + SHINGLE)
                out += [(ids[first + d], known.names[m], *v) for (d, m), v in sorted(best.items())]
                out += [(ids[first + d], name, 1.0, a, n) for d, name, a, n in known.statements(data, bytes_ends, words, at)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, FOUND)
