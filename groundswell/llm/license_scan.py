"""License notices: MinHash over text windows retrieves templates, shingle containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from groundswell.llm.common import lower_ascii, map_arrow, mix, text_blocks, window_hashes, word_bounds, word_hashes

# Public license texts and the notices by which works name their license, under SPDX ids.
_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    "All rights reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": f"{_BSD} {_WARRANTY}",
    "BSD-3-Clause": (
        f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        f"derived from this software without specific prior written permission. {_WARRANTY}"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def _letters(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, and ASCII punctuation as spaces: notices are quoted with different punctuation."""
    data = lower_ascii(data)
    odd = ((data >= 33) & (data < 48)) | ((data >= 58) & (data < 97)) | ((data >= 123) & (data < 127))
    return np.where(odd, np.uint8(32), data)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in order of place, and each text's first word."""
    data = _letters(data)
    starts, ends, firsts = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), firsts


def _grams(each: np.ndarray, firsts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order of place, and where each text's begin."""
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(len(each))
    grams = window_hashes(each, words)
    place = np.flatnonzero(left[: len(grams)] >= words)
    return grams[place], np.searchsorted(place, firsts)


def samples_needed(jaccard: float, chance: float) -> int:
    """Bands of one sample so that a window of similarity ``jaccard`` to a template collides with it but for ``chance``."""
    return math.ceil(math.log(chance) / math.log1p(-jaccard))


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, words: int = 5, containment: float = 0.8, chance: float = 1e-4) -> DataFrame:
    """doc_id, licenses (names of the templates found, sorted), best (the highest containment verified, else 0) for every row.

    A template's set holds its shingles of ``words`` words. Templates are grouped by size into windows: blocks of b
    shingles, b the next power of two from the template's size, two blocks a window, each block in two windows, so that
    every occurrence lies inside a window. If a window holds ``containment`` of a template of t shingles, their
    similarity is at least containment * t / (2 * b + t), and as many bands of one MinHash sample each are used as make
    them collide but for ``chance``. Templates that collide are verified: the share of their shingles that the window
    holds has to reach ``containment``.

    Whole texts are scanned where they lie; nothing is shuffled. Templates of under ``words`` words are found where all
    their words follow each other (containment 1); those without a word are refused. Null or
    empty text: none found. Null doc_ids and repeated rows pass through. Other columns are not read.
    """
    known: dict[int, list[tuple[str, np.ndarray]]] = {}
    short: dict[int, list[tuple[str, np.uint64]]] = {}
    for name, text in templates.items():
        data = np.frombuffer(text.encode(), np.uint8)
        each, firsts = _words(data, np.array([0, len(data)]))
        if not len(each):
            raise ValueError(f"template {name} has no words")
        if len(each) < words:
            short.setdefault(len(each), []).append((name, window_hashes(each, len(each))[0]))
            continue
        found = np.unique(_grams(each, firsts, words)[0])
        known.setdefault(1 << max(3, (len(found) - 1).bit_length()), []).append((name, found))
    plans = []
    for block, group in known.items():
        least = min(containment * len(t) / (2 * block + len(t)) for _, t in group)
        rng = np.random.default_rng(block)
        n = samples_needed(least, chance)
        flips = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        factors = rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        keys = [np.array([((t ^ f) * a).min() for _, t in group], np.uint64) for f, a in zip(flips, factors, strict=True)]
        plans.append((block, group, flips, factors, keys))

    def scan(value: np.ndarray, cut: np.ndarray, hits: dict[int, dict[str, float]]) -> None:
        sizes = np.diff(cut)
        for block, group, flips, factors, keys in plans:
            each = -(-sizes // block)
            total = int(each.sum())
            if not total:
                continue
            text = np.repeat(np.arange(len(sizes)), each)
            first = np.cumsum(each) - each
            begin = cut[:-1][text] + (np.arange(total) - first[text]) * block
            joined = np.append(text[1:] == text[:-1], False)  # has a next block in its text
            found = set()
            for f, a, wanted in zip(flips, factors, keys, strict=True):
                least = np.minimum.reduceat((value ^ f) * a, begin)
                pair = np.where(joined, np.minimum(least, np.append(least[1:], least[-1:])), least)
                for t, key in enumerate(wanted):
                    found.update((int(w), t) for w in np.flatnonzero(pair == key))
            for w, t in found:
                name, grams = group[t]
                i = int(text[w])
                held = value[begin[w] : min(begin[w] + 2 * block, cut[i + 1])]
                share = float(np.isin(grams, held).mean())
                if share >= containment:
                    hits[i][name] = max(share, hits[i].get(name, 0.0))

    def scan_short(each: np.ndarray, firsts: np.ndarray, hits: dict[int, dict[str, float]]) -> None:
        for length, group in short.items():
            value, cut = _grams(each, firsts, length)
            for name, key in group:
                for i in np.unique(np.searchsorted(cut, np.flatnonzero(value == key), "right") - 1):
                    hits[int(i)][name] = 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column("text"), 1 << 19):
                each, firsts = _words(data, offsets)
                value, cut = _grams(each, firsts, words)
                hits: dict[int, dict[str, float]] = {i: {} for i in range(end - at)}
                scan(value, cut, hits)
                scan_short(each, firsts, hits)
                names = pa.array([sorted(hits[i]) for i in range(end - at)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), names, pa.array([max(h.values(), default=0.0) for h in hits.values()], pa.float64())], names=["doc_id", "licenses", "best"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return map_arrow(rows, run, "doc_id long, licenses array<string>, best double")
