"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

A text is lower-cased (A-Z) and read as tokens of letters and digits, with the markup of comments and punctuation
gone. Templates are the usual notices and the whole texts of the short licenses. Templates of like length are a class; each class has its own windows, wide enough that any occurrence of a
template lies whole in one of them. A window's MinHash signature is cut into bands; a template that shares a
band is retrieved. The number of bands follows from the least Jaccard similarity that a window can have with a template it
contains to the wanted degree, so that one is missed with a probability of at most `MISS`.

Notices of sibling licenses share most of their shingles. `Scanner.scan` gives all templates that are contained; `Scanner.licenses`, and so
the scan of a table, tells siblings apart: a match needs at least half of the shingles that tell its template from
each template of another license that holds it to the wanted degree, and half of those with a number (versions).
Where matches of different licenses lie on the same shingles, the one with the highest containment stays, then the one of the longest
template. The first sentence of the BSD licenses alone counts as BSD-3-Clause.

A window without any shingle of any template cannot share a minimum with one and is passed over before signatures
are made; nothing else is. Whole texts are scanned, row by row, without a shuffle. Null and empty texts have no match.
Repeated rows, and rows that share an id, are scanned each for itself; other columns pass through, the output replaces one of its name.
An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import free_name

# Identifiers and the wording of the usual notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    ),
    "CC0-1.0": ("This work is licensed under the Creative Commons CC0 1.0 Universal Public Domain Dedication",),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder"
        " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior"
        " written permission. This software is provided by",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
}

# Whole texts of the short licenses; the year and the holder stand before them.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
    " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY"
    " CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
    " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are"
    " met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT"
    " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT"
    " HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT"
    " LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY"
    " THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF"
    " THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
WHOLE_TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to"
        " the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software. " + _WARRANTY,
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"
        " above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL"
        " WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE"
        " LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS"
        " SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages"
        " arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial"
        " applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not"
        " be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in"
        " the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must"
        " not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"
        " covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare"
        " derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
        " The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following"
        " disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such"
        " copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or"
        " distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any"
        " means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in"
        " the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and"
        " successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this"
        " software under copyright law.",
    ),
    "BSD-2-Clause": (_BSD_CONDITIONS + _BSD_DISCLAIMER,),
    "BSD-3-Clause": (
        _BSD_CONDITIONS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission. " + _BSD_DISCLAIMER,
    ),
}
TEMPLATES = {name: TEMPLATES.get(name, ()) + WHOLE_TEXTS.get(name, ()) for name in {**TEMPLATES, **WHOLE_TEXTS}}

SHINGLE = 3
CONTAINMENT = 0.8
MISS = 1e-6
_ROWS = 2
_SPREAD = 1.5
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(body: bytes) -> list[bytes]:
    return _TOKEN.findall(body.lower())


def _shingles(words: list[bytes]) -> np.ndarray:
    joined = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return np.array([xxhash.xxh64_intdigest(s) for s in joined], np.uint64)


@dataclass
class TemplateClass:
    """Templates whose lengths differ by no more than half, and the windows to look for them in."""

    names: list[str]
    shingles: list[np.ndarray]
    width: int  # tokens of a window
    stride: int
    seeds: np.ndarray
    bands: dict[tuple[int, bytes], list[int]]
    telling: list[list[np.ndarray]]  # of each template, sets of shingles of which half must be there

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (shingles[:, None] ^ self.seeds) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
        return mixed.min(0)

    def retrieve(self, shingles: np.ndarray) -> set[int]:
        rows = self.signature(shingles).reshape(-1, _ROWS)
        return {t for i, row in enumerate(rows) for t in self.bands.get((i, row.tobytes()), ())}


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, containment: float = CONTAINMENT, miss: float = MISS):
        self.containment = containment
        known = sorted(((len(t), name, t) for name, texts in templates.items() for t in (tokens(x.encode()) for x in texts)), key=lambda x: x[:2])
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, _, t in known for w in t}))}
        base = len(self.vocabulary) + 1
        if base**SHINGLE >= 1 << 63:
            raise ValueError("the templates have too many different words")
        self._powers = base ** np.arange(SHINGLE)
        codes = [self._codes(np.array([self.vocabulary[w] for w in t])) for _, _, t in known if len(t) >= SHINGLE]
        if len(codes) < len(known):
            raise ValueError(f"a template needs {SHINGLE} words at least")
        self.codes = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
        self.classes: list[TemplateClass] = []
        every = [(name, np.unique(_shingles(t))) for _, name, t in known]
        while known:
            members = [x for x in known if x[0] <= max(known[0][0] * _SPREAD, known[0][0] + 2)]
            known = known[len(members) :]
            longest = members[-1][0]
            stride = max(1, longest // 4)
            width = longest + stride
            shingles = [np.unique(_shingles(t)) for _, _, t in members]
            fewest = min(map(len, shingles))
            jaccard = containment * fewest / (width - SHINGLE + 1 + (1 - containment) * fewest)
            count = math.ceil(math.log(miss) / math.log1p(-(jaccard**_ROWS)))
            own = TemplateClass([n for _, n, _ in members], shingles, width, stride, np.random.default_rng(6).integers(0, 1 << 63, count * _ROWS, np.uint64), {}, [])
            for (_, name, t), own_set in zip(members, shingles, strict=True):
                others = [own_set[~np.isin(own_set, x)] for n, x in every if n != name and np.isin(own_set, x).mean() >= containment]
                numbered = [w for w in range(max(1, len(t) - SHINGLE + 1)) if any(x.isdigit() for x in t[w : w + SHINGLE])]
                own.telling.append([x for x in (*others, np.unique(_shingles(t)[numbered])) if len(x)])
            for t, s in enumerate(shingles):
                for i, row in enumerate(own.signature(s).reshape(-1, _ROWS)):
                    own.bands.setdefault((i, row.tobytes()), []).append(t)
            self.classes.append(own)

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each shingle of known words, 0 where a word is not known."""
        n = len(ids) - SHINGLE + 1
        if n <= 0:
            return np.empty(0, np.int64)
        parts = np.stack([ids[i : i + n] for i in range(SHINGLE)], 1).astype(np.int64)
        return np.where((parts > 0).all(1), parts @ self._powers, 0)

    def scan(self, body: bytes | None) -> list[tuple[str, int, int, float]]:
        """Matches: license, first token and end of the window, containment. Of a license's overlapping matches, the best."""
        return sorted((m for m, *_ in _best(self._found(body))), key=lambda m: (m[1], m[0]))

    def licenses(self, body: bytes | None) -> list[tuple[str, int, int, float]]:
        """Matches as of `scan` that have what tells them from other licenses; of those on the same shingles, the best."""
        kept: list[tuple[tuple[str, int, int, float], np.ndarray]] = []
        for match, places, _ in sorted(_best([x for x in self._found(body) if x[2]]), key=lambda x: (-x[0][3], -len(x[1]), x[0])):
            if not any(m[0] != match[0] and 2 * np.isin(places, others).sum() > len(places) for m, others in kept):
                kept.append((match, places))
        return sorted((m for m, _ in kept), key=lambda m: (m[1], m[0]))

    def _found(self, body: bytes | None) -> list[tuple[tuple[str, int, int, float], np.ndarray, bool]]:
        """Every match, the places of its shingles, and whether it has enough of the telling ones."""
        words = tokens(body) if body else []
        if len(words) < SHINGLE:
            return []
        known = self.vocabulary.get
        hits = np.flatnonzero(np.isin(self._codes(np.array([known(w, 0) for w in words])), self.codes))
        found: list[tuple[tuple[str, int, int, float], np.ndarray, bool]] = []
        for kind in self.classes:
            # Windows (start, start + width) that hold at least one of the shingles.
            starts: set[int] = set()
            for hit in hits.tolist():
                first = max(0, -(-(hit + SHINGLE - kind.width) // kind.stride))
                starts.update(range(first * kind.stride, hit + 1, kind.stride))
            for start in sorted(starts):
                placed = _shingles(words[start : start + kind.width])
                own = np.unique(placed)
                for t in kind.retrieve(own):
                    share = float(np.isin(kind.shingles[t], own).mean())
                    if share >= self.containment:
                        told = all(2 * np.isin(x, own).sum() >= len(x) for x in kind.telling[t])
                        places = start + np.flatnonzero(np.isin(placed, kind.shingles[t]))
                        found.append(((kind.names[t], start, min(len(words), start + kind.width), share), places, told))
        return found


def _best(found: list[tuple[tuple[str, int, int, float], np.ndarray, bool]]) -> list[tuple[tuple[str, int, int, float], np.ndarray, bool]]:
    """Of a license's overlapping matches, the best."""
    best: list[tuple[tuple[str, int, int, float], np.ndarray, bool]] = []
    for x in sorted(found, key=lambda x: (x[0][0], -x[0][3], x[0][1], x[0][2])):
        match = x[0]
        if not any(m[0] == match[0] and m[1] < match[2] and match[1] < m[2] for m, *_ in best):
            best.append(x)
    return best


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, containment: float = CONTAINMENT, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds licenses: an array of (license, first token, end token, containment) in order of place, empty without a match."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "licenses"]
    source = docs.select(*kept, F.col(text).cast("binary").alias(free_name(docs, "_body")))
    one = "struct<license:string,start:int,end:int,containment:double>"
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept] + [f"licenses array<{one}>"])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, containment)
        names = [f.name for f in arrow.value_type]
        for batch in batches:
            made = pa.array([[dict(zip(names, m, strict=True)) for m in scanner.licenses(v.as_py())] for v in batch.column(len(kept))], arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), made], names=[*kept, "licenses"])

    return source.mapInArrow(run, schema)
