"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

A window of a document is as long as the template, or the whole document where that is shorter, and
the coefficient of window and template is 2 * common bigrams / (bigrams of both), over multisets.
Size bounds prune: a coefficient of T needs sizes within T / (2 - T) of each other, so a template is
out for a document that has fewer words, or fewer of the template's bigrams, than the least that
could do. What is left is found by running sums over the places of the template's bigrams, at
every place of the document, and the exact coefficient decides. Of windows that overlap, the one
with the largest coefficient stands.

Templates are the planted kind of one-line notice, each licence's name in the wordings that notices
use (``-line-1`` and so on), SPDX tags, short licences, and whole texts (``-text``, ``WHOLE``).
A part that is letter by letter the same stands before a whole text with a changed word.
"""

from __future__ import annotations

import pkgutil
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kegler.llm.vocabulary import text_slices

THRESHOLD = 0.85
#: Words that take part: runs of letters, digits and characters beyond ASCII, lower-cased A-Z.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))

# Public licence notices and short licences, as their publishers word them.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-line": "Released under the BSD License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "CC0-line": "Released under CC0 1.0 Universal.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
    "All-rights-reserved-line": "All rights reserved.",
    "BSD-3-Clause-endorsement": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "AGPL-3.0-heading": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Public-domain-line": "This work is in the public domain.",
    "Public-domain-line-1": "dedicated to the public domain",
}
# Names that follow "under" in notices of one line.
_NAMES = {
    "MIT": ["the MIT License", "MIT License", "the terms of the MIT License", "the MIT licence", "an MIT license"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0", "the Apache-2.0 license", "the terms of the Apache License, Version 2.0"],
    "BSD": ["the BSD License", "a BSD license", "a BSD-style license", "the terms of the BSD License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License"],
    "ISC": ["the ISC License", "ISC License"],
    "Zlib": ["the zlib License"],
    "Unlicense": ["the Unlicense"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL 2.0"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 Universal license"],
    "GPL": ["the GNU General Public License", "the GNU GPL", "the GPL"],
    "LGPL": ["the GNU Lesser General Public License", "the GNU LGPL", "the LGPL"],
    "AGPL": ["the GNU Affero General Public License", "the GNU AGPL", "the AGPL"],
}
for _id, _long, _versions in (("GPL", "General", "23"), ("LGPL", "Lesser General", "3"), ("AGPL", "Affero General", "3")):
    for _v in _versions:
        _NAMES[f"{_id}-{_v}.0"] = [f"the GNU {_long} Public License, version {_v}", f"the GNU {_long} Public License v{_v}", f"the GNU {_long} Public License v{_v}.0", f"the GNU {_id} v{_v}", f"the GNU {_id}, version {_v}", f"the {_id}v{_v}", f"{_id}v{_v}", f"the {_id} v{_v}", f"{_id} v{_v}", f"{_id}-{_v}.0"]
_NAMES["LGPL-2.1"] = ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL, version 2.1", "LGPL-2.1", "the LGPL 2.1"]
_ATTRIBUTION = {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
for _short, _long in _ATTRIBUTION.items():
    for _v, _port in (("4.0", "International"), ("3.0", "Unported")):
        _name = f"a Creative Commons Attribution{_long} {_v} {_port} License"
        _NAMES[f"CC-BY{_short}-{_v}"] = [f"CC BY{_short} {_v}", f"a CC BY{_short} {_v} license", f"the CC BY{_short} {_v} license", _name, _name.replace("a ", "the ", 1), f"Creative Commons Attribution{_long} {_v}"]
for _id, _names in _NAMES.items():
    for _k, _name in enumerate(_names, 1):
        TEMPLATES[f"{_id}-line-{_k}"] = f"under {_name}"
for _id in ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "MPL-2.0", "CC0-1.0"] + [f"CC-BY{x}-{v}" for x in _ATTRIBUTION for v in ("4.0", "3.0")] + [f"{x}-{k}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for k in ("only", "or-later")]:
    TEMPLATES[f"{_id}-spdx"] = f"SPDX-License-Identifier: {_id}"
for _id in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
    TEMPLATES[f"{_id}-spdx"] = f"SPDX-License-Identifier: {_id}"

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_TEXTS = ("Apache-2.0", "Artistic-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
#: Whole licence texts; those of ``license_texts`` are as their publishers word them.
WHOLE = {f"{x}-text": pkgutil.get_data("kegler.llm", f"license_texts/{x}.txt").decode() for x in _TEXTS}
# Their names come before that of the conditions they share, which decides where all is letter by letter the same.
WHOLE["BSD-2-Clause"] = f"{TEMPLATES['BSD-conditions']} {_AS_IS}"
WHOLE["BSD-3-Clause"] = f"{TEMPLATES['BSD-conditions']} {_ENDORSE} {_AS_IS}"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def dice(a: list, b: list) -> float:
    """Over multisets of bigrams; 0 where either has none."""
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if x and y else 0.0


def _commons(pairs: np.ndarray, own: Counter, size: int, begins: list[int]) -> list[int]:
    """Bigrams in common with the template of each window, by moving one window on: a step costs the same for any size."""
    out: list[int] = []
    if not begins:
        return out
    have: dict[int, int] = {}
    common, low, high = 0, begins[0], begins[0]
    for b in begins:
        if b >= high:
            have, common, low, high = {}, 0, b, b
        for p in pairs[low:b].tolist():
            if p in own:
                common -= have[p] <= own[p]
                have[p] -= 1
        for p in pairs[high : b + size].tolist():
            if p in own:
                have[p] = have.get(p, 0) + 1
                common += have[p] <= own[p]
        low, high = b, b + size
        out.append(common)
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.number: dict[bytes, int] = {}
        self.templates: list[tuple[str, list[int]]] = []
        for name in sorted(templates):
            words = words_of(templates[name].encode())
            if len(words) < 2:
                raise ValueError(f"template {name} has no bigram")
            self.templates.append((name, [self.number.setdefault(w, len(self.number) + 1) for w in words]))
        self.base = len(self.number) + 1
        self.counts = [Counter(a * self.base + b for a, b in zip(t, t[1:], strict=False)) for _, t in self.templates]
        self.codes = [np.array(sorted(c), np.int64) for c in self.counts]
        self.every = np.unique(np.concatenate(self.codes))
        self.sizes = np.array([len(t) - 1 for _, t in self.templates])
        self.member = np.stack([np.isin(self.every, c) for c in self.codes], axis=1)

    def scan(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(name, coefficient, first word, word after the last) of the windows that stand, in order."""
        if len(words) < 2:
            return []
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        pairs = ids[:-1] * self.base + ids[1:]
        pairs[(ids[:-1] == 0) | (ids[1:] == 0)] = -1
        at = np.flatnonzero(pairs >= 0)
        which = np.minimum(np.searchsorted(self.every, pairs[at]), len(self.every) - 1)
        hit = self.every[which] == pairs[at]
        at, which = at[hit], which[hit]
        if not len(at):
            return []
        # 2 * common / (size + n) >= threshold
        size_of = np.minimum(self.sizes, len(pairs))
        least_of = np.ceil(self.threshold * (size_of + self.sizes) / 2 - 1e-9).astype(np.int64)
        number = np.bincount(which, minlength=len(self.every)) @ self.member if len(at) > len(self.every) else self.member[which].sum(axis=0)
        found = []
        for k in np.flatnonzero((least_of <= size_of) & (number >= least_of)).tolist():
            name, n, size, least = self.templates[k][0], int(self.sizes[k]), int(size_of[k]), int(least_of[k])
            own = at[self.member[which, k]]
            # Places of the template's bigrams within each window that begins at one of them, or ends there.
            begins = np.unique(np.concatenate([np.minimum(own, len(pairs) - size), np.maximum(own - size + 1, 0)]))
            inside = np.searchsorted(own, begins + size) - np.searchsorted(own, begins)
            begins = begins[inside >= least].tolist()
            for b, common in zip(begins, _commons(pairs, self.counts[k], size, begins), strict=True):
                d = 2 * common / (size + n)
                if d >= self.threshold:
                    found.append((-d, b, name, b + size + 1))
        kept: list[tuple[str, float, int, int]] = []
        taken = np.zeros(len(words), bool)
        for d, b, name, e in sorted(found):
            if not taken[b:e].any():
                taken[b:e] = True
                kept.append((name, -d, b, e))
        return sorted(kept, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document: key, n_words, n_matches, licenses (distinct names in order of the alphabet,
    joined by commas), best (name of the largest coefficient; the first in the text, then by name,
    of ties; null without a match), dice (its coefficient, 6 decimals) and matches (name:from:to of words).

    A null text has no words. Rows repeat as they come, other columns are ignored. Templates are a
    parameter of the scan and travel with it; documents aren't shuffled.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES | WHOLE if templates is None else templates, threshold))

    def run(batches):
        scanner = shipped.value
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                out: dict[str, list] = {"n_words": [], "n_matches": [], "licenses": [], "best": [], "dice": [], "matches": []}
                for t in batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist():
                    words = words_of(t or b"")
                    found = scanner.scan(words)
                    best = min(found, key=lambda x: (-x[1], x[2], x[0]), default=None)
                    row = len(words), len(found), ",".join(sorted({x[0] for x in found})), best and best[0], best and round(best[1], 6), ",".join(f"{n}:{f}:{e}" for n, _, f, e in found)
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
                kinds = {"n_words": pa.int64(), "n_matches": pa.int64(), "dice": pa.float64()}
                yield pa.RecordBatch.from_pydict({key: batch.column(0).slice(a, b - a)} | {c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_words long, n_matches long, licenses string, best string, dice double, matches string")


def normalised(text: str) -> str:
    """The words that take part, one blank between; for reading results."""
    return re.sub(rb"\s+", b" ", text.encode().translate(_TABLE)).strip().decode()
