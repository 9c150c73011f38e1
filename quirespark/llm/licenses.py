"""Operator 9: licences by sparse TF-IDF cosine to templates, inherited from the nearest ancestor directory.

The parts of a text that may state a licence are its lines, its blocks (lines that follow each
other, all comments or none, without an empty one between), the comment that it begins with, its
first OPENING words, and the whole. Each part is a sparse vector of its words and word pairs,
compared with those of the templates: notices, and short licences or the openings of long
ones. A word weighs its inverse document frequency, a pair PAIR times that of its rarer word, and
both weigh less the more licences share them. A part whose most similar template has a cosine of THRESHOLD or more states a
licence; a file's own licence is that of its most similar part.

Which of several similar licences it is does not depend on the corpus. Those within NEAR of the largest cosine are compared by what
tells their templates apart: the share that the part has of the words and pairs which one template has and the other has
not. A licence is stated if it beats all others so; and if the part does not name another version of it, as "version 1" where
all of its template says "version 2". An identifier after SPDX-License-Identifier is read as it is, with its operators, and goes first.

Document frequencies of the templates' words are counted over all documents by built-in
functions; a word or pair that no template has weighs as a word that a single document has, each
time it occurs. Parts whose words from templates carry too little of their length for any
template are dropped before the product; by the Cauchy-Schwarz inequality none of them
could reach the threshold.

A licence file (its name begins with LICENSE, LICENCE or COPYING) gives its own licence
to its directory. Distinct directories are joined with their ancestors below the root, the deepest
with a licence is kept, and files meet the result by directory: a hot directory is one row
on the side that is aggregated, and the root, which is above all, is joined to none. A file's
own licence goes before an inherited one.

Defined cases: null and empty texts have no licence of their own and inherit; a null path is
a file in the root directory; of licence files in one directory the most similar decides,
then the smallest id; of templates the first in order of name; repeated rows are rows of
their own; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table, text_steps
from .decontaminate import words

THRESHOLD = 0.6
#: How far below the largest cosine other licences are compared word by word.
NEAR = 0.25
PAIR = 0.7
#: Words of the beginning that are compared as a part of their own.
OPENING = (60, 120)
#: The least share of its weight that a word keeps, however many licences share it.
SHARED = 0.3

#: Fixed value: how files state a licence by its identifier.
_SPDX = re.compile(rb"SPDX-License-Identifier:\s*(\(?\s*[A-Za-z0-9][\w.+-]*(?:\s*\)?\s+(?:OR|AND|WITH|or|and|with)\s+\(?\s*[A-Za-z0-9][\w.+-]*)*\s*\)?)")
#: Words after which a number is a version.
_VERSIONED = (b"version", b"v", b"license", b"licence", b"public", b"sa", b"by", b"nc", b"nd", b"sharealike", b"attribution", b"noncommercial", b"noderivatives", b"mpl", b"epl", b"gpl", b"lgpl")
_COMMENT = re.compile(rb"\s*(#|//|/\*|\*|--|;|%|<!--|\.\.|rem\b|dnl\b)", re.IGNORECASE)

_FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"

#: Notices by which files state the licences named, short licences, and the openings of long ones.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. Licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAME} {_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD} {_BSD_NAME}"),
    ("BSD-3-Clause", _BSD_NAME),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) of an original work of authorship and/or a database"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_FSF} Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_FSF} This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_FSF} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT} {_MIT_END}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. Contributor Version means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
    ("PSF-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2 1. This LICENSE AGREEMENT is between the Python Software Foundation (PSF), and the Individual or Organization (Licensee) accessing and otherwise using this software (Python) in source or binary form and its associated documentation. 2. Subject to the terms and conditions of this License Agreement, PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative works, distribute, and otherwise use Python"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("BSD-4-Clause", f"{_BSD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. {_BSD_NAME[3:]} {_BSD_END}"),
    ("BSD-4-Clause", f"BSD 4-Clause License {_BSD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. {_BSD_NAME[3:]}"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 1.0 which is available at https://www.eclipse.org/legal/epl-1.0/"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License."),
)


#: Versions of the licences of works before 4.0.
OLDER = ("2.0", "2.5", "3.0")


def tagged(templates: tuple) -> tuple:
    """The templates, those of free software with the paragraph on warranty, those of works in older versions, and lines that name a licence in short."""
    hopeful = [(n, f"{t} This {t.split()[1]} {_HOPE} See the GNU {'Lesser ' if n[0] == 'L' else 'Affero ' if n[0] == 'A' else ''}General Public License for more details.") for n, t in templates if "GPL-" in n and t.startswith(("This program is free", "This library is free"))]
    older = [(n.replace("4.0", v), t.replace("4.0 International", f"{v} {kind}")) for n, t in templates if n.startswith("CC-BY") and t.startswith("This work") for v in OLDER for kind in ("Unported", "Generic" if v < "3" else "International")]
    found = [*templates, *hopeful, *older]
    names = sorted({n for n, _ in found})
    short = [(n, f"Licensed under {n.replace('-', ' ')}.") for n in names if not n.startswith("CC-")]
    creative = [(n, f"Licensed under CC {n[3:-4]} {n[-3:]}.") for n in names if n.startswith("CC-")]
    return (*found, *short, *creative)


ALL = tagged(TEMPLATES)


class Vocabulary:
    """The templates' words and pairs of words by id, and the templates' counts (words and pairs, templates)."""

    def __init__(self, templates=ALL):
        self.names = np.array([n for n, _ in templates])
        self.ids: dict[bytes, int] = {}  # words, from 1
        rows = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(t.encode())]) for _, t in templates]
        for w in [*_VERSIONED, *(str(k).encode() for k in range(21))]:
            self.ids.setdefault(w, len(self.ids) + 1)
        self.n = len(self.ids) + 1
        self.pairs = np.unique(np.concatenate([r[:-1] * self.n + r[1:] for r in rows]))  # their ids go on from n
        self.counts = np.zeros((self.n + len(self.pairs), len(rows)), np.float32)
        for k, r in enumerate(rows):
            np.add.at(self.counts[:, k], np.r_[r, self.n + np.searchsorted(self.pairs, r[:-1] * self.n + r[1:])], 1)
        names = sorted(set(self.names))
        having = np.stack([(self.counts[:, self.names == n] > 0).any(1) for n in names], 1).sum(1)
        #: By template the words and pairs that it has, and by versioned word the number words that follow it.
        self.having = [frozenset(np.nonzero(self.counts[:, k])[0].tolist()) for k in range(len(rows))]
        self.numbers = {self.ids[str(k).encode()] for k in range(21)}
        self.versioned = {self.ids[w] for w in _VERSIONED}
        self.versions = [self.versions_in(r.tolist()) for r in rows]
        self.telling = SHARED + (1 - SHARED) * np.log((1 + len(names)) / (1 + np.maximum(having, 1))) / np.log((1 + len(names)) / 2)

    def versions_in(self, run: list[int]) -> dict[int, set[int]]:
        """The numbers that follow each versioned word."""
        out: dict[int, set[int]] = {}
        for a, b in zip(run, run[1:], strict=False):
            if a in self.versioned and b in self.numbers:
                out.setdefault(a, set()).add(b)
        return out

    def features(self, run: np.ndarray) -> set[int]:
        """The words and pairs of templates in a run of word ids."""
        code = run[:-1] * self.n + run[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return {*run[run > 0].tolist(), *(self.n + at[(self.pairs[at] == code) & (run[:-1] > 0)]).tolist()}

    def decide(self, run: np.ndarray, cos: np.ndarray) -> int:
        """The template whose licence a run states, of those near the largest cosine; -1 if none beats all others, or the run names another version."""
        near = np.nonzero(cos >= cos.max() - NEAR)[0]
        best: dict[str, int] = {}
        for k in near[np.argsort(-cos[near], kind="stable")].tolist():
            best.setdefault(str(self.names[k]), k)
        own = self.features(run)

        def share(a: int, b: int) -> float:
            only = self.having[a] - self.having[b]
            return len(only & own) / len(only) if only else 0.5

        won = [a for a in best.values() if all(share(a, b) > share(b, a) for b in best.values() if b != a)]
        if not won:
            return -1
        said = self.versions_in(run.tolist())
        other = any(w in said and not said[w] & numbers for w, numbers in self.versions[won[0]].items())
        return -1 if other else won[0]

    def tokens(self, text: bytes | None) -> list[int]:
        get = self.ids.get
        return [get(x, 0) for x in words(text)]


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of documents, and for each word of the templates the number that have it."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.array_intersect(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.array(*(F.lit(w.decode()) for w in vocabulary.ids)))
    each = F.explode(F.array_append(F.coalesce(own, F.array().cast("array<string>")), F.lit(""))).alias("w")  # the empty word stands for the document
    found = {r.w: r["count"] for r in docs.select(each).groupBy("w").count().collect()}  # a row for each word of the templates
    out = np.zeros(vocabulary.n, np.int64)
    for w, k in vocabulary.ids.items():
        out[k] = found.get(w.decode(), 0)
    return found.get("", 0), out


def weights(v: Vocabulary, n: int, df: np.ndarray) -> np.ndarray:
    """Weights by id of words, then of pairs; at 0 that of any other."""
    idf = np.log((1 + n) / (1 + df)) + 1
    idf[0] = np.log((1 + n) / 2) + 1
    out = np.r_[idf, PAIR * np.maximum(idf[v.pairs // v.n], idf[v.pairs % v.n])] * v.telling
    out[0] = idf[0]
    return out


def cosines(v: Vocabulary, weight: np.ndarray, runs: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For every run of word ids the template that it states (-1: none) and the cosine."""
    size = np.array([len(r) for r in runs], np.int64)
    flat = np.concatenate([*runs, np.zeros(0, np.int64)])
    run = np.repeat(np.arange(len(runs)), size)
    inner = np.nonzero(run[1:] == run[:-1])[0]
    code = flat[inner] * v.n + flat[inner + 1]
    at = np.minimum(np.searchsorted(v.pairs, code), len(v.pairs) - 1)
    pair = np.where((v.pairs[at] == code) & (flat[inner] > 0), v.n + at, 0)
    other = np.bincount(run[flat == 0], minlength=len(runs)) * weight[0] ** 2 + np.bincount(run[inner][pair == 0], minlength=len(runs)) * (PAIR * weight[0]) ** 2
    flat, run = np.r_[flat, pair], np.r_[run, run[inner]]
    own = flat > 0
    key, tf = np.unique(run[own] * len(weight) + flat[own], return_counts=True)
    of, word = key // len(weight), key % len(weight)
    w = tf * weight[word]
    inside = np.bincount(of, weights=w**2, minlength=len(runs))
    length = inside + other
    hopeful = (inside >= threshold**2 * length) & (inside > 0)
    best, score = np.full(len(runs), -1), np.zeros(len(runs))
    keep = hopeful[of]
    of, word, w = of[keep], word[keep], w[keep]
    if of.size:
        t = v.counts * weight[:, None]
        t /= np.linalg.norm(t, axis=0)
        starts = np.nonzero(np.r_[True, of[1:] != of[:-1]])[0]
        cos = np.add.reduceat(w[:, None] * t[word], starts, axis=0) / np.sqrt(length[of[starts]])[:, None]
        for i in np.nonzero(cos.max(1) >= threshold)[0].tolist():
            r = of[starts[i]]
            k = v.decide(runs[r], cos[i])
            if k >= 0 and cos[i, k] >= threshold:
                best[r], score[r] = k, cos[i, k]
    return best, score


def parts(v: Vocabulary, text: bytes | None) -> list[np.ndarray]:
    """The parts of a text as runs of word ids: lines, blocks, the comment that it begins with, openings, and the whole."""
    lines, marked = [], []
    for x in (text or b"").split(b"\n"):
        lines.append(v.tokens(x))
        marked.append(_COMMENT.match(x) is not None)
    out = [x for x in lines if x]
    block: list[int] = []
    length = 0
    for k, x in enumerate(lines):
        if block and (not x or marked[k] != marked[k - 1]):
            if length > 1:
                out.append(block)
            block, length = [], 0
        block.extend(x)
        length += bool(x)
    if length > 1:
        out.append(block)
    code = next((k for k, x in enumerate(lines) if x and not marked[k]), len(lines))
    out.append([w for x in lines[:code] for w in x])
    whole = [w for x in lines for w in x]
    out += [whole[:n] for n in OPENING if n < len(whole)]
    out.append(whole)
    return [np.array(x, np.int64) for x in out if x]


def identified(text: bytes | None) -> str | None:
    """The first licence that a text states by identifier; -only, -or-later and + are left out, and so are brackets around all of it."""
    found = _SPDX.search(text) if text else None
    if found is None:
        return None
    tokens = re.findall(r"[()]|[^\s()]+", found[1].decode("ascii"))
    tokens = [t.upper() if t.upper() in ("OR", "AND", "WITH") else re.sub(r"(-only|-or-later|\+)$", "", t) for t in tokens]
    if tokens.count("(") != tokens.count(")"):
        tokens = [t for t in tokens if t not in "()"]
    elif tokens[0] == "(" and tokens[-1] == ")" and tokens.count("(") == 1:
        tokens = tokens[1:-1]
    return " ".join(tokens).replace("( ", "(").replace(" )", ")")


def own_licenses(files: DataFrame, threshold: float = THRESHOLD, templates=ALL) -> DataFrame:
    """files (doc_id, path, text) as (doc_id, path, own_license, own_score)."""
    v = Vocabulary(templates)
    sent = files.sparkSession.sparkContext.broadcast((v, weights(v, *frequencies(files, v))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weight = sent.value
        for b in (s for batch in batches for s in text_steps(batch, "t")):
            texts = b.column("t").to_pylist()
            stated = [identified(t) for t in texts]
            runs = [parts(v, t) if i is None else [] for i, t in zip(stated, texts, strict=True)]
            edge = np.r_[0, np.cumsum([len(x) for x in runs])]
            best, score = cosines(v, weight, [x for y in runs for x in y], threshold)
            names, scores = [], []
            for start, stop, by_name in zip(edge, edge[1:], stated, strict=False):
                c, t = max(((float(score[k]), -int(best[k])) for k in np.nonzero(best[start:stop] >= 0)[0] + start), default=(0.0, None))
                names.append(by_name if by_name else None if t is None else str(v.names[-t]))
                scores.append(1.0 if by_name else min(1.0, c))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "path", "own_license", "own_score"])

    return files.select("doc_id", "path", F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, path string, own_license string, own_score double")


def inherit(files: DataFrame) -> DataFrame:
    """files (doc_id, path, own_license, own_score) with license, how (own, inherited, none), licensed_by and from_dir."""
    path = F.coalesce(F.regexp_replace(F.regexp_replace("path", "/+", "/"), "^(\\./|/)+", ""), F.lit(""))
    placed = files.withColumn("_dir", F.regexp_extract(path, "^(.*)/[^/]*$", 1)).withColumn("_name", F.upper(F.element_at(F.split(path, "/"), -1)))
    giving = placed.where(F.col("own_license").isNotNull() & F.col("_name").rlike("^(LICENSE|LICENCE|COPYING)"))
    given = giving.groupBy(F.col("_dir").alias("from_dir")).agg(F.max_by(F.struct("own_license", "doc_id"), F.struct("own_score", -F.col("doc_id"))).alias("g"))
    dirs = placed.where("_dir <> ''").select("_dir").distinct()
    names = F.split("_dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(names, F.lit(1), n), "/").alias("dir"))))
    nearest = dirs.select("_dir", above.alias("_a")).join(given, F.col("_a.dir") == F.col("from_dir")).groupBy("_dir").agg(F.max_by(F.struct("from_dir", "g"), F.col("_a.depth")).alias("_n"))
    top = given.where("from_dir = ''").first()  # at most one row
    root = F.lit(None).cast(nearest.schema["_n"].dataType) if top is None else F.struct(F.lit("").alias("from_dir"), F.struct(F.lit(top.g.own_license).alias("own_license"), F.lit(top.g.doc_id).alias("doc_id")).alias("g"))
    met = placed.join(bounded(cut(nearest)), "_dir", "left").withColumn("_n", F.coalesce("_n", root))
    own = F.col("own_license").isNotNull()
    return met.select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "_n.g.own_license").alias("license"),
        F.when(own, "own").when(F.col("_n").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(own, F.col("doc_id")).otherwise(F.col("_n.g.doc_id")).alias("licensed_by"),
        F.when(~own, F.col("_n.from_dir")).alias("from_dir"),
    )


def scan(files: DataFrame, threshold: float = THRESHOLD, templates=ALL) -> DataFrame:
    """The licence of every row of files (doc_id, path, text), its own or inherited."""
    return inherit(cut(own_licenses(files, threshold, templates)))


def tree(docs: DataFrame) -> DataFrame:
    """documents as files: two levels of directories in every source, and licence files for one id in 20 at either level."""
    i, top = F.col("doc_id"), F.coalesce("source", F.lit("nowhere"))
    sub = F.concat(top, F.lit("/d"), (F.pmod(i, F.lit(7))).cast("string"))
    path = (
        F.when(F.pmod(i, F.lit(40)) == 0, F.concat(top, F.lit("/LICENSE-"), i.cast("string")))
        .when(F.pmod(i, F.lit(40)) == 20, F.concat(sub, F.lit("/LICENSE-"), i.cast("string")))
        .otherwise(F.concat(sub, F.lit("/"), F.pmod(i, F.lit(3)).cast("string"), F.lit("/"), i.cast("string"), F.lit(".txt")))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def op9_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tree(table(spark, sf_dir, "documents")))
