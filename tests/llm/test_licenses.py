import math
import re
import textwrap
from collections import Counter

import numpy as np
import pytest

from quirespark.llm import licenses as L

from .conftest import DOCUMENTS

TEXTS = [
    "Some prose here.\nLicensed under the Apache License, Version 2.0.",
    "Released under the MIT License.",
    "# Copyright 2020 Someone\n# Licensed under the Apache License, Version 2.0.\nx = 1",
    "The MIT people released a license under protest and went home with the others",
    None,
    "",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License.",
    "word " * 20_000 + "\nLicensed under CC BY-NC 4.0.",
    "nothing",
]


def split(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def features(ws, known):
    """Counts of words and pairs, those that no template has as None."""
    pairs = list(zip(ws, ws[1:], strict=False))
    c = Counter(x for x in [*ws, *pairs] if x in known)
    return c, sum(w not in known for w in ws), sum(p not in known for p in pairs)


def plain_parts(text):
    lines = [(split(x), re.match(r"(?i)\s*(#|//|/\*|\*|--|;|%|<!--|\.\.|rem\b|dnl\b)", x) is not None) for x in (text or "").split("\n")]
    blocks, last = [], None
    for ws, comment in lines:
        if ws and last == comment and blocks:
            blocks[-1].append(ws)
        elif ws:
            blocks.append([ws])
        last = comment if ws else None
    code = next((k for k, (ws, comment) in enumerate(lines) if ws and not comment), len(lines))
    whole = [w for ws, _ in lines for w in ws]
    return [*(ws for ws, _ in lines), *(sum(b, []) for b in blocks), sum((ws for ws, _ in lines[:code]), []), *(whole[:n] for n in L.OPENING), whole]


def versions(ws):
    out = {}
    for a, b in zip(ws, ws[1:], strict=False):
        if a.encode() in L._VERSIONED and b in map(str, range(21)):
            out.setdefault(a, set()).add(b)
    return out


def plain(texts, threshold=L.THRESHOLD):
    templates = [(n, split(t)) for n, t in L.ALL]
    having = [{*ws, *zip(ws, ws[1:], strict=False)} for _, ws in templates]
    known = {x for h in having for x in h} | {w.decode() for w in L._VERSIONED} | {str(k) for k in range(21)}
    sharing = {x: max(1, len({n for (n, _), h in zip(templates, having, strict=True) if x in h})) for x in known}
    df = Counter(w for t in texts for w in set(split(t)) & known)
    rare, licences = math.log((1 + len(texts)) / 2) + 1, len({n for n, _ in templates})
    idf = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in known if isinstance(w, str)}
    telling = {x: L.SHARED + (1 - L.SHARED) * math.log((1 + licences) / (1 + k)) / math.log((1 + licences) / 2) for x, k in sharing.items()}
    weight = {x: (idf[x] if isinstance(x, str) else L.PAIR * max(idf[x[0]], idf[x[1]])) * telling[x] for x in known}
    vectors = []
    for _, ws in templates:
        c = {x: n * weight[x] for x, n in features(ws, known)[0].items()}
        norm = math.sqrt(sum(x * x for x in c.values()))
        vectors.append({x: y / norm for x, y in c.items()})
    out = []
    for t in texts:
        best = (0.0, None)
        named = re.search(r"SPDX-License-Identifier: *([\w.-]+)", t or "")
        if named:
            out.append((1.0, re.sub("-only|-or-later", "", named[1])))
            continue
        for part in plain_parts(t):
            c, words, pairs = features(part, known)
            mine = {x: n * weight[x] for x, n in c.items()}
            norm = math.sqrt(sum(x * x for x in mine.values()) + words * rare**2 + pairs * (L.PAIR * rare) ** 2)
            cos = [sum(x * v.get(w, 0) for w, x in mine.items()) / norm if norm else 0 for v in vectors]
            if max(cos) < threshold:
                continue
            near = {}
            for k in sorted(range(len(cos)), key=lambda k: -cos[k]):
                if cos[k] >= max(cos) - L.NEAR:
                    near.setdefault(templates[k][0], k)

            def share(x, y):
                only = having[x] - having[y]
                return len(only & c.keys()) / len(only) if only else 0.5

            won = [x for x in near.values() if all(share(x, y) > share(y, x) for y in near.values() if x != y)]
            said = versions(part)
            if won and cos[won[0]] >= threshold and not any(w in said and not said[w] & n for w, n in versions(templates[won[0]][1]).items()) and cos[won[0]] > best[0] + 1e-9:
                best = (cos[won[0]], templates[won[0]][0])
        out.append(best)
    return out


def test_own_licences_equal_brute_force(spark):
    texts = [*TEXTS, *(t for _, t in FOUND[:6])]
    files = spark.createDataFrame([(i, f"a/{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r for r in L.own_licenses(files).collect()}
    for i, (score, name) in enumerate(plain(texts)):
        assert got[i].own_license == name and abs(got[i].own_score - min(1, score)) < 1e-5
    assert [got[i].own_license for i in (0, 1, 2, 3, 7)] == ["Apache-2.0", "MIT", "Apache-2.0", None, "CC-BY-NC-4.0"]


CODE = "\nimport os\n\n\ndef main():\n    return os.getcwd()\n" * 5


def wrapped(text, mark="# "):
    return "\n".join(mark + x for x in textwrap.wrap(text, 70))


def fsf(kind, version, what="program", end=";"):
    return f"This {what} is free software{end} you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation{end.replace(':', ',')} either version {version} of the License, or (at your option) any later version."


def file(name):
    return max((t for n, t in L.TEMPLATES if n == name), key=len)


HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL, LESSER, AFFERO = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
FOUND = [
    ("GPL-2.0", wrapped(fsf(GPL, "2")) + "\n#\n" + wrapped(HOPE) + CODE),
    ("GPL-3.0", wrapped("Copyright (C) 2020 A. Person") + "\n//\n" + wrapped(fsf(GPL, "3", end=":"), "// ") + "\n//\n" + wrapped(HOPE, "// ") + CODE),
    ("LGPL-2.1", "/*\n" + wrapped(fsf(LESSER, "2.1", "library"), " * ") + "\n */" + CODE),
    ("LGPL-2.1", wrapped(fsf(LESSER, "2.1", "library"), "")),
    ("LGPL-3.0", wrapped(fsf(LESSER, "3", "library", ":")) + CODE),
    ("AGPL-3.0", wrapped(fsf(AFFERO, "3", end=":")) + CODE),
    ("Apache-2.0", wrapped("Copyright 2020 Someone") + "\n#\n" + wrapped(L._APACHE) + CODE),
    ("BSD-2-Clause", "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + "\n\n".join(wrapped(t, "") for t in (L._BSD, L._BSD_END))),
    ("BSD-3-Clause", "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + "\n\n".join(wrapped(t, "") for t in (L._BSD, L._BSD_NAME, L._BSD_END))),
    ("ISC", wrapped(file("ISC")) + CODE),
    ("MIT", wrapped(L._MIT) + CODE),
    ("MIT", "# SPDX-License-Identifier: MIT" + CODE),
    ("LGPL-3.0", "// SPDX-License-Identifier: LGPL-3.0-or-later" + CODE),
    ("PSF-2.0", wrapped(file("PSF-2.0"), "") + "\nmore terms follow here" * 40),
    ("GPL-2.0", wrapped(file("GPL-2.0"), "") + "\n\n" + "when we speak of free software we mean freedom and not price\n" * 300),
    ("LGPL-3.0", wrapped(file("LGPL-3.0"), "") + "\n\n" + "an application is any work that makes use of an interface\n" * 100),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    (None, "You may look at this software but not copy it. All rights reserved by the owner of the software."),
    (None, "See the license for details."),
    (None, "GNU GENERAL PUBLIC LICENSE"),
    (None, "This is a novel about free software and the people who wrote it." + CODE),
]


BSD4 = max((t for n, t in L.TEMPLATES if n == "BSD-4-Clause"), key=len)
MPL1 = 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {0} which is available at https://www.eclipse.org/legal/epl-{0}/"
FOUND += [
    ("GPL-2.0", fsf(GPL, "2") + " " + HOPE + CODE),
    ("GPL-3.0", fsf(GPL, "3", end=":") + " " + HOPE),
    ("GPL-2.0", wrapped(fsf(GPL, "2")) + CODE),
    ("GPL-3.0", wrapped(fsf(GPL, "3", end=":")) + CODE),
    ("BSD-4-Clause", BSD4),
    ("EPL-1.0", EPL.format("1.0")),
    ("EPL-2.0", EPL.format("2.0")),
    (None, EPL.format("3.0")),
    ("MPL-1.1", wrapped(MPL1)),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("LGPL-2.0", "# SPDX-License-Identifier: LGPL-2.0-only"),
    ("BSD-3-Clause-Clear", "// SPDX-License-Identifier: BSD-3-Clause-Clear\nx"),
    ("MIT OR Apache-2.0", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */"),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("EUPL-1.2", "SPDX-License-Identifier: EUPL-1.2"),
    ("GPL-2.0 WITH Linux-syscall-note", "/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */"),
    ("(MIT OR GPL-2.0) AND ISC", "SPDX-License-Identifier: (MIT OR GPL-2.0-or-later) AND ISC"),
    (None, "Licensed under the Apache License, Version 1.1."),
]


@pytest.mark.parametrize("n, factor", [(30, 0), (10_000, 1), (10_000_000, 1000)])
def test_a_licence_does_not_depend_on_the_corpus(n, factor):
    """Each notice as the only one among n documents, whatever the frequencies of its words there."""
    v = L.Vocabulary()
    rng = np.random.default_rng(0)
    common = np.array([0, *(int(rng.integers(0, 9000 if len(w) < 5 else 40)) for w in v.ids)]) * factor
    for df in (common, np.zeros(v.n, np.int64)):
        for name, text in FOUND:
            raw = text.encode()
            runs = L.parts(v, raw)
            best, score = L.cosines(v, L.weights(v, n, df + 1), runs, L.THRESHOLD)
            k = max(range(len(runs)), key=lambda i: (score[i] if best[i] >= 0 else 0, -best[i]))
            assert (L.identified(raw) or (str(v.names[best[k]]) if best[k] >= 0 else None)) == name, text[:80]


def test_the_right_licence_or_none(spark):
    prose = [(1000 + i, f"{i}", "the cat of a house is in the tree and by the river for it or to this with that " * 3) for i in range(200)]
    rows = [(i, f"{i}", t) for i, (_, t) in enumerate(FOUND)] + prose
    got = {r.doc_id: r.own_license for r in L.own_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(FOUND))] == [n for n, _ in FOUND]
    assert all(got[i] is None for i, *_ in prose)


def test_nearest_ancestor(spark):
    rows = [
        (1, "LICENSE", "MIT", 0.9), (2, "a/COPYING.txt", "GPL-3.0", 0.8), (3, "a/LICENSE", "ISC", 0.8), (4, "a/b/c/x.py", None, 0.0), (5, "b/y.py", None, 0.0),
        (6, "a/z.py", "BSD-3-Clause", 0.7), (7, None, None, 0.0), (8, "./a//b/w.py", None, 0.0), (9, "ab/v.py", None, 0.0), (9, "ab/v.py", None, 0.0), (10, "a/b/LICENSE", None, 0.0),
    ]
    got = L.inherit(spark.createDataFrame(rows, "doc_id long, path string, own_license string, own_score double")).collect()
    assert sorted((r.doc_id, r.license, r.how, r.licensed_by, r.from_dir or "") for r in got) == [
        (1, "MIT", "own", 1, ""), (2, "GPL-3.0", "own", 2, ""), (3, "ISC", "own", 3, ""), (4, "GPL-3.0", "inherited", 2, "a"), (5, "MIT", "inherited", 1, ""),
        (6, "BSD-3-Clause", "own", 6, ""), (7, "MIT", "inherited", 1, ""), (8, "GPL-3.0", "inherited", 2, "a"), (9, "MIT", "inherited", 1, ""), (9, "MIT", "inherited", 1, ""), (10, "GPL-3.0", "inherited", 2, "a"),
    ]


def test_query(spark, small):
    rows = [(i, TEXTS[i % len(TEXTS)], "en", f"src{i % 3}" if i % 11 else None, 0) for i in range(200)]
    out = L.op9_license_tfidf(spark, small(documents=(rows, DOCUMENTS))).collect()
    assert len(out) == 200
    want = plain([r[1] for r in rows])
    assert {r.doc_id: r.own_license for r in out} == {i: n for i, (_, n) in enumerate(want)}
    assert {r.how for r in out} >= {"own", "inherited"}
    assert L.op9_license_tfidf(spark, small(documents=([], DOCUMENTS))).count() == 0
