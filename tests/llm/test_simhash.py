import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quirespark.llm import components, simhash

from .conftest import DOCUMENTS


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(values, radius=3):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vs = sorted(root)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in vs}


def test_masks_cover_every_pair_within_the_radius():
    m = [x & (2**64 - 1) for x in simhash.masks()]
    assert len(m) == 15
    rng = random.Random(1)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(d & x == 0 for x in m)


def chain(rng, n, flips):
    out = [rng.getrandbits(64)]
    while len(out) < n:
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, flips)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("block", [2048, 8])
def test_components_equal_brute_force(spark, block):
    rng = random.Random(block)
    values = set(chain(rng, 60, 3)) | set(chain(rng, 40, 5)) | {rng.getrandbits(64) for _ in range(100)} | {0, 1, 2**64 - 1}
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components.components(simhash.links(df, block=block)).collect()}
    want = plain_components(values)
    same = {}
    for v in values:
        same.setdefault(got.get(v, v), set()).add(v)
    expected = {}
    for v in values:
        expected.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, expected.values()))


def test_forest_does_not_grow_with_the_pairs():
    fp = np.sort(np.array([(1 << (i % 60)) for i in range(60)] + [0], np.int64))
    a, b = simhash.forest(fp, np.zeros(len(fp), int), 3)
    assert len(a) == len(fp) - 1 and (b < a).all()


def test_query_against_brute_force(spark, small):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "été", "x", "1,2"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "en", "s", 0) for i in range(120)]
    base = " ".join(f"word{i}" for i in range(3000))
    rows += [(200 + i, base.replace(f"word{i * 17} ", "changed "), "en", "s", 0) for i in range(30)]
    rows += [(300, None, None, None, None), (301, "", "", "", 0), (302, " \t\n", "", "", 0), (None, "Solo text here", "", "", 0), (303, "solo TEXT\nhere", "", "", 0), (303, "solo TEXT\nhere", "", "", 0)]
    out = simhash.op6_simhash_covering(spark, small(documents=(rows, DOCUMENTS))).collect()
    assert len(out) == len(rows)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    comp = plain_components(set(fps))
    least = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == sorted((str(i), f"{f:016x}", least[comp[f]]) for (i, *_), f in zip(rows, fps, strict=True))


def test_empty_and_keep_one(spark, small):
    assert simhash.op6_simhash_covering(spark, small(documents=([], DOCUMENTS))).count() == 0
    docs = spark.createDataFrame([(1, "a b c d"), (2, "A b\tc d"), (3, "e f g h"), (None, "a b c d")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {1, 3, None}
