import hashlib
from collections import Counter

import numpy as np
import pytest

from quirespark.llm import repeats
from quirespark.llm.suffixes import common_prefixes, suffix_array

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, copies int, first long"
N = repeats.LENGTH


def expected(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + N] for t in raw for i in range(len(t) - N + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - N + 1):
            if count[t[i : i + N]] > 1:
                gone[i : i + N] = 1
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return "".join(rng.choice(list("abcdefgh éß\n"), n))


def corpus():
    rng = np.random.default_rng(5)
    shared, exact, edge = prose(rng, 700), prose(rng, N - 10), prose(rng, N)
    texts = [prose(rng, 2000) for _ in range(12)]
    texts += [prose(rng, 300) + shared + prose(rng, 300) for _ in range(9)]
    texts += [texts[0], texts[0], texts[1][:900] + "X" + texts[1][901:], shared[150:] + texts[2][: N + 40]]
    texts += [prose(rng, 50) + exact + prose(rng, 50) for _ in range(3)] + [edge + "1", "2" + edge, edge.encode()[: N - 1].decode(errors="ignore")]
    texts += ["a" * 1000, "b" * N, "c" * (N + 1), "ab" * 600, prose(rng, 500) * 3, None, "", "short", "short", "same" * 120, "same" * 120]
    return texts


def found(spark, small, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    folder = small(documents=([(i, t, "l", "s", 0, "k", 1, 2) for i, t in zip(ids, texts, strict=True)], DOCUMENTS))
    df = repeats.op12_repeated_bytes(spark, folder)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return [tuple(r) for r in df.collect()]


def test_equals_the_definition(spark, small):
    texts = corpus()
    assert sorted(found(spark, small, texts)) == [(i, *r) for i, r in enumerate(expected(texts))]


def test_null_and_repeated_ids(spark, small):
    texts = ["a" * 500, "b" * 500, "b" * 500, None]
    ids = [None, 1, 1, None]
    assert sorted(map(str, found(spark, small, texts, ids))) == sorted(map(str, ((i, *r) for i, r in zip(ids, expected(texts), strict=True))))


def test_no_documents(spark, small):
    assert found(spark, small, []) == []


@pytest.mark.parametrize("most", [1, 4])
def test_anchors_with_many_stretches_are_cut_finer(spark, most):
    """With a stretch or four allowed for an anchor all levels of parts are gone through; the spans are the same."""
    texts = corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {bytes(r.text_key): (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removals(docs, most).collect()}
    want = {hashlib.sha256(t.encode()).digest()[:16]: r[1:] for t, r in zip(texts, expected(texts), strict=True) if t and r[1]}
    assert got == want


def test_a_passage_between_many_different_words(spark, small):
    rng = np.random.default_rng(6)
    passage = prose(rng, 520)
    texts = [prose(rng, 200) + passage + prose(rng, 200) for _ in range(3 * repeats.MOST)]
    assert sorted(found(spark, small, texts)) == [(i, *r) for i, r in enumerate(expected(texts))]


def test_stretches_over_pieces(monkeypatch):
    """Cut at any place, the strings of a text are in one stretch each, with the anchor of their bytes."""
    rng = np.random.default_rng(7)
    data = np.frombuffer(prose(rng, 3000).encode(), np.uint8)
    valid = np.ones(len(data), bool)
    valid[-N + 1 :] = False
    whole = repeats.stretches(data, valid)
    monkeypatch.setattr(repeats, "STARTS", 517)
    parts = repeats.stretches(data, valid)
    by_start = [{s + k: (s + a, h) for s, n, a, h in zip(*x, strict=True) for k in range(n)} for x in (whole, parts)]
    assert by_start[0] == by_start[1] and sorted(by_start[0]) == list(range(len(data) - N + 1))


def around(rng, ahead, left, anchor, right, n):
    """A stretch (n, ahead, bytes) of n strings with the anchor `ahead` bytes behind the first; it ends in left before the anchor, and goes on with right behind it."""
    size = n + N - 1
    data = rng.bytes(ahead - len(left)) + left + anchor + right
    return n, ahead, (data + rng.bytes(max(0, size - len(data))))[:size]


def test_only_strings_that_may_repeat_come_to_a_shard():
    """An anchor and some bytes around it are not enough; whatever repeats is kept, and little besides."""
    rng = np.random.default_rng(8)
    anchor = rng.bytes(repeats.GRAM)
    far = [(1, 2, 1, *around(rng, 300, b"", anchor, b"", 250)) for _ in range(3)]
    left, right = rng.bytes(150), rng.bytes(150)
    near = [(1, 2, 1, *around(rng, 300, left, anchor, right, 250)) for _ in range(3)]
    assert repeats.met_again(far) == repeats.met_again(near) == []
    for trial in range(60):
        left, right = (rng.bytes(int(k)) for k in rng.integers(0, 330, 2))
        held = []
        for _ in range(4):
            ahead = int(rng.integers(0, N - repeats.GRAM + 1))
            held.append((1, 2, 1, *around(rng, ahead, left[max(0, len(left) - ahead) :], anchor, right, int(rng.integers(1, ahead + 2)))))
        count = Counter(data[i : i + N] for *_, n, _, data in held for i in range(n))
        want = {(k, i) for k, (*_, n, _, data) in enumerate(held) for i in range(n) if count[data[i : i + N]] > 1}
        runs = repeats.met_again(held)
        kept = [(k, i) for k, first, end in runs for i in range(first, end)]
        assert len(kept) == len(set(kept)) and want <= set(kept), trial
        assert all(0 <= first < end <= held[k][3] for k, first, end in runs)
        assert len(kept) <= len(want) + 2 * repeats.PART * len(held)


def test_a_string_that_only_meets_the_gap_of_two_stretches():
    """Stretches are joined by a zero byte; a text with that byte may hold what is left and right of it, which is no string of a text."""
    rng = np.random.default_rng(9)
    a, b = (bytes(rng.integers(1, 256, 450).astype(np.uint8)) for _ in range(2))
    held = [a, b, a[-250:] + b"\0" + b[:250], a[:N] + b"!"]
    begins = [x for h in held for x in [True] * (len(h) - N + 1) + [False] * N][:-1]
    got = repeats.repeats_in(np.frombuffer(b"\0".join(held), np.uint8), np.array(begins))
    assert got.tolist() == [0, sum(len(h) + 1 for h in held[:3])]


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(200):
        n, k = int(rng.integers(1, 80)), int(rng.integers(1, 5))
        t = rng.integers(0, k, n).astype(np.uint8)
        if trial % 3 == 0:
            t = np.resize(t[: 1 + trial % 9], n).astype(np.uint8)
        b = t.tobytes()
        order = sorted(range(n), key=lambda i: b[i:])
        sa = suffix_array(t)
        assert sa.tolist() == order
        phi, length = common_prefixes(t, sa)
        for before, i in zip([-1, *order], order, strict=False):
            same = next(e for e in range(n + 1) if before < 0 or max(i, before) + e == n or b[i + e] != b[before + e])
            assert (phi[i], length[i]) == (before, same)


def test_suffix_array_of_many_names():
    """Names of more than a byte, sorted in shared buckets."""
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 256, 6).astype(np.uint8).tobytes() for _ in range(3000)]
    b = b"".join(words[i] for i in rng.integers(0, 3000, 8000)) * 2
    sa = suffix_array(np.frombuffer(b, np.uint8))
    assert sorted(sa.tolist()) == list(range(len(b)))
    assert all(b[i:] < b[j:] for i, j in zip(sa[:-1:7], sa[1::7], strict=False))
