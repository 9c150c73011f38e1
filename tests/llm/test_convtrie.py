import hashlib
import math
import zlib

import pytest

from quirespark.llm import convtrie

CONVERSATIONS = "conv_id long, turn long, role string, text string, owner string, name string, depth int, place long"


def expected(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    seqs = {c: own.get(c - int(math.fmod(c, 100)), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + t[h:] for c, t in own.items()}
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(spark, small, rows):
    folder = small(conversations=([(*r, "x", "y", 1, 2) for r in rows], CONVERSATIONS))
    df = convtrie.op13_prefix_trie(spark, folder)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_the_definition(spark, small):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{'é' * (t % 3)}turn {(c // 7) % 3 if t > 1 else 0}") for c in [*range(0, 12), *range(95, 130), 512, -3, -100] for t in range(c % 9)]
    assert nodes(spark, small, rows) == expected(rows)


def test_nulls_ties_repeated_rows_and_no_turns_left(spark, small):
    rows = [(7, None, "user", "b"), (7, 0, None, "a"), (7, 0, "user", None), (7, 0, "user", "z"), (7, 0, "user", "z"), (8, 3, "", ""), (9, None, None, None), (None, 1, "user", "lost"), (205, 1, "user", "only")]
    assert nodes(spark, small, rows) == expected(rows)


def test_one_long_conversation_and_many_alike(spark, small):
    rows = [(100, t, "user", f"t{t % 5}") for t in range(300)] + [(c, t, "user", f"t{t}") for c in range(101, 161) for t in range(3)] + [(199, t, "user", f"t{t % 5}") for t in range(150)]
    assert nodes(spark, small, rows) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversation_gives_no_node(spark, small, rows):
    assert nodes(spark, small, rows) == set()


def test_ids_of_a_node_are_joined_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "CHUNK", 100)
    ends = spark.range(500).selectExpr("7L as owner", "1L as depth", "id as conv_id").repartition(7)
    want = hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert [tuple(r) for r in convtrie.digests_of_ends(ends).collect()] == [(7, 1, want)]
