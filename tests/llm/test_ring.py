import zlib
from collections import Counter

from quirespark.llm import ring

from .conftest import DOCUMENTS


def sequential(keys, nodes, caps):
    """The definition: one key after the other, in ring order, to the first node at or after it whose shard is not full."""
    used, out = Counter(), []
    for pos in sorted(keys):
        start = next((i for i, (p, _) in enumerate(nodes) if p >= pos), 0)
        s = next(nodes[(start + j) % len(nodes)][1] for j in range(len(nodes)) if used[nodes[(start + j) % len(nodes)][1]] < caps[nodes[(start + j) % len(nodes)][1]])
        used[s] += 1
        out.append((pos, s))
    return Counter(out)


def test_walk_is_the_sequential_definition():
    nodes = sorted(((i * 37) % 101, i % 5) for i in range(20))
    counts = [(p, q, (p * 7 + q) % 4) for p in range(0, 101, 3) for q in range(2)]
    keys = [p for p, _, n in counts for _ in range(n)]
    caps = ring.capacities(len(keys), 5, 0)
    got = Counter()
    for pos, _, a, b, s, _ in ring.walk(counts, nodes, caps):
        got[pos, s] += b - a
    assert got == sequential(keys, nodes, caps)
    assert max(caps) - min(caps) <= 1 and sum(caps) == len(keys)


def test_query(spark, small):
    rows = [(i, f"text {i}" if i % 3 else None, "en", "s", 0) for i in range(500)] + [(None, "", None, None, None)] * 3 + [(7, "é", "x", "y", 1)] * 400
    out = ring.op2_bounded_ring(spark, small(documents=(rows, DOCUMENTS))).collect()
    assert len(out) == len(rows)
    n = Counter(r.shard for r in out)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
    by = Counter((r.doc_id, r["size"], r.text_crc32) for r in out)
    assert by == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert all(r.law == "rows" and r.grown_shard is None for r in out)


def test_few_keys_move_when_a_shard_is_added(spark):
    keys = spark.range(4000)
    a = {r.id: r.shard for r in ring.assign(keys, "id", 10, slack=0.25).collect()}
    b = {r.id: r.shard for r in ring.assign(keys, "id", 11, slack=0.25).collect()}
    assert max(Counter(a.values()).values()) <= 500
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(a)


def test_empty(spark, small):
    assert ring.op2_bounded_ring(spark, small(documents=([], DOCUMENTS))).count() == 0


def test_query_places_rows_as_the_definition_does(spark, small):
    """Rows in ring order, one after the other, each to the first shard clockwise that is not full."""
    rows = [(i * 37, f"text {i}", "en", "s", 0) for i in range(400)] + [(5, "hot", "x", "y", 1)] * 150
    where = small(documents=(rows, DOCUMENTS))
    docs = spark.read.parquet(f"{where}/documents.parquet")
    nodes, cells = ring.ring(spark, 40, 64, 16384), 16384
    keys = sorted(r.pos for r in docs.select(ring.position(docs.doc_id, cells).alias("pos")).collect())
    caps = ring.capacities(len(rows), 40, 0.0)
    used, want = [0] * 40, Counter()
    for pos in keys:
        first = next((i for i, (p, _) in enumerate(nodes) if p >= pos), 0)
        shard = next(nodes[(first + k) % len(nodes)][1] for k in range(len(nodes)) if used[nodes[(first + k) % len(nodes)][1]] < caps[nodes[(first + k) % len(nodes)][1]])
        used[shard] += 1
        want[pos, shard] += 1
    out = ring.op2_bounded_ring(spark, where)
    assert Counter((r.pos, r.shard) for r in out.select(ring.position(out.doc_id, cells).alias("pos"), "shard").collect()) == want


def test_own_columns_of_these_names(spark):
    out = ring.assign(spark.range(50).selectExpr("id", "'mine' as shard", "id as slot", "1 as `a.b`"), "id", 4)
    assert out.columns == ["id", "a.b", "shard", "slot"] and {r.shard for r in out.collect()} == set(range(4))
