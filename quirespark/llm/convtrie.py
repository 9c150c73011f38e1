"""Operator 13: the trie of conversation prefixes by van Emde Boas recursion.

A trie whose depth is under 2 ** k is cut at half depth into an upper trie and, below each of the prefixes that end at the
cut, a lower forest; these are cut in the same way down to tries of one turn. All tries of one height are worked on
together, in one round of joins and sums, so a trie of depth H takes log2(H) rounds each way:

names() goes down. The prefix of d turns is cut where the tries that hold it begin: with low the lowest bit of d, it is
the prefix of d - low turns, which an earlier round has named, and the block of turns behind it. Its name is the digest of that name
and of the block. No round looks at more than names and blocks, whatever the length of a conversation.

graft() comes back up. In the round of height h all tries of h turns know their totals. Those of 2 h are two of these: what
the forest below a cut prefix sums to is added to this prefix and to those above it in the upper trie, which are read
off the path of one conversation that goes through the prefix.

A node is known by the smallest conversation through it, its owner, and its depth. A conversation that owns
a node owns all nodes below on its path.

Names and turns are known by 128 bits of digests. Conversations alike are one node's members and are counted before they move.

Defined cases: null roles and texts are empty; turns of one number come by the SHA-256 of role and text; rows without conv_id are no
conversation's; remainders of negative ids are negative, as in SQL; repeated rows are turns of their own; no conversation gives no node, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import placed
from .common import cut, table

#: Conversations of a group, whose first one lends its first turns, and the remainder that says how many.
GROUP, SHARED = 100, 6
#: Bytes of decimal ids handed on in one row.
CHUNK = 1 << 16


def digest(*parts: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_key, chars): the turns of each conversation in order, place from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = digest(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select("conv_id", F.col("turn").alias("_turn"), key.alias("turn_key"), F.length(text).cast("long").alias("chars"))
    return placed(rows, ["conv_id"], [F.asc_nulls_first("_turn"), F.col("turn_key")]).drop("_turn")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, size) of turns(), and their turns, when each begins with the first turns of the first conversation of its group.

    How many: the id's CRC-32 modulo SHARED, or all if that has fewer; so many of its own are left out.
    """
    own = cut(own)
    first, lent = F.col("conv_id") - F.col("conv_id") % GROUP, F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    sizes = cut(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))).select("conv_id", "n", lent.alias("lent"), first.alias("first"))
    lenders = sizes.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("first"), F.col("n").alias("has"))
    met = sizes.join(lenders, "first", "left").withColumn("got", F.least("lent", F.coalesce("has", F.lit(0))))
    sizes = met.select("conv_id", (F.col("got") + F.greatest(F.col("n") - F.col("lent"), F.lit(0))).alias("size"))
    heads = own.where(f"conv_id % {GROUP} = 0 and place < {SHARED - 1}").select(F.col("conv_id").alias("first"), "place", "turn_key", "chars")
    borrowed = met.select("conv_id", "first", "got").join(heads, "first").where("place < got").select("conv_id", "place", "turn_key", "chars")
    rest = own.withColumn("lent", lent).where("place >= lent").withColumn("first", first).join(lenders, "first", "left")
    rest = rest.select("conv_id", (F.col("place") - F.col("lent") + F.least("lent", F.coalesce("has", F.lit(0)))).alias("place"), "turn_key", "chars")
    return sizes, borrowed.unionByName(rest)


def blocks(rows: DataFrame, height: int) -> DataFrame:
    """(conv_id, depth, block, chars) for each depth there is: the digest of the turns from the last cut above a depth to it, and the size of its last text."""
    level = F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    at = rows.select("*", level.alias("_j")).where("shiftright(place, _j) % 2 = 0").withColumn("depth", F.expr("shiftleft(shiftright(place, _j) + 1, _j)"))
    last = F.col("place") == F.col("depth") - 1
    halves = (F.bit_xor(F.xxhash64(F.lit(seed), F.col("depth") - F.col("place"), F.col("turn_key"))) for seed in ("low", "high"))
    found = at.groupBy("conv_id", "depth").agg(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in halves)).alias("block"), F.max(F.when(last, F.col("chars"))).alias("chars"))
    return found.where("chars is not null")  # else the conversation ends before this depth


def names(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, name, chars) for each depth of each conversation of rows (conv_id, place, turn_key, chars); equal prefixes have equal names."""
    height = int(rows.agg(F.max("place")).first()[0] or 0).bit_length() + 1
    found = cut(blocks(rows, height))
    named = found.sparkSession.createDataFrame([], "conv_id long, depth long, name binary, chars long")
    for j in reversed(range(height)):
        lower = found.where(f"depth % {2 << j} = {1 << j}").withColumn("_cut", F.col("depth") - (1 << j))
        upper = named.where(f"depth % {2 << j} = 0").select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), F.col("name").alias("_name"))
        met = lower.join(upper, (F.col("conv_id") == F.col("_conv")) & (F.col("_cut") == F.col("_depth")), "left")
        name = digest(F.coalesce(F.hex("_name"), F.lit("root")), F.lit(f"/{j}/"), F.col("block"))
        named = named.unionByName(cut(met.select("conv_id", "depth", name.alias("name"), "chars")))
    return named


def graft(own: DataFrame, paths: DataFrame, height: int, sums: list[str]) -> DataFrame:
    """own (owner, depth, parent, sums) with the sums over the subtree of each node below the root.

    paths: (conv_id, depth, owner), the nodes of each conversation.
    """
    parents = own.select("owner", "depth", "parent")
    total = own.select("owner", "depth", *sums)
    add = [F.sum(c).alias(c) for c in sums]
    for j in range(height):
        # forests of 1 << j turns, by the prefix at the cut above them
        below = parents.where(f"(depth - 1) % {2 << j} = {1 << j}").join(total, ["owner", "depth"])
        forests = below.groupBy("parent", (F.col("depth") - 1).alias("_cut")).agg(*add)
        upper = forests.withColumn("_trie", F.shiftright(F.col("_cut") - 1, j))
        up = paths.withColumn("_trie", F.shiftright(F.col("depth") - 1, j))
        above = upper.join(up, (F.col("parent") == F.col("conv_id")) & (upper["_trie"] == up["_trie"])).select("owner", "depth", *sums)
        total = cut(total.unionByName(above).groupBy("owner", "depth").agg(*add))
    return total


def id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (owner, depth, conv_id) in order, rows (owner, depth, first, ids): ids joined, up to CHUNK bytes a row."""
    held, size, out = [], 0, []

    def done() -> None:
        if held:
            out.append((*held[0], ",".join(str(x[2]) for x in held)))

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("owner", "depth", "conv_id")), strict=True):
            if held and (row[:2] != held[0][:2] or size >= CHUNK):
                done()
                held, size = [], 0
            held.append(row)
            size += 20
        yield chunk_rows(out)
        out.clear()
    done()
    yield chunk_rows(out)


def chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.string(),), strict=True)], names=["owner", "depth", "first", "ids"])


def running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (owner, depth, first, ids) in order, the SHA-256 of the ids of each node; the state goes from row to row."""
    node, state, out = None, None, []
    for b in batches:
        for owner, depth, ids in zip(*(b.column(c).to_pylist() for c in ("owner", "depth", "ids")), strict=True):
            if node == (owner, depth):
                state.update(b"," + ids.encode())
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(ids.encode())
        yield digest_rows(out)
        out.clear()
    yield digest_rows([(*node, state.hexdigest())] if node is not None else [])


def digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["owner", "depth", "ends_sha256"])


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of ends (owner, depth, conv_id).

    A digest over ids in order is one chain; where very many conversations end in one node, the ids come to it
    sorted and joined by the tasks that hold a range of them.
    """
    by = ["owner", "depth", "conv_id"]
    chunks = ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(id_chunks, "owner long, depth long, first long, ids string")
    by = ["owner", "depth", "first"]
    return chunks.repartition("owner", "depth").sortWithinPartitions(*by).mapInArrow(running_digests, "owner long, depth long, ends_sha256 string")


def prefix_trie(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, size) with turns rows (conv_id, place, turn_key, chars), the root being of depth 0."""
    spark = rows.sparkSession
    sizes, rows = cut(sizes), cut(rows)
    root = sizes.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).first()
    sums = ["n_leaves", "saved_tokens"]
    if root.owner is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    named = names(rows)
    nodes = cut(named.groupBy("name", "depth").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")))
    paths = cut(named.join(nodes.select("name", "depth", "owner"), ["name", "depth"]).select("conv_id", "depth", "owner"))
    over = paths.select(F.col("conv_id").alias("_conv"), (F.col("depth") + 1).alias("_depth"), F.col("owner").alias("_above"))
    above = F.when(F.col("depth") == 1, F.lit(root.owner)).otherwise(F.col("_above")).cast("long")
    own = nodes.join(over, (F.col("owner") == F.col("_conv")) & (F.col("depth") == F.col("_depth")), "left").select("owner", "depth", above.alias("parent"), "n_convs", "chars")
    own = cut(own)
    children = own.groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    own = cut(own.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    weighed = own.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    height = int(own.agg(F.max("depth")).first()[0] or 0).bit_length()
    total = graft(weighed, paths, height, sums)
    top = total.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums)).first()
    known = own.select("owner", "depth", "parent", "n_convs", "n_children").join(total, ["owner", "depth"])
    at_root = spark.createDataFrame([(root.owner, 0, None, root.n_convs, top.n_children, top.n_leaves or 1, top.saved_tokens)], "owner long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = sizes.join(paths, (sizes["conv_id"] == paths["conv_id"]) & (sizes["size"] == paths["depth"]), "left")
    ends = ends.select(F.coalesce("owner", F.lit(root.owner)).alias("owner"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), sizes["conv_id"].alias("conv_id"))
    all_ = known.unionByName(at_root).join(digests_of_ends(ends), ["owner", "depth"], "left")
    ended = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return all_.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", *sums, ended)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns(table(spark, sf_dir, "conversations"))))


#: DuckDB SQL for op13_prefix_trie: the nodes are the distinct lists of turns. The CRC-32 is computed bit by bit.
SQL = f"""
with own as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as txt,
        row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as place
    from conversations where conv_id is not null
), conv as (
    select conv_id, n, conv_id - conv_id % {GROUP} as first, xor(list_reduce(list_prepend(4294967295::ubigint, bits), lambda c, b: xor(c >> 1, 3988292384::ubigint * (xor(c, b) & 1))), 4294967295::ubigint) % {SHARED} as lent
    from (select conv_id, n, [(ascii(s[1 + k // 8]) >> (k % 8)::integer & 1)::ubigint for k in range(8 * length(s))] as bits from (select conv_id, conv_id::varchar as s, count(*) as n from own group by conv_id))
), turned as (
    select c.conv_id, o.place as place, role, txt from conv c join own o on o.conv_id = c.first and o.place < c.lent
    union all
    select c.conv_id, o.place - c.lent + least(c.lent, coalesce(b.n, 0)), role, txt
    from conv c join own o on o.conv_id = c.conv_id and o.place >= c.lent left join conv b on b.conv_id = c.first
), seq as (
    select conv_id, coalesce(list({{'r': role, 't': txt}} order by place) filter (where place is not null), []) as s from conv left join turned using (conv_id) group by conv_id
), member as (
    select conv_id, unnest(range(0, len(s) + 1)) as d, s from seq
), node as (
    select d, s[1:d] as p, min(conv_id) as c, count(*) as n, coalesce(string_agg(case when len(s) = d then conv_id::varchar end, ',' order by conv_id), '') as ends from member group by all
), kid as (select d - 1 as d, p[1:d - 1] as p, count(*) as n_children from node where d > 0 group by all),
weighed as (
    select d, p, coalesce(n_children, 0) as n_children, case when n_children is null then 1 else 0 end as leaf, case when d > 0 then (n - 1) * length(p[d].t) else 0 end as saved from node left join kid using (d, p)
), tree as (select k as d, p[1:k] as p, sum(leaf) as n_leaves, sum(saved) as saved_tokens from (select unnest(range(0, d + 1)) as k, p, leaf, saved from weighed) group by all)
select node.c as conv_id, node.d as depth, up.c as parent_conv_id, node.n as n_convs, n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(node.ends) as ends_sha256
from node join weighed using (d, p) join tree using (d, p) left join node up on up.d = node.d - 1 and up.p = node.p[1:node.d - 1]
"""
