"""Operator 3: preference formatting of pairs of conversations.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is
rendered once as the prompt, the rest of each as a completion, with a mask that is 1 on
the assistant's words and the end of its turn (they count for the loss) and 0 elsewhere.

A turn is known by its rank in its conversation, not by its number: numbers may be times, and differ between the two. places()
ranks the digests of turns by ranges, so a conversation may be spread over any number of tasks; compared() sets the digests of one rank side by
side and takes the least rank at which they differ, with partial aggregates. The texts follow: equal ones of a turn are counted and
joined with their places, and those of the rejected side's half of the prompt are left out. So texts are dealt out
twice, for the count and to be put together.

paired() gives a row for each pair: prompt and two completions. Where a prompt or completion has more than TURNS turns, the
row goes on in further parts: part k has the turns from k * TURNS on of the prompt and of both completions. Every part has the
number of parts and of the prompt's turns.

Defined cases: turns are in order of `turn`, turns of one number in order of the MD5 of role and
text, each copy being a turn of its own; a prompt is as long as role and text agree, whatever the numbers; null roles and texts are equal to each other and
render as empty; turns without number or conversation are left out; a pair one side of which
is null or has no turns is left out; where one conversation begins the other its completion
is empty, and where they are alike throughout both are; roles that no template knows
render like others; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import placed
from .common import bounded, cut, table

#: Turns of a prompt or completion in one row.
TURNS = 1024
SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Template:
    """What stands before a turn's role, between role and text, and after the text; the roles that are learned."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)


def own_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, role, text)."""
    mark = F.concat(F.coalesce(F.concat(F.lit("r"), "role"), F.lit("n")), F.lit("\x01"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n")))
    return turns.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.md5(mark.cast("binary")).alias("digest"), "role", "text")


def by_side(pairs: DataFrame) -> DataFrame:
    """(conv_id, pair_id, side) of pairs (pair_id, chosen_id, rejected_id) with both sides."""
    side = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("rejected_id").alias("conv_id"))))
    return pairs.where("chosen_id is not null and rejected_id is not null").select("pair_id", side.alias("_s")).select("_s.conv_id", "pair_id", "_s.side")


def places(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, place, n): the rank of the first copy of each turn in its conversation, from 0, and its copies."""
    ranked = placed(own_turns(turns).select("conv_id", "turn", F.unhex("digest").alias("digest")), ["conv_id"], [F.col("turn"), F.col("digest")])
    return ranked.groupBy("conv_id", "turn", "digest").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))


def compared(sided: DataFrame) -> DataFrame:
    """(pair_id, common, parts) of sided (pair_id, side, digest, place, n), for the pairs of which both sides have turns: how many turns they have in common, and parts in all."""
    each = F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("place")
    ranks = sided.select("pair_id", "side", "digest", each)
    both = ranks.groupBy("pair_id", "place").agg(*(F.max(F.when(F.col("side") == s, F.col("digest"))).alias(s[0]) for s in ("chosen", "rejected")))
    ends = both.groupBy("pair_id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("place"))).alias("_first"), F.count("c").alias("_c"), F.count("r").alias("_r"))
    common = F.coalesce("_first", "_c")
    longest = F.greatest(common, F.col("_c") - common, F.col("_r") - common)
    return ends.where("_c > 0 and _r > 0").select("pair_id", common.alias("common"), F.ceil(longest / TURNS).cast("int").alias("parts"))


def segments(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, parts, common, segment, part, at, n, role, text): the turns of each segment (prompt, chosen, rejected) and part, at so many places behind its beginning, n copies one after the other."""
    ranked = cut(places(turns))
    sided = ranked.join(by_side(pairs), "conv_id")
    ends = cut(compared(sided))
    run = F.struct(F.col("place").alias("start"), (F.col("place") + F.col("n")).alias("end"))
    split = F.array(
        F.struct(F.lit("prompt").alias("segment"), F.lit(0).cast("long").alias("base"), F.col("run.start").alias("start"), F.least("run.end", "common").alias("end")),
        F.struct(F.col("side").alias("segment"), F.col("common").alias("base"), F.greatest("run.start", "common").alias("start"), F.col("run.end").alias("end")),
    )
    own = sided.join(bounded(ends), "pair_id").withColumn("run", run).select("conv_id", "turn", "digest", "pair_id", "parts", "common", "side", F.explode(split).alias("s"))
    own = own.where("s.start < s.end and not (s.segment = 'prompt' and side = 'rejected')")
    texts = own_turns(turns).withColumn("digest", F.unhex("digest")).groupBy("conv_id", "turn", "digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    met = texts.join(own, ["conv_id", "turn", "digest"])
    start, end = F.col("s.start") - F.col("s.base"), F.col("s.end") - F.col("s.base")
    part = F.explode(F.sequence(F.floor(start / TURNS), F.floor((end - 1) / TURNS))).alias("part")
    each = met.select("pair_id", "parts", "common", F.col("s.segment").alias("segment"), part, start.alias("_start"), end.alias("_end"), "role", "text")
    at = F.greatest("_start", F.col("part") * TURNS)
    return each.withColumns({"at": at, "n": (F.least("_end", (F.col("part") + 1) * TURNS) - at).cast("int"), "part": F.col("part").cast("int")}).drop("_start", "_end")


def paired(turns: DataFrame, pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """(pair_id, part, parts, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) of pairs (pair_id, chosen_id, rejected_id).

    The masks are the spans (start, end) of characters of the completion that count.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(template.before), role, F.lit(template.between))
    learned = (F.col("segment") != "prompt") & role.isin(*template.learned)
    piece = F.struct("at", "n", head.alias("head"), F.concat(text, F.lit(template.after)).alias("body"), learned.alias("learned"))
    own = segments(turns, pairs).select("pair_id", "part", "parts", "common", "segment", piece.alias("p"))
    found = own.groupBy("pair_id", "part", "parts", "common").agg(*(F.array_sort(F.collect_list(F.when(F.col("segment") == s, F.col("p")))).alias(s) for s in ("prompt", "chosen", "rejected")))

    def whole(part: str) -> Column:
        return F.array_join(F.transform(part, lambda p: F.repeat(F.concat(p["head"], p["body"]), p["n"])), "")

    def spans(part: str) -> Column:
        each = F.flatten(F.transform(part, lambda p: F.array_repeat(p, p["n"])))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

        def step(a: Column, p: Column) -> Column:
            words = a["at"] + F.length(p["head"])
            end = words + F.length(p["body"])
            return F.struct(end.alias("at"), F.when(p["learned"], F.concat(a["out"], F.array(F.struct(words.alias("start"), end.alias("end"))))).otherwise(a["out"]).alias("out"))

        return F.aggregate(each, start, step, lambda a: a["out"])

    shown = [whole("prompt").alias("prompt"), *(c for s in ("chosen", "rejected") for c in (whole(s).alias(s), spans(s).alias(f"{s}_mask")))]
    return found.select("pair_id", "part", "parts", F.col("common").alias("prompt_turns"), *shown)


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs for a table of conversations without preferences: those whose ids differ in the last bit only, the even one being chosen."""
    own = turns.where("conv_id is not null").select(F.shiftright("conv_id", 1).alias("pair_id"), "conv_id")
    sides = (F.max(F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(F.col("conv_id") % 2 != 0, F.col("conv_id"))).alias("rejected_id"))
    return own.groupBy("pair_id").agg(*sides)


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = paired(turns, cut(neighbours(turns)))
    masks = {f"{s}_mask": F.array_join(F.transform(f"{s}_mask", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",") for s in ("chosen", "rejected")}
    return found.withColumns(masks)


#: DuckDB SQL for op3_preference_pairs; a mask is its spans as text.
SQL = f"""
with t as (
    select conv_id, role, text, md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')) as d, (conv_id - (conv_id % 2 + 2) % 2) // 2 as pair_id, (conv_id % 2 + 2) % 2 as side,
        row_number() over (partition by conv_id order by turn, d) - 1 as place
    from conversations where conv_id is not null and turn is not null
), sides as (select pair_id, place, max(d) filter (side = 0) as c, max(d) filter (side = 1) as r from t group by all),
ends as (select pair_id, coalesce(min(place) filter (c is distinct from r), count(c)) as common, count(c) as nc, count(r) as nr from sides group by pair_id having count(c) > 0 and count(r) > 0),
p as (
    select t.*, common, ceil(greatest(common, nc - common, nr - common) / {TURNS})::int as parts, case when place < common then 'prompt' when side = 0 then 'chosen' else 'rejected' end as segment,
        place - case when place < common then 0 else common end as k, '<|im_start|>' || coalesce(role, '') || chr(10) as head, coalesce(text, '') || '<|im_end|>' || chr(10) as body
    from t join ends using (pair_id)
), s as (
    select *, (k // {TURNS})::int as part, segment <> 'prompt' and coalesce(role, '') = 'assistant' as learned,
        sum(length(head) + length(body)) over (partition by pair_id, segment, side, k // {TURNS} order by k) as stop
    from p where not (segment = 'prompt' and side = 1)
)
select pair_id, part, parts, common as prompt_turns,
    coalesce(string_agg(head || body, '' order by k) filter (segment = 'prompt'), '') as prompt,
    coalesce(string_agg(head || body, '' order by k) filter (segment = 'chosen'), '') as chosen,
    coalesce(string_agg((stop - length(body)) || '-' || stop, ',' order by k) filter (segment = 'chosen' and learned), '') as chosen_mask,
    coalesce(string_agg(head || body, '' order by k) filter (segment = 'rejected'), '') as rejected,
    coalesce(string_agg((stop - length(body)) || '-' || stop, ',' order by k) filter (segment = 'rejected' and learned), '') as rejected_mask
from s group by pair_id, part, parts, common
"""
