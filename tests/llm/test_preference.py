import duckdb
import pytest

from quirespark.llm import preference as P

TURNS = "conv_id long, turn long, role string, text string"


def rows_of(folder):
    want = duckdb.sql(P.SQL.replace("from conversations", f"from '{folder}/conversations.parquet/*.parquet'"))
    return [d[0] for d in want.description], sorted(map(str, want.fetchall()))


def test_query_against_sql(spark, small):
    rows = []
    for c in range(40):
        for t in range(c % 5 + 1):
            shared = t <= c // 2 % 4
            rows.append((c, t, ["system", "user", "assistant"][t % 3], f"turn {t}" if shared else f"turn {t} of {c}"))
    rows += [(100, 0, None, None), (101, 0, None, None), (100, 1, "assistant", ""), (100, 1, "assistant", ""), (101, 1, "assistant", "x" * 100_000), (None, 0, "user", "lost"), (7, None, "user", "lost"), (201, 3, "user", "alone"), (-3, 0, "user", "below"), (-4, 0, "user", "below")]
    rows += [(c, t, "assistant", f"{t // (4 - c % 2)}") for c in (300, 301) for t in range(0, 2000, 100)] + [(302, -5, "assistant", "a"), (303, -300, "assistant", "b")]
    where = small(conversations=(rows, TURNS))
    columns, want = rows_of(where)
    got = P.op3_preference_pairs(spark, where)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want
    assert P.op3_preference_pairs(spark, small(conversations=([], TURNS))).count() == 0


def test_pairs(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (2, 0, "user", "hi"), (2, 1, "assistant", "bye"), (3, 0, "user", "hi"), (4, 0, "user", "hi")]
    df = spark.createDataFrame([(*t, "clash", 1) for t in turns], TURNS + ", side string, pair_id int")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 3, 4), (12, 1, 99), (13, 1, 3), (14, None, 1)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in P.paired(df, pairs).collect()}
    assert set(got) == {10, 11, 13}  # a pair with one side has no completions to pair
    a = got[10]
    assert a.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert a.chosen == "<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n" and a.rejected == "<|im_start|>assistant\nbye<|im_end|>\n"
    assert [a.chosen[s.start : s.end] for s in a.chosen_mask] == ["hello<|im_end|>\n"] and [a.rejected[s.start : s.end] for s in a.rejected_mask] == ["bye<|im_end|>\n"]
    assert (got[11].prompt, got[11].chosen, got[11].rejected) == (a.prompt, "", "")
    assert got[13].prompt == a.prompt and got[13].rejected == "" and got[13].chosen == a.chosen


def test_long_conversations_go_on_in_parts(spark, small):
    """Runs of copies over the edges of parts, and a completion much longer than the other."""
    n = P.TURNS
    rows = [(0, t, "user", f"{t}") for t in range(n + 5)] + [(1, t, "user", f"{t}") for t in range(n + 3)] + [(1, n + 3, "assistant", "again")] * (n + 7) + [(0, n + 5, "assistant", "x")]
    where = small(conversations=(rows, TURNS))
    columns, want = rows_of(where)
    got = P.op3_preference_pairs(spark, where)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want
    assert [(r.part, r.parts, r.prompt_turns, bool(r.prompt), bool(r.chosen), bool(r.rejected)) for r in got.orderBy("part").collect()] == [(0, 2, n + 3, True, True, True), (1, 2, n + 3, True, False, True)]


@pytest.mark.parametrize("number", [lambda c, t: 250 + t, lambda c, t: 1_700_000_000 + 3600 * t + 7 * c])
def test_one_prompt_and_two_completions_whatever_the_numbers(spark, number):
    """Turns numbered over round numbers, or by times that differ between the two."""
    rows = [(c, number(c, t), "assistant" if t % 2 else "user", f"turn {t}" + (f" of {c}" if t >= 9 else "")) for c in (4, 5) for t in range(12)]
    got = P.paired(spark.createDataFrame(rows, TURNS), spark.createDataFrame([(2, 4, 5)], "pair_id long, chosen_id long, rejected_id long")).collect()
    assert len(got) == 1 and got[0].prompt_turns == 9 and got[0].prompt.count("<|im_start|>") == 9
    assert got[0].chosen.count("of 4") == got[0].rejected.count("of 5") == 3 and len(got[0].chosen_mask) == 2


def test_three_hundred_turns_are_one_row(spark):
    rows = [(c, t, "assistant", f"{t if t < 290 else c}") for c in (4, 5) for t in range(300)]
    got = P.paired(spark.createDataFrame(rows, TURNS), spark.createDataFrame([(2, 4, 5)], "pair_id long, chosen_id long, rejected_id long")).collect()
    assert [(r.part, r.parts, r.prompt_turns, r.chosen.count("assistant"), len(r.rejected_mask)) for r in got] == [(0, 1, 290, 10, 10)]
