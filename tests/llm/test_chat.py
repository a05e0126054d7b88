import duckdb

from glossa.llm import chat, queries

TURNS = "pair_id long, turn long, role string, text string"


def formatted(spark, chosen, rejected):
    rows = chat.preference_rows(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)).collect()
    return sorted(((r.pair_id, r.part, r.turn, r.role, r.copies, r.rendered[r.trained_from : r.trained_from + r.trained_chars]) for r in rows), key=str)


def test_prefix_once_and_masks(spark):
    common = [(1, 0, "system", "s"), (1, 1, "user", "hi")]
    got = formatted(spark, [*common, (1, 2, "assistant", "good"), (1, 3, "user", "so")], [*common, (1, 2, "assistant", "bad")])
    assert got == [
        (1, "chosen", 2, "assistant", 1, "good<|end|>\n"),
        (1, "chosen", 3, "user", 1, ""),
        (1, "prompt", 0, "system", 1, ""),
        (1, "prompt", 1, "user", 1, ""),
        (1, "rejected", 2, "assistant", 1, "bad<|end|>\n"),
    ]


def test_prefix_ends_at_the_first_difference(spark):
    """Equal turns behind a difference are no prompt."""
    got = formatted(spark, [(1, 0, "user", "a"), (1, 1, "user", "same")], [(1, 0, "user", "b"), (1, 1, "user", "same")])
    assert {g[1] for g in got} == {"chosen", "rejected"} and len(got) == 4


def test_edges(spark):
    side = [(1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (None, 0, "user", "x"), (3, 0, "user", "only")]
    got = formatted(spark, side, side[:4])
    assert (1, "prompt", 0, "assistant", 2, "") in got
    assert (1, "prompt", None, "unknown", 1, "") in got
    assert (None, "prompt", 0, "user", 1, "") in got
    assert (3, "chosen", 0, "user", 1, "") in got
    assert formatted(spark, [], []) == []
    # As many copies on both sides are needed to be common.
    got = formatted(spark, side[1:3], side[1:2])
    assert [(g[1], g[4]) for g in got] == [("chosen", 2), ("rejected", 1)]


def test_contrast(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "r"), (1, 1, "assistant", "a1"), (1, 2, "user", "t"), (2, 0, "user", "z"), (None, 0, "user", "n")]
    chosen, rejected = chat.contrast(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chosen.count() == 6
    assert sorted(tuple(r) for r in rejected.collect()) == [
        (0, 0, "user", "q"), (0, 1, "assistant", "a1"), (1, 0, "user", "r"), (1, 1, "assistant", "a0"), (1, 2, "user", "t"), (2, 0, "user", "z"),
    ]


def test_query_keeps_rows_without_an_id(spark, tmp_path):
    """The query and its SQL agree on null ids."""
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "r"), (1, 1, "assistant", "a1"), (None, 0, "user", "n"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op10_preference(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.PREFERENCE_SQL)
    columns = [c[0] for c in want.description]
    found = [tuple(r) for r in got.select(columns).collect()]
    assert sorted(found, key=str) == sorted(want.fetchall(), key=str)
    assert [(r[columns.index("part")], r[columns.index("copies")]) for r in sorted(found, key=str) if r[columns.index("pair_id")] is None] == [("prompt", 2), ("prompt", 1)]


def test_clashing_columns_and_empty_table(spark):
    """Other columns are ignored, those that bear names of the operator too; no rows give no rows."""
    columns = "conv_id long, turn long, role string, text string"
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "r"), (1, 1, "assistant", "a1"), (None, 0, None, None)]
    plain = spark.createDataFrame(rows, columns)
    clashing = plain.selectExpr("*", "'p' AS pair_id", "'mine' AS part", "'s' AS side", "7 AS copies", "8 AS last", "'r' AS rendered")
    result = lambda df: sorted((tuple(r) for r in chat.preference_rows(*chat.pairs(df)).collect()), key=str)
    assert result(clashing) == result(plain) != []
    assert result(spark.createDataFrame([], columns)) == []
