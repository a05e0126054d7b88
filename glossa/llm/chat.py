"""Preference formatting: shared prompt once, then the two completions with their masks.

A preference pair is two conversations under one pair_id.  Their longest common prefix of
turns is the prompt.  All steps are aggregations by (pair_id, turn) and one join by
pair_id; no conversation is gathered into one row or one task, so a conversation of any
length passes.  A rendered example is the rows of one pair in the order of part and turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = 9223372036854775807
HEAD, BREAK, END = "<|", "|>\n", "<|end|>\n"


def _turns(df: DataFrame, side: str) -> DataFrame:
    return df.select(
        F.col("pair_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(side).alias("side"),
    )


def first_difference(turns: DataFrame) -> DataFrame:
    """(pair_id, split): the first turn at which the two sides differ; no row for equal sides."""
    of = lambda side: F.count_if(F.col("side") == side)
    # The text itself need not be shuffled to be compared: its digest stands for it.
    counted = turns.groupBy("pair_id", "turn", "role", F.sha2("text", 256).alias("print")).agg(
        of("chosen").alias("a"), of("rejected").alias("b")
    )
    return counted.filter("a <> b").groupBy("pair_id").agg(F.min("turn").alias("split"))


def preference_rows(chosen: DataFrame, rejected: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per rendered turn: pair_id, part, turn, role, copies, rendered, trained_from, trained_chars.

    ``chosen`` and ``rejected`` have pair_id, turn, role and text.  ``part`` is ``prompt``
    for the turns before the first difference (rendered once for both sides), else
    ``chosen`` or ``rejected``.  The loss mask is given in characters of ``rendered``:
    ``trained_chars`` characters from ``trained_from`` on count (content and end mark of
    ``trained_role`` turns in the completions); 0 elsewhere.

    Turns are matched by their numbers.  Null turn numbers come last, a null role is
    ``unknown``, a null text is empty.  Repeated rows of a turn are one row with their
    number in ``copies``, and must be as many on both sides to be common.  A pair of equal
    sides is all prompt; a pair with one side only has no prompt.  Rows without a pair_id
    have no partner and are one pair of their own.  Other columns are ignored.
    """
    turns = _turns(chosen, "chosen").unionByName(_turns(rejected, "rejected"))
    # A null pair_id would not join: it travels as a struct, which is never null.
    turns = turns.withColumn("pair_id", F.struct("pair_id"))
    split = first_difference(turns)
    parts = turns.join(split, "pair_id", "left").withColumn(
        "part",
        F.when(F.col("split").isNull() | (F.col("turn") < F.col("split")), "prompt").otherwise(F.col("side")),
    )
    # The prompt is the same on both sides: it is taken from the chosen one.
    once = parts.filter((F.col("part") != "prompt") | (F.col("side") == "chosen"))
    head = F.concat(F.lit(HEAD), F.col("role"), F.lit(BREAK))
    trains = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    rendered = F.concat(head, F.col("text"), F.lit(END))
    return (
        once.groupBy("pair_id", "part", "turn", "role", "text")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select(
            F.col("pair_id.pair_id").alias("pair_id"),
            "part",
            F.nullif("turn", F.lit(LAST)).alias("turn"),
            "role",
            "copies",
            rendered.alias("rendered"),
            F.when(trains, F.length(head)).otherwise(0).cast("long").alias("trained_from"),
            F.when(trains, F.length("text") + len(END)).otherwise(0).cast("long").alias("trained_chars"),
        )
    )


def partner(conv_id: Column) -> Column:
    """2k and 2k + 1 are partners."""
    return conv_id.bitwiseXOR(F.lit(1))


def contrast(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from a table of conversations.

    Chosen is each conversation as it is.  Rejected is the same conversation with the rows
    of its last assistant turn replaced by the last assistant turn of its partner, an
    answer to something else; nothing stands there if the partner has none.  Rows without
    a conv_id are in neither; ``pairs`` has them.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    answers = rows.filter("role = 'assistant' and turn is not null")
    last = answers.groupBy("conv_id").agg(F.max("turn").alias("last"))
    final = answers.join(last, "conv_id").filter("turn = last")
    foreign = final.select(partner(F.col("conv_id")).alias("conv_id"), "role", "text").join(last, "conv_id")
    own = rows.join(last, "conv_id", "left").filter(
        "last is null or not (role <=> 'assistant' and turn <=> last)"
    )
    pair = F.col("conv_id").alias("pair_id")
    rejected = own.select(pair, "turn", "role", "text").unionByName(
        foreign.select(pair, F.col("last").alias("turn"), "role", "text")
    )
    return rows.select(pair, "turn", "role", "text"), rejected


def pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) of ``contrast``, with the rows without a conv_id.

    Those have no answers of their own and no partner, so they are the same on both sides:
    one pair without an id, all prompt. Other columns are ignored; an empty table
    gives no pairs.
    """
    chosen, rejected = contrast(conversations)
    stray = conversations.filter(F.col("conv_id").isNull()).select(
        F.col("conv_id").alias("pair_id"), "turn", "role", "text"
    )
    return chosen.unionByName(stray), rejected.unionByName(stray)
