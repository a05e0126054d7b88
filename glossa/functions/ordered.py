"""Ordered computations that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts every row of a key in one
task.  Here the key is cut into *segments* of its order (time ranges or sequence
ranges): rows are windowed per (key, segment), and what crosses a segment border
comes from a summary with one row per (key, segment).  Only that summary is
windowed per key.  Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "_segment"


def time_segment(ts: Column, seconds: int) -> Column:
    """Segment number of a timestamp for segments of the given length."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def sequence_segment(seq: Column, rows: int) -> Column:
    """Segment number of a dense sequence number."""
    return F.floor(seq / F.lit(rows)).cast("bigint")


def local_window(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, SEGMENT).orderBy(*order)


def join_carry(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], carries: dict[str, Column]
) -> DataFrame:
    """Attach per-segment carries.

    ``aggs`` summarise each (key, segment); ``carries`` are window expressions
    over the summary.  The big side is joined on (key, segment), the same
    partitioning the local windows use, so it is shuffled once.
    """
    summary = df.groupBy(*keys, SEGMENT).agg(*aggs)
    carry = summary.select(*keys, SEGMENT, *[c.alias(n) for n, c in carries.items()])
    return df.join(carry, [*keys, SEGMENT], "left")


def before(keys: Sequence[str]) -> Window:
    """Summary window over all earlier segments of a key."""
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def after(keys: Sequence[str]) -> Window:
    """Summary window over all later segments of a key."""
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(1, Window.unboundedFollowing)


def order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def with_segment(df: DataFrame, segment: Column) -> DataFrame:
    return df.withColumn(SEGMENT, segment)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """``lag(1)`` of some columns in the order of each key."""
    packed = F.struct(*columns)
    df = with_segment(df, segment)
    out = join_carry(
        df,
        keys,
        [F.max_by(packed, order_key(order)).alias("_v")],
        {"_carry": F.lag("_v").over(Window.partitionBy(*keys).orderBy(SEGMENT))},
    ).withColumn(
        "_prev", F.coalesce(F.lag(packed).over(local_window(keys, order)), F.col("_carry"))
    )
    for c in columns:
        out = out.withColumn(prefix + c, F.col(f"_prev.{c}"))
    return out.drop("_prev", "_carry", SEGMENT)


def next_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    columns: Sequence[str],
    prefix: str = "next_",
) -> DataFrame:
    """``lead(1)`` of some columns in the order of each key."""
    packed = F.struct(*columns)
    df = with_segment(df, segment)
    out = join_carry(
        df,
        keys,
        [F.min_by(packed, order_key(order)).alias("_v")],
        {"_carry": F.lead("_v").over(Window.partitionBy(*keys).orderBy(SEGMENT))},
    ).withColumn(
        "_next", F.coalesce(F.lead(packed).over(local_window(keys, order)), F.col("_carry"))
    )
    for c in columns:
        out = out.withColumn(prefix + c, F.col(f"_next.{c}"))
    return out.drop("_next", "_carry", SEGMENT)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums; ``totals`` names whole-key totals of those sums."""
    df = with_segment(df, segment)
    zero = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    carries = {f"_c_{n}": F.coalesce(F.sum(f"_s_{n}").over(before(keys)), F.lit(0)) for n in sums}
    for out_name, n in (totals or {}).items():
        carries[out_name] = F.sum(f"_s_{n}").over(Window.partitionBy(*keys))
    out = join_carry(df, keys, [F.sum(c).alias(f"_s_{n}") for n, c in zero.items()], carries)
    w = local_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n, c in zero.items():
        out = out.withColumn(n, F.sum(c).over(w) + F.col(f"_c_{n}"))
    return out.drop(SEGMENT, *[f"_c_{n}" for n in sums])


def clamped_counters(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, deltas: dict[str, Column]
) -> DataFrame:
    """Counters that never fall below zero, after each row (``name``) and before it (``prev_<name>``).

    Such a counter equals its plain running sum minus the lowest sum so far, when
    that is negative.  A segment is summed up by its total and its lowest sum, so
    one summary and one join serve all counters.
    """
    df = with_segment(df, segment)
    upto = local_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n, c in deltas.items():
        df = df.withColumn(f"_d_{n}", c).withColumn(f"_r_{n}", F.sum(f"_d_{n}").over(upto))
    summary = df.groupBy(*keys, SEGMENT).agg(
        *[F.sum(f"_d_{n}").alias(f"_s_{n}") for n in deltas], *[F.min(f"_r_{n}").alias(f"_l_{n}") for n in deltas]
    )
    for n in deltas:
        summary = summary.withColumn(f"_c_{n}", F.coalesce(F.sum(f"_s_{n}").over(before(keys)), F.lit(0)))
    carry = summary.select(
        *keys,
        SEGMENT,
        *[f"_c_{n}" for n in deltas],
        *[
            F.least(F.lit(0), F.coalesce(F.min(F.col(f"_c_{n}") + F.col(f"_l_{n}")).over(before(keys)), F.lit(0))).alias(f"_m_{n}")
            for n in deltas
        ],
    )
    out = df.join(carry, [*keys, SEGMENT], "left")
    for n in deltas:
        raw = F.col(f"_c_{n}") + F.col(f"_r_{n}")
        out = out.withColumn(f"_a_{n}", raw)
        low = F.least(F.col(f"_m_{n}"), F.min(f"_a_{n}").over(upto))
        out = out.withColumn(n, F.col(f"_a_{n}") - low)
        start = F.col(f"_c_{n}") - F.col(f"_m_{n}")
        out = out.withColumn(f"prev_{n}", F.coalesce(F.lag(n).over(local_window(keys, order)), start))
    return out.drop(SEGMENT, *[f"_{x}_{n}" for n in deltas for x in "drcma"])


def running_extreme(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    value: Column,
    name: str,
    largest: bool,
    inclusive: bool = True,
) -> DataFrame:
    """Running maximum (or minimum) of ``value``; nulls are skipped."""
    fn, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    df = with_segment(df.withColumn("_val", value), segment)
    out = join_carry(
        df, keys, [fn("_val").alias("_v")], {"_carry": fn("_v").over(before(keys))}
    )
    last = Window.currentRow if inclusive else -1
    w = local_window(keys, order).rowsBetween(Window.unboundedPreceding, last)
    return out.withColumn(name, pick(fn("_val").over(w), F.col("_carry"))).drop(
        "_carry", "_val", SEGMENT
    )


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Latest non-null ``value`` up to and including the current row."""
    df = with_segment(df.withColumn("_val", value), segment)
    out = join_carry(
        df,
        keys,
        [F.max_by("_val", F.when(F.col("_val").isNotNull(), order_key(order))).alias("_v")],
        {"_carry": F.last("_v", ignorenulls=True).over(before(keys))},
    )
    w = local_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn(
        name, F.coalesce(F.last("_val", ignorenulls=True).over(w), F.col("_carry"))
    ).drop("_carry", "_val", SEGMENT)
