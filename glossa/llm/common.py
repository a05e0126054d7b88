"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
HOLDER = "_row"


_CACHES: list = []


def worker_cache(build: Callable) -> Callable:
    """``build`` with its last two results kept in the worker for further tasks, until a task calls ``lightened``."""
    cached = lru_cache(maxsize=2)(build)
    _CACHES.append(cached)
    return cached


def lightened() -> None:
    """Frees what tasks of other operators have left in this worker, and Arrow memory that is not in use.

    Workers outlive a stage, so without this the caches of one operator stand beside the work of the next.
    """
    for cached in _CACHES:
        cached.cache_clear()
    pa.default_memory_pool().release_unused()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def held(df: DataFrame, **named: Column) -> DataFrame:
    """``named`` columns beside the whole input row in one struct.

    Input columns whose names an operator uses itself can't clash in this form;
    ``released`` gives the rows back as they came.
    """
    row = F.struct(*[quoted(c) for c in df.columns]).alias(HOLDER)
    return df.select(*[expr.alias(name) for name, expr in named.items()], row)


def released(df: DataFrame) -> DataFrame:
    return df.select(f"{HOLDER}.*")


def sliced(batch, column: str = "text", limit: int = 1_000_000):
    """Parts of an Arrow batch with about ``limit`` bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(batch):
        done = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``at``, the place in the order within ``group`` (from 0), and ``of``, the rows of the group.

    Rows are dealt by ranges of (group, order), so neither a large group nor rows that tie
    land in one task; sums of one number per group and range give the places.  ``group``
    must not be null; ``rows`` should be read from a written table, as they are read twice.
    """
    keys = [F.col(group), *order, F.col("_tie")]
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    # The number of a row counts from 0 in each range and has the range in its upper bits.
    dealt = cut_lineage(
        numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_no", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_no", 33))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        dealt.groupBy(group, "_range")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_no").alias("_first"))
        .select(
            F.col(group).alias("_group"),
            F.col("_range").alias("_of_range"),
            (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_n").over(whole).alias("of"),
        )
    )
    placed = dealt.join(runs, (F.col(group) == F.col("_group")) & (F.col("_range") == F.col("_of_range")))
    return placed.select(*[quoted(c) for c in rows.columns], (F.col("_no") + F.col("_shift")).alias("at"), "of")
