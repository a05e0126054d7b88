"""Exact dedup with a heavy-hitter split.

1. A Misra-Gries summary (Spark's mergeable frequent-items sketch, of fixed size in
   every task) names at most ``candidates`` digests that may be frequent.
2. An exact recount of those few digests verifies them: the winners, with the smallest
   id and the number of copies of each.
3. The winners (at most ``candidates`` rows, so the bound of the broadcast is proven)
   go to all tasks; copies of a frequent text are settled on the map side and never
   shuffled, also where rows repeat the id that stays.
4. All other digests, none of them frequent, go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import SPACE, held, quoted, released
from glossa.session import cut_lineage

CANDIDATES = 512
TRACKED = 4096
FAN_IN = 64


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def frequent(prints: DataFrame, candidates: int = CANDIDATES, tracked: int = TRACKED) -> DataFrame:
    """Digests that may be frequent, at most ``candidates`` rows.

    Task summaries are merged in two levels, so that no task merges those of all partitions.
    """
    parts = (
        prints.groupBy(F.floor(F.spark_partition_id() / FAN_IN).alias("part"))
        .agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("summary"))
        # A key that every row has: without one, the sketch fails on tasks that have no rows.
        .groupBy(F.least("part", F.lit(-1)).alias("root"))
        .agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
    )
    return parts.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {candidates})")).alias("top")).select(
        F.col("top.item").alias("digest")
    )


def winners(prints: DataFrame, candidates: int = CANDIDATES, tracked: int = TRACKED) -> DataFrame:
    """(digest, keep_id, group_size) of the frequent digests, counted exactly."""
    named = F.broadcast(frequent(prints, candidates, tracked))
    return (
        prints.join(named, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )


def _marked(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` with heavy_id and the other columns of the frequent digests, null for all other digests."""
    named = {"keep_id": "heavy_id", "group_size": "heavy_size"}
    return rows.join(F.broadcast(heavy.withColumnsRenamed(named)), "digest", "left")


def _has_kept_id() -> Column:
    """Whether a row of a frequent digest has the id that stays; rows that repeat it have it too."""
    return F.col("heavy_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("heavy_id"))


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows of the other digests with keep_id, group_size and their place in their group."""
    group = Window.partitionBy("digest")
    return rows.withColumns(
        {
            "keep_id": F.min("doc_id").over(group),
            "group_size": F.count(F.lit(1)).over(group),
            "place": F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())),
        }
    )


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: int = CANDIDATES, tracked: int = TRACKED
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Of the rows with equal texts exactly one is kept, one with the smallest id; rows that
    repeat id and text count as copies of each other.  Null ids come last: ``keep_id`` is
    null only where a whole group has none.  Null texts are empty texts.  Other columns are
    ignored; an empty table gives no rows.
    """
    named = docs.select(quoted(id_col).alias("doc_id"), digest(quoted(text_col)).alias("digest"))
    prints = cut_lineage(named.withColumn("no", F.monotonically_increasing_id()))
    heavy = cut_lineage(winners(prints, candidates, tracked))
    # Rows may repeat the id that stays; the one with the smallest number is kept.
    first = _marked(prints, heavy).filter(_has_kept_id()).groupBy("digest").agg(F.min("no").alias("heavy_no"))
    marked = _marked(prints, heavy.join(first, "digest"))
    settled = marked.filter("heavy_size IS NOT NULL").select(
        "doc_id",
        F.col("heavy_id").alias("keep_id"),
        F.col("heavy_size").alias("group_size"),
        (F.col("no") == F.col("heavy_no")).alias("kept"),
        "digest",
    )
    rest = _shuffled(marked.filter("heavy_size IS NULL").select("doc_id", "digest")).withColumn("kept", F.col("place") == 1)
    return settled.unionByName(rest.drop("place")).withColumnRenamed("digest", "text_sha256")


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", candidates: int = CANDIDATES, tracked: int = TRACKED
) -> DataFrame:
    """The kept rows of ``mark_copies``, whole and with the columns as they came.

    Whole rows are shuffled once, and copies of frequent texts not at all, but for one row
    per task and text.  Of rows that repeat an id and a text any one is kept.
    """
    named = {"doc_id": quoted(id_col), "digest": digest(quoted(text_col))}
    prints = cut_lineage(docs.select(*[expr.alias(name) for name, expr in named.items()]))
    marked = _marked(held(docs, **named), winners(prints, candidates, tracked))
    # Rows that repeat the id that stays are reduced to one per task before the shuffle.
    settled = marked.filter(_has_kept_id()).groupBy("digest").agg(F.first("_row").alias("_row")).select("_row")
    rest = _shuffled(marked.filter("heavy_size IS NULL").select("doc_id", "digest", "_row")).filter("place = 1").select("_row")
    return released(settled.unionByName(rest))
