"""Positioned text runs: reading, and a fixture derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.schemas import TEXT_ITEMS


def read_text_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEXT_ITEMS).parquet(path)


def items_from_documents(documents: DataFrame) -> DataFrame:
    """Deterministic glyph runs: even documents in one column, odd ones in two.

    Pages are 612 x 792 with 48 rows of height 14 from y = 60 per column; a run
    holds up to 90 (one column) or 44 characters, 5 units wide each.
    """
    odd = F.col("doc_id") % 2 == 1
    pieces = F.flatten(
        F.transform(
            F.split("text", "\n"),
            lambda line: F.when(odd, F.regexp_extract_all(line, F.lit(".{1,44}"), F.lit(0))).otherwise(
                F.regexp_extract_all(line, F.lit(".{1,90}"), F.lit(0))
            ),
        )
    )
    k = F.col("item_ix")
    per_page = F.when(odd, 96).otherwise(48)
    cut = documents.select("doc_id", odd.alias("_odd"), F.posexplode(pieces).alias("item_ix", "str"))
    per_page = F.when(F.col("_odd"), 96).otherwise(48)
    place = k % per_page
    x = F.when(F.col("_odd") & (place >= 48), 324.0).otherwise(60.0)
    top = F.lit(60.0) + (place % 48) * 14
    return cut.select(
        "doc_id",
        (F.floor(k / per_page) + 1).cast("int").alias("page_no"),
        "item_ix",
        "str",
        F.lit("ltr").alias("dir"),
        F.lit("F1").alias("font_name"),
        F.lit(False).alias("has_eol"),
        (F.length("str") * 5).cast("double").alias("width"),
        F.lit(10.0).alias("height"),
        F.array(
            F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), x, F.lit(792.0) - (top + 8)
        ).alias("transform"),
    )


def views_from_items(items: DataFrame) -> DataFrame:
    """Page frames of the fixture: one 612 x 792 frame per page."""
    return items.select("doc_id", "page_no").distinct().select(
        "doc_id",
        "page_no",
        F.lit(612.0).alias("width"),
        F.lit(792.0).alias("height"),
        F.lit(0).alias("rotation"),
        F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 792.0)]).alias("transform"),
    )


def styles_from_documents(documents: DataFrame) -> DataFrame:
    """One font per document; some bold, some italic."""
    return documents.select(
        "doc_id",
        F.lit("F1").alias("font_name"),
        F.lit(0.8).alias("ascent"),
        F.lit(-0.2).alias("descent"),
        F.lit("Serif").alias("family"),
        F.when(F.col("doc_id") % 7 == 0, "bold").otherwise("normal").alias("weight"),
        F.when(F.col("doc_id") % 11 == 0, "oblique").otherwise("normal").alias("style"),
    )


def turned_margin_notes(items: DataFrame) -> DataFrame:
    """Fixture variant: the last run of every twelfth row stands upright beside the text."""
    lift = (F.col("item_ix") % 12 == 11) & (F.length("str") <= 88)
    m = F.col("transform")
    turned = F.array(
        F.lit(0.0), F.lit(10.0), F.lit(-10.0), F.lit(0.0), F.lit(480.0), F.get(m, F.lit(5)) - 20
    )
    return items.withColumn("transform", F.when(lift, turned).otherwise(m))
