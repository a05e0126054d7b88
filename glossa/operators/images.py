"""Planning of image regions (metadata only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa import limits
from glossa.functions.text import round_half_up


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def plan_image_regions(
    regions: DataFrame,
    max_side: int = limits.MAX_IMAGE_SIDE,
    max_pixels: int = limits.MAX_IMAGE_PIXELS,
    min_side: int = limits.MIN_REGION_SIDE,
) -> DataFrame:
    """Clip to the viewport, crop in bitmap pixels, and scale below side and pixel limits."""
    names = ("left", "top", "width", "height", "viewport_width", "viewport_height")
    finite = F.lit(True)
    for n in names:
        finite = finite & _finite(F.col(n))
    vw, vh = F.col("viewport_width"), F.col("viewport_height")
    zero = F.lit(0.0)
    df = regions.withColumn(
        "_code",
        F.when(~finite, "REGION_NOT_FINITE").when(
            (vw <= 0) | (vh <= 0) | (vw > limits.MAX_VIEWPORT_SIDE) | (vh > limits.MAX_VIEWPORT_SIDE),
            "VIEWPORT_INVALID",
        ),
    )
    left = F.greatest(zero, F.least(vw, F.col("left")))
    top = F.greatest(zero, F.least(vh, F.col("top")))
    df = df.withColumns({"clip_left": left, "clip_top": top})
    df = df.withColumns(
        {
            "clip_width": F.greatest(F.col("clip_left"), F.least(vw, F.col("left") + F.col("width"))) - F.col("clip_left"),
            "clip_height": F.greatest(F.col("clip_top"), F.least(vh, F.col("top") + F.col("height"))) - F.col("clip_top"),
        }
    )
    df = df.withColumn(
        "error_code",
        F.coalesce(
            "_code",
            F.when((F.col("clip_width") < min_side) | (F.col("clip_height") < min_side), "REGION_TOO_SMALL"),
        ),
    )
    sx, sy = F.col("bitmap_width") / vw, F.col("bitmap_height") / vh
    one = F.lit(1).cast("bigint")
    df = df.withColumns(
        {
            "crop_x": F.greatest(F.lit(0).cast("bigint"), round_half_up(F.col("clip_left") * sx)),
            "crop_y": F.greatest(F.lit(0).cast("bigint"), round_half_up(F.col("clip_top") * sy)),
        }
    )
    df = df.withColumns(
        {
            "crop_width": F.least(
                F.col("bitmap_width").cast("bigint") - F.col("crop_x"),
                F.greatest(one, round_half_up(F.col("clip_width") * sx)),
            ),
            "crop_height": F.least(
                F.col("bitmap_height").cast("bigint") - F.col("crop_y"),
                F.greatest(one, round_half_up(F.col("clip_height") * sy)),
            ),
        }
    )
    scale = F.least(
        F.lit(1.0),
        F.lit(float(max_side)) / F.greatest("crop_width", "crop_height"),
        F.sqrt(F.lit(float(max_pixels)) / (F.col("crop_width") * F.col("crop_height"))),
    )
    df = df.withColumn("_scale", scale)
    df = df.withColumns(
        {
            "out_width": F.greatest(one, round_half_up(F.col("crop_width") * F.col("_scale"))),
            "out_height": F.greatest(one, round_half_up(F.col("crop_height") * F.col("_scale"))),
        }
    )
    ok = F.col("error_code").isNull()
    planned = ("clip_left", "clip_top", "clip_width", "clip_height", "crop_x", "crop_y", "crop_width",
               "crop_height", "out_width", "out_height")
    return df.withColumns({c: F.when(ok, F.col(c)) for c in planned}).drop("_code", "_scale")


def region_rejects(planned: DataFrame) -> DataFrame:
    return planned.groupBy("error_code").agg(F.count("*").alias("n_regions"))


def choose_encoding(candidates: DataFrame, max_bytes: int = limits.MAX_IMAGE_BYTES) -> DataFrame:
    """Best quality per region whose encoded size fits, else IMAGE_TOO_LARGE."""
    fits = F.col("n_bytes") <= max_bytes
    return (
        candidates.groupBy("region_id")
        .agg(F.max(F.when(fits, F.struct("quality", "n_bytes"))).alias("_b"))
        .select(
            "region_id",
            F.col("_b.quality").alias("quality"),
            F.col("_b.n_bytes").alias("n_bytes"),
            F.when(F.col("_b").isNull(), "IMAGE_TOO_LARGE").alias("error_code"),
        )
    )
