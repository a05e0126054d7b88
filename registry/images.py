"""Image-region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa import limits
from glossa.operators import images as G
from glossa.plans import bindings
from registry.common import table

QUERIES = {}
ORACLES = {}


def _planned(spark, d):
    return G.plan_image_regions(bindings.regions_from_lineitem(table(spark, d, "lineitem")))


QUERIES["plan_image_regions"] = lambda spark, d: _planned(spark, d).select(
    "region_id", "error_code", "crop_x", "crop_y", "crop_width", "crop_height", "out_width", "out_height"
)
SQL = """r AS (SELECT l_orderkey * 10 + l_linenumber AS region_id, l_quantity * 20 AS l, l_discount * 5000 AS t,
    l_extendedprice / 50 AS w, l_tax * 10000 AS h FROM lineitem),
c AS (SELECT region_id, greatest(0.0::DOUBLE, least(1280.0::DOUBLE, l)) AS cl, greatest(0.0::DOUBLE, least(800.0::DOUBLE, t)) AS ct,
    least(1280.0::DOUBLE, l + w) AS cr, least(800.0::DOUBLE, t + h) AS cb FROM r),
d AS (SELECT region_id, cl, ct, greatest(cl, cr) - cl AS cw, greatest(ct, cb) - ct AS ch FROM c),
e AS (SELECT *, CASE WHEN cw < 12 OR ch < 12 THEN 'REGION_TOO_SMALL' END AS error_code,
    CAST(floor(cl * 2 + 0.5) AS BIGINT) AS px, CAST(floor(ct * 2 + 0.5) AS BIGINT) AS py FROM d),
f AS (SELECT *, least(2560 - px, greatest(1, CAST(floor(cw * 2 + 0.5) AS BIGINT))) AS pw,
    least(1600 - py, greatest(1, CAST(floor(ch * 2 + 0.5) AS BIGINT))) AS ph FROM e),
g AS (SELECT *, CASE WHEN error_code IS NULL THEN least(1.0::DOUBLE, 2048.0::DOUBLE / greatest(pw, ph), sqrt(3200000.0::DOUBLE / (pw * ph))) END AS s FROM f)"""
ORACLES["plan_image_regions"] = f"""WITH {SQL} SELECT region_id, error_code,
  CASE WHEN s IS NOT NULL THEN px END AS crop_x, CASE WHEN s IS NOT NULL THEN py END AS crop_y,
  CASE WHEN s IS NOT NULL THEN pw END AS crop_width, CASE WHEN s IS NOT NULL THEN ph END AS crop_height,
  greatest(1, CAST(floor(pw * s + 0.5) AS BIGINT)) + CASE WHEN s IS NULL THEN NULL ELSE 0 END AS out_width,
  greatest(1, CAST(floor(ph * s + 0.5) AS BIGINT)) + CASE WHEN s IS NULL THEN NULL ELSE 0 END AS out_height FROM g"""
QUERIES["region_rejects"] = lambda spark, d: G.region_rejects(_planned(spark, d))
ORACLES["region_rejects"] = f"WITH {SQL} SELECT error_code, count(*) AS n_regions FROM g GROUP BY error_code"


def _candidates(spark, d):
    quality = F.explode(F.array(*[F.lit(q) for q in limits.IMAGE_QUALITIES]))
    return (
        bindings.regions_from_lineitem(table(spark, d, "lineitem"))
        .withColumn("quality", quality)
        .select("region_id", "quality", F.floor(F.col("width") * F.col("height") * F.col("quality") * 6).alias("n_bytes"))
    )


QUERIES["choose_encoding"] = lambda spark, d: G.choose_encoding(_candidates(spark, d))
ORACLES["choose_encoding"] = f"""
WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS region_id, unnest([0.9, 0.82, 0.74, 0.66]::DOUBLE[]) AS quality,
    (l_extendedprice / 50) * (l_tax * 10000) AS px FROM lineitem),
c AS (SELECT region_id, quality, CAST(floor(px * quality * 6) AS BIGINT) AS n_bytes FROM q)
SELECT region_id, max(quality) FILTER (n_bytes <= {limits.MAX_IMAGE_BYTES}) AS quality,
  arg_max(n_bytes, (quality, n_bytes)) FILTER (n_bytes <= {limits.MAX_IMAGE_BYTES}) AS n_bytes,
  CASE WHEN count(*) FILTER (n_bytes <= {limits.MAX_IMAGE_BYTES}) = 0 THEN 'IMAGE_TOO_LARGE' END AS error_code
FROM c GROUP BY region_id"""
