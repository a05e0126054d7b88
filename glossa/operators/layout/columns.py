"""Column detection and the order of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.packing import narrowed
from glossa.functions.text import round3, valid_chars
from glossa.operators.layout.rows import UNIT, with_y_bands

PAGE = ["doc_id", "page_no"]


def detect_columns(lines: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Adds the struct ``columns`` (null unless the page reads in two columns)."""
    return narrowed(
        lines,
        [*keys, "logical_width", "is_main", "type", "lx", "lw", "ly", "lh", "line_ix", "font_size", "text"],
        lambda d: _detect_columns(d, keys),
    )


def _detect_columns(lines: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    width = F.col("logical_width")
    right = F.col("lx") + F.col("lw")
    candidate = (
        F.col("is_main")
        & ~F.col("type").isin("table", "header", "footer", "heading", "metadata")
        & (F.col("lw") <= width * 0.62)
    )
    df = lines.withColumn("_cand", candidate)
    by_x = Window.partitionBy(*keys, "_cand").orderBy("lx", "line_ix")
    unit = Window.partitionBy(*keys)
    df = df.withColumns(
        {
            "_nth": F.row_number().over(by_x),
            "_jump": F.col("lx") - F.lag("lx").over(by_x),
            "_n": F.count_if("_cand").over(unit),
            "_font": F.coalesce(
                F.percentile(F.when(F.col("_cand"), F.col("font_size")), F.lit(0.5)).over(unit), F.lit(12.0)
            ),
        }
    )
    wide_jump = (
        F.col("_cand")
        & (F.col("_n") >= 4)
        & (F.col("_nth") >= 3)
        & (F.col("_n") - F.col("_nth") >= 1)
        & (F.col("_jump") >= F.greatest(width * 0.14, F.col("_font") * 4))
    )
    best = F.max(F.when(wide_jump, F.struct(F.col("_jump").alias("j"), (-F.col("_nth")).alias("m")))).over(unit)
    df = df.withColumn("_split", -best["m"])
    on_right = F.col("_cand") & (F.col("_nth") >= F.col("_split"))
    df = df.withColumn("_right_start", F.min(F.when(on_right, F.col("lx"))).over(unit))
    gutter = F.greatest(F.lit(8.0), width * 0.015)
    df = df.withColumn(
        "_side",
        F.when(on_right, "r").when(
            F.col("_cand") & (F.col("_nth") < F.col("_split")) & (right <= F.col("_right_start") - gutter), "l"
        ),
    )
    df = df.withColumn("_valid", F.when(F.col("_side").isNotNull(), valid_chars(F.col("text"))))

    def side(s: str, agg, value: Column) -> Column:
        return agg(F.when(F.col("_side") == s, value)).over(unit)

    facts = {}
    for s in ("l", "r"):
        facts[f"_{s}n"] = F.count_if(F.col("_side") == s).over(unit)
        facts[f"_{s}chars"] = side(s, F.sum, F.col("_valid"))
        facts[f"_{s}width"] = side(s, lambda v: F.percentile(v, F.lit(0.5)), F.col("lw"))
        facts[f"_{s}top"] = side(s, F.min, F.col("ly"))
        facts[f"_{s}bottom"] = side(s, F.max, F.col("ly") + F.col("lh"))
    facts["_left_end"] = side("l", F.max, right)
    df = df.withColumns(facts)

    def solid(s: str) -> Column:
        return (F.col(f"_{s}chars") >= 12) & (
            (F.col(f"_{s}width") >= width * 0.1) | (F.col(f"_{s}chars") >= 80)
        )

    top = F.greatest("_ltop", "_rtop")
    bottom = F.least("_lbottom", "_rbottom")
    two = (
        (F.col("_ln") >= 2)
        & (F.col("_rn") >= 2)
        & solid("l")
        & solid("r")
        & (bottom - top >= F.col("_font") * 0.5)
        & (F.col("_right_start") - F.col("_left_end") >= gutter)
    )
    layout = F.struct(
        round3(F.col("_left_end")).alias("left_end"),
        round3(F.col("_right_start")).alias("right_start"),
        round3(F.col("_right_start") - F.col("_left_end")).alias("gutter_width"),
        round3(top).alias("top"),
        round3(bottom).alias("bottom"),
    )
    return df.withColumn("columns", F.when(two, layout)).drop(
        "_cand", "_nth", "_jump", "_n", "_font", "_split", "_right_start", "_side", "_valid", *facts
    )


def column_of(x: Column, right: Column, columns: Column) -> Column:
    """0 left, 1 right, null for boxes that span the gutter; 0 on one-column pages."""
    tolerance = F.greatest(F.lit(2.0), columns["gutter_width"] * 0.15)
    return F.when(columns.isNull(), 0).when(
        right <= columns["right_start"] - tolerance, 0
    ).when(x >= columns["right_start"] - tolerance, 1)


def with_reading_order(df: DataFrame, keys: list[str], tie: list[str], out: str) -> DataFrame:
    """Number boxes in reading order (``out``, from 1) within each key.

    Boxes that span the gutter (``col_ix`` null) are barriers: before each of
    them come the left column, then the right.  The barrier of a box is found by
    counting, in one sorted pass, the barriers whose limit it does not pass; the
    limits are made monotonic by a running maximum first.
    """
    return narrowed(
        df,
        [*keys, "col_ix", "ly", "lx", "font_size", *tie],
        lambda d: _with_reading_order(d, keys, tie, out),
    )


def _with_reading_order(df: DataFrame, keys: list[str], tie: list[str], out: str) -> DataFrame:
    df = df.withColumn("_span", F.col("col_ix").isNull())
    spans = Window.partitionBy(*keys, "_span").orderBy("ly", *tie)
    limit = F.max(F.col("ly") + F.least(F.lit(2.0), F.col("font_size") * 0.15)).over(
        spans.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    df = df.withColumns({"_limit": limit, "_nth": F.row_number().over(spans)})
    df = df.withColumn("_at", F.when(F.col("_span"), F.col("_limit")).otherwise(F.col("ly")))
    sweep = Window.partitionBy(*keys).orderBy(F.col("_at"), F.col("_span").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    passed = F.count_if("_span").over(sweep)
    df = df.withColumn("_barrier", F.when(F.col("_span"), F.col("_nth") - 1).otherwise(passed))
    df = with_y_bands(df, [*keys, "_barrier", "_span", "col_ix"], "ly", "_band")
    order = Window.partitionBy(*keys).orderBy("_barrier", "_span", "col_ix", "_band", "lx", *tie)
    return df.withColumn(out, F.row_number().over(order)).drop(
        "_span", "_limit", "_nth", "_at", "_barrier", "_band"
    )
