"""Blocks, page verdicts and document summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa import limits
from glossa.functions.text import array_median, code_points, round3
from glossa.operators.layout.columns import PAGE, column_of, with_reading_order
from glossa.operators.layout.geometry import turned, turned_size
from glossa.operators.layout.lines import DIRECTIONS, majority_direction, named
from glossa.operators.layout.rows import UNIT
from glossa.operators.layout.units import block_box, block_lines
from glossa.operators.text import chunks_of, joined_lines

def segment_blocks(units: DataFrame) -> DataFrame:
    """Merge consecutive lines of every unit into blocks (gaps and islands over reading order)."""
    blocks = block_lines(with_page_type(units))
    first = F.get("lines", F.lit(0))

    def total(name: str) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.aggregate("lines", zero, lambda acc, x: acc + F.coalesce(x[name], zero))

    texts = F.transform("lines", lambda x: x.text)
    return blocks.select(
        *UNIT,
        "block_ix",
        "is_main",
        "orientation",
        "page",
        "columns",
        "page_type",
        "column_count",
        F.size("lines").cast("bigint").alias("n_lines"),
        *block_box("b"),
        *block_box("l"),
        first.type.alias("type"),
        first.col_ix.alias("col_ix"),
        majority_direction(
            {d: total(f"w_{d}") for d in DIRECTIONS},
            {d: F.when(first.dir == d, 0).otherwise(1).cast("bigint") for d in DIRECTIONS},
        ).alias("dir"),
        F.when(first.type == "table", F.array_join(texts, "\n")).otherwise(joined_lines(texts)).alias("text"),
        round3(array_median(F.transform("lines", lambda x: x.font_size))).alias("font_size"),
    )


def place_rotated_blocks(blocks: DataFrame) -> DataFrame:
    """Project turned blocks into the main reading frame and order all blocks of a page.

    Adds ``block_no`` (1..n per page) and ``reading_orientation`` in degrees.
    """
    w, h = F.col("page.width"), F.col("page.height")
    q = F.col("orientation")
    ax, ay = turned(F.col("bx"), F.col("by"), q, w, h)
    zx, zy = turned(F.col("bx") + F.col("bw"), F.col("by") + F.col("bh"), q, w, h)
    width, height = turned_size(q, w, h)
    left = F.greatest(F.lit(0.0), F.least(ax, zx))
    top = F.greatest(F.lit(0.0), F.least(ay, zy))
    right = F.least(width, F.greatest(ax, zx))
    low = F.least(height, F.greatest(ay, zy))
    box = {
        "lx": round3(left),
        "ly": round3(top),
        "lw": round3(F.greatest(F.lit(0.0), right - left)),
        "lh": round3(F.greatest(F.lit(0.0), low - top)),
    }
    df = blocks.withColumns({f"_{k}": F.when(F.col("is_main"), F.col(k)).otherwise(v) for k, v in box.items()})
    for k in box:
        df = df.withColumn(k, F.col(f"_{k}")).drop(f"_{k}")
    placed = column_of(F.col("lx"), F.col("lx") + F.col("lw"), F.col("columns"))
    df = df.withColumn("_placed", placed)
    df = df.withColumn("col_ix", F.when(F.col("is_main"), F.col("col_ix")).otherwise(F.col("_placed")))
    df = with_reading_order(df.drop("_placed"), PAGE, ["text", "quarter", "block_ix"], "block_no")
    return df.withColumn("reading_orientation", (F.col("quarter") * 90).cast("int"))


def _facts() -> dict[str, Column]:
    """Aggregates over the final lines of a page."""
    main = F.col("is_main")
    return {
        "valid_chars": F.sum("item_valid"),
        "text_area": F.sum(F.when(main, F.col("bw") * F.col("bh")).otherwise(F.col("item_area"))),
        "n_lines": F.count("*"),
        "orientation": F.max("orientation"),
        "n_ignored": F.max("n_ignored"),
        "column_count": F.max(F.when(F.col("columns").isNotNull(), 2).otherwise(1)),
    }


def _is_scanned(n_lines: Column, valid: Column, coverage: Column) -> Column:
    return (
        (F.coalesce(n_lines, F.lit(0)) == 0)
        | (F.coalesce(valid, F.lit(0)) < limits.MIN_VALID_CHARS)
        | (F.coalesce(coverage, F.lit(0.0)) < limits.MIN_TEXT_COVERAGE)
    )


def with_page_type(units: DataFrame) -> DataFrame:
    """Adds ``page_type`` and ``column_count`` to the units; ``columns`` becomes the layout of the page's main text.

    The units are partitioned by page already, so windows over its few units need no shuffle.
    """
    w = Window.partitionBy(*PAGE)
    zero = F.lit(0).cast("bigint")
    area = F.aggregate(
        "lines",
        F.lit(0.0),
        lambda acc, x: acc + F.when(F.col("is_main"), x.f.bw * x.f.bh).otherwise(x.f.item_area),
    )
    df = units.withColumns(
        {
            "_valid_chars": F.sum(F.aggregate("lines", zero, lambda acc, x: acc + x.f.item_valid)).over(w),
            "_text_area": F.sum(area).over(w),
            "_n_lines": F.sum(F.size("lines")).over(w),
            # The layout of the main text also places turned blocks.
            "columns": F.max("columns").over(w),
        }
    )
    coverage = F.col("_text_area") / (F.col("page.width") * F.col("page.height"))
    scanned = _is_scanned(F.col("_n_lines"), F.col("_valid_chars"), coverage)
    return df.withColumns(
        {
            "page_type": F.when(scanned, "scanned").otherwise("text"),
            "column_count": F.when(F.col("columns").isNotNull(), 2).otherwise(1),
        }
    ).drop("_valid_chars", "_text_area", "_n_lines")


def page_verdict(lines: DataFrame, page_views: DataFrame) -> DataFrame:
    """``text`` or ``scanned`` per page, with the reason; pages without runs included."""
    facts = lines.groupBy(*PAGE).agg(*named(_facts()))
    size_ok = (
        (F.col("width") > 0)
        & (F.col("height") > 0)
        & (F.col("width") <= limits.MAX_PAGE_SIDE)
        & (F.col("height") <= limits.MAX_PAGE_SIDE)
    )
    df = page_views.select(*PAGE, "width", "height").join(facts, PAGE, "left")
    df = df.withColumns(
        {
            "valid_chars": F.coalesce("valid_chars", F.lit(0)).cast("bigint"),
            "_coverage": F.least(
                F.lit(1.0), F.coalesce("text_area", F.lit(0.0)) / (F.col("width") * F.col("height"))
            ),
        }
    )
    scanned = _is_scanned(F.col("n_lines"), F.col("valid_chars"), F.col("_coverage"))
    df = df.withColumn("page_type", F.when(scanned, "scanned").otherwise("text"))
    return df.select(
        *PAGE,
        "page_type",
        "valid_chars",
        round3(F.col("_coverage")).alias("text_coverage"),
        F.when(
            F.col("page_type") == "scanned",
            F.when(F.col("valid_chars") == 0, "no_text").otherwise("sparse_text"),
        ).alias("scan_reason"),
        F.coalesce("column_count", F.lit(1)).cast("int").alias("column_count"),
        (F.coalesce("orientation", F.lit(0)) * 90).cast("int").alias("reading_orientation"),
        F.coalesce("n_ignored", F.lit(0)).cast("bigint").alias("n_ignored"),
        F.when(~F.coalesce(size_ok, F.lit(False)), "PAGE_SIZE_INVALID").alias("error_code"),
    )


def finalize_blocks(
    blocks: DataFrame, max_chars: int = limits.MAX_BATCH_CHARS, drop_invalid: bool = True
) -> DataFrame:
    """Split long blocks, number them per page and scale boxes to 0..1000.

    Blocks of scanned pages are dropped, and (with ``drop_invalid``) blocks whose
    box leaves the valid range; numbering happens before the range check.
    """
    df = blocks.filter(F.col("page_type") == "text").withColumn(
        "_parts", chunks_of(F.col("text"), max_chars)
    )
    df = df.withColumn("continuation_count", F.size("_parts")).select(
        *[c for c in df.columns if c not in ("text", "_parts")],
        "continuation_count",
        F.posexplode("_parts").alias("continuation_ix", "text"),
    )
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_no", "continuation_ix"))
    w, h = F.col("page.width"), F.col("page.height")
    left, top = F.least(w, F.greatest(F.lit(0.0), F.col("bx"))), F.least(h, F.greatest(F.lit(0.0), F.col("by")))
    right = F.least(w, F.greatest(left, F.col("bx") + F.col("bw")))
    low = F.least(h, F.greatest(top, F.col("by") + F.col("bh")))
    scaled = {
        "x": round3(left / w * 1000),
        "y": round3(top / h * 1000),
        "width": round3((right - left) / w * 1000),
        "height": round3((low - top) / h * 1000),
    }
    out = df.withColumn("block_no", number).select(
        *PAGE,
        "block_no",
        F.concat(
            F.lit("p"), F.col("page_no").cast("string"), F.lit("-b"),
            F.when(F.col("block_no") < 1000, F.lpad(F.col("block_no").cast("string"), 3, "0")).otherwise(
                F.col("block_no").cast("string")
            ),
        ).alias("block_id"),
        "type",
        "text",
        code_points(F.col("text")).alias("n_chars"),
        "col_ix",
        "dir",
        "font_size",
        "reading_orientation",
        F.col("continuation_ix").cast("int").alias("continuation_ix"),
        F.col("continuation_count").cast("int").alias("continuation_count"),
        "column_count",
        *[c.alias(n) for n, c in scaled.items()],
    )
    if not drop_invalid:
        return out
    return out.filter(
        (F.col("width") > 0)
        & (F.col("height") > 0)
        & (F.col("x") + F.col("width") <= 1000)
        & (F.col("y") + F.col("height") <= 1000)
    )


def page_labels(page_views: DataFrame, blocks: DataFrame) -> DataFrame:
    """Type, columns, tables and footnotes per page; pages without blocks are scanned."""
    seen = blocks.groupBy(*PAGE).agg(
        F.count("*").alias("n_blocks"),
        F.max("column_count").alias("column_count"),
        F.bool_or(F.col("type") == "table").alias("has_table"),
        F.bool_or(F.col("type") == "footnote").alias("has_footnote"),
    )
    return page_views.select(*PAGE).join(seen, PAGE, "left").select(
        *PAGE,
        F.when(F.col("n_blocks").isNull(), "scanned").otherwise("text").alias("page_type"),
        F.coalesce("column_count", F.lit(1)).alias("column_count"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.coalesce("has_table", F.lit(False)).alias("has_table"),
        F.coalesce("has_footnote", F.lit(False)).alias("has_footnote"),
    )


def document_summary(page_views: DataFrame, blocks: DataFrame) -> DataFrame:
    """Page and block counts per document and whether all, some or no page is scanned.

    ``blocks`` are final blocks before the range check (``drop_invalid=False``).
    """
    labels = page_labels(page_views, blocks)
    text = F.col("page_type") == "text"
    return (
        labels.groupBy("doc_id")
        .agg(
            F.count("*").alias("n_pages"),
            F.count_if(text).alias("n_text_pages"),
            F.count_if(~text).alias("n_scanned_pages"),
            F.sum("n_blocks").alias("n_blocks"),
            F.count_if(text & (F.col("column_count") > 1)).alias("n_column_pages"),
            F.count_if("has_table").alias("n_table_pages"),
            F.count_if("has_footnote").alias("n_footnote_pages"),
        )
        .withColumn(
            "scan_class",
            F.when(F.col("n_scanned_pages") == F.col("n_pages"), "all")
            .when(F.col("n_scanned_pages") > 0, "some")
            .otherwise("none"),
        )
    )
