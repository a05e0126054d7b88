"""Lines from row segments: text, style, table rows and line types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import array_median, code_points, round3, trim_space, valid_chars
from glossa.operators.layout.rows import UNIT, with_y_bands
from glossa.operators.text import joins_without_space

# Patterns that tell kinds of lines apart.
LIST_START = (
    r"(?iu)\A\s*(?:[-*\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}]|(?:[0-9]+|[A-Za-z]|[ivxlcdm]+)[.)])\s+"
)
HEADING_START = (
    r"(?iu)\A\s*(?:abstract|keywords?|references|bibliography|acknowledg(?:e)?ments?|appendix"
    r"|[0-9]+(?:\.[0-9]+)*\s+[\p{L}\p{N}])"
)
CAPTION_START = r"(?iu)\A\s*(?:fig(?:ure)?|table)\s*[.0-9IVXLC:-]+"
METADATA_LINE = r"(?iu)\A(?:\S+@\S+|(?:https?://|doi\s*:|arxiv\s*:).+)\z"

# Sorting the nested runs as structs orders them by x, then by position.
ITEM_FIELDS = [
    "lx", "item_ix", "text", "dir", "font_name", "has_eol", "is_bold", "is_italic", "font_size",
    "bx", "by", "bw", "bh", "ly", "lw", "lh", "row_ix", "row_y", "row_h", "n_chars", "n_valid",
]
UNIT_FACTS = [
    "is_main", "orientation", "n_ignored", "logical_width", "logical_height", "page",
    "gutter_lane", "gutter_rows",
]


def union_box(prefix: str, out: str | None = None) -> dict[str, Column]:
    """Aggregates for the box around boxes ``{prefix}x/y/w/h``."""
    x, y, w, h = (F.col(prefix + c) for c in "xywh")
    out = out or prefix
    return {
        f"{out}x": round3(F.min(x)),
        f"{out}y": round3(F.min(y)),
        f"{out}w": round3(F.max(x + w) - F.min(x)),
        f"{out}h": round3(F.max(y + h) - F.min(y)),
    }


def named(aggs: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in aggs.items()]


def majority_direction(weights: dict[str, Column], first: dict[str, Column]) -> Column:
    """Direction with most characters; the one seen first wins a tie."""
    ranked = F.array(
        *[
            F.struct(F.coalesce(weights[d], F.lit(0)).alias("w"), (-F.coalesce(first[d], F.lit(2**40))).alias("f"), F.lit(d).alias("d"))
            for d in weights
        ]
    )
    return F.array_max(ranked)["d"]


DIRECTIONS = ("ltr", "rtl", "ttb")


def assemble_lines(items: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """One row per segment; the runs stay nested in ``items`` for a second cut.

    Segments are many and small (mostly a single run), so the aggregation only
    gathers the runs; all line facts are array expressions over them.
    """
    df = items
    if "n_valid" not in df.columns:
        df = df.withColumns({"n_chars": code_points(F.col("text")), "n_valid": valid_chars(F.col("text"))})
    lines = (
        df.groupBy(*keys, "row_ix", "seg_ix")
        .agg(
            F.first(F.struct(*UNIT_FACTS, "row_segments")).alias("_facts"),
            F.collect_list(F.struct(*ITEM_FIELDS)).alias("items"),
        )
        .select(*keys, "row_ix", "seg_ix", "_facts.*", F.array_sort("items").alias("items"))
    )
    directions = F.col("items.dir")

    def total(value) -> Column:
        return F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, i: acc + value(i))

    def weight(i: Column) -> Column:
        return F.greatest(F.lit(1).cast("bigint"), i.n_valid)

    zero = F.lit(0).cast("bigint")
    for d in DIRECTIONS:
        lines = lines.withColumn(
            f"w_{d}",
            F.when(
                F.array_contains(directions, d),
                total(lambda i, d=d: F.when(i.dir == d, F.greatest(F.lit(1).cast("bigint"), i.n_chars)).otherwise(zero)),
            ),
        )
    first = {d: F.nullif(F.array_position(directions, d), F.lit(0)) for d in DIRECTIONS}
    lines = lines.withColumn("dir", majority_direction({d: F.col(f"w_{d}") for d in DIRECTIONS}, first))
    lines = lines.withColumns(
        {
            **nested_box("items", "b"),
            **nested_box("items", "l"),
            "_weight": total(weight),
            "_bold": total(lambda i: F.when(i.is_bold, weight(i)).otherwise(zero)),
            "_italic": total(lambda i: F.when(i.is_italic, weight(i)).otherwise(zero)),
            "item_valid": total(lambda i: i.n_valid),
            "item_area": F.aggregate("items", F.lit(0.0), lambda acc, i: acc + i.bw * i.bh),
        }
    )
    # Right-to-left lines read from the largest x.
    mirrored = F.transform(
        F.array_sort(F.transform("items", lambda i: F.struct((-i.lx).alias("k"), i.item_ix.alias("n"), i.alias("i")))),
        lambda s: s.i,
    )
    lines = lines.withColumn("items", F.when(F.col("dir") == "rtl", mirrored).otherwise(F.col("items")))
    return lines.select(
        *keys,
        "row_ix",
        "seg_ix",
        *UNIT_FACTS,
        "row_segments",
        F.lit(False).alias("is_table"),
        trim_space(_line_text()).alias("text"),
        "dir",
        *[f"w_{d}" for d in DIRECTIONS],
        "bx",
        "by",
        "bw",
        "bh",
        "lx",
        "ly",
        "lw",
        "lh",
        F.when(F.size("items") == 1, F.get("items.font_size", F.lit(0)))
        .otherwise(round3(array_median(F.col("items.font_size"))))
        .alias("font_size"),
        F.coalesce(F.get(F.filter("items.font_name", lambda n: n != ""), F.lit(0)), F.lit("")).alias("font_name"),
        (F.col("_bold") >= F.col("_weight") * 0.5).alias("is_bold"),
        (F.col("_italic") >= F.col("_weight") * 0.5).alias("is_italic"),
        F.size("items").alias("n_items"),
        "item_valid",
        "item_area",
        "items",
    )


def nested_box(array: str, p: str) -> dict[str, Column]:
    """Box around the boxes ``{p}x/y/w/h`` of an array of structs."""
    right = F.array_max(F.transform(array, lambda i: i[p + "x"] + i[p + "w"]))
    low = F.array_max(F.transform(array, lambda i: i[p + "y"] + i[p + "h"]))
    left, top = F.array_min(f"{array}.{p}x"), F.array_min(f"{array}.{p}y")
    return {f"{p}x": round3(left), f"{p}y": round3(top), f"{p}w": round3(right - left), f"{p}h": round3(low - top)}


def _line_text() -> Column:
    """Text of the ordered runs, with a blank where the gap and scripts ask for one."""
    items = F.col("items")
    previous = F.concat(
        F.array(F.lit(None).cast("struct<text:string,lx:double,lw:double,font_size:double,first:boolean>")),
        F.transform(
            F.slice(items, F.lit(1), F.size(items) - 1),
            lambda i, k: F.struct(
                i.text.alias("text"), i.lx.alias("lx"), i.lw.alias("lw"), i.font_size.alias("font_size"),
                (k == 0).alias("first"),
            ),
        ),
    )

    def piece(x: Column, p: Column) -> Column:
        gap = F.when(F.col("dir") == "rtl", p.lx - (x.lx + x.lw)).otherwise(x.lx - (p.lx + p.lw))
        font = (p.font_size + x.font_size) / 2
        letters = p.first & (F.length(p.text) == 1) & (F.length(x.text) == 1) & (gap < font * 0.18)
        blank = ~joins_without_space(p.text, x.text) & ~letters & (gap > -font * 0.08)
        return F.when(p.isNotNull() & blank, F.concat(F.lit(" "), x.text)).otherwise(x.text)

    return F.when(F.size(items) == 1, F.get(items, F.lit(0)).text).otherwise(
        F.array_join(F.zip_with(items, previous, piece), "")
    )


def mark_table_rows(lines: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Collapse rows of three and more cells next to a row with the same cell starts.

    Rows are compared with their neighbours by ``lag``/``lead`` over rows, and
    only rows of three and more cells carry their cell starts.  Also numbers the
    lines of a unit from top to bottom (``line_ix``).
    """
    fields = [c for c in lines.columns if c not in (*keys, "row_ix")]
    rows = lines.groupBy(*keys, "row_ix").agg(
        F.array_sort(F.collect_list(F.struct(F.col("lx").alias("_x"), F.col("seg_ix").alias("_s"), F.struct(*fields).alias("l")))).alias("_ls"),
        F.max("is_main").alias("_main"),
    )
    cells = F.col("_ls")
    first = F.get(cells, F.lit(0)).l
    rows = rows.withColumn("_y", first.ly).withColumn(
        "_wide",
        F.when(
            F.col("_main") & (F.size(cells) >= 3),
            F.struct(
                first.ly.alias("y"),
                F.transform(cells, lambda c: c.l.lx).alias("xs"),
                F.transform(cells, lambda c: c.l.font_size).alias("fonts"),
            ),
        ),
    )
    w = Window.partitionBy(*keys).orderBy("_y", "row_ix")
    rows = rows.withColumns({"_up": F.lag("_wide").over(w), "_down": F.lead("_wide").over(w)})

    def aligned(other: str) -> Column:
        o, me = F.col(other), F.col("_wide")
        font = array_median(F.concat(me.fonts, o.fonts))
        near = F.abs(me.y - o.y) <= font * 3
        match = F.size(
            F.filter(
                me.xs,
                lambda x: F.exists(o.xs, lambda z: F.abs(z - x) <= F.greatest(F.lit(6.0), font * 1.1)),
            )
        )
        return F.when(me.isNotNull() & o.isNotNull(), near & (match >= 3)).otherwise(False)

    rows = rows.withColumn("_table", aligned("_up") | aligned("_down")).drop("_up", "_down", "_wide")

    plain = F.transform(cells, lambda c: c.l)

    def total(name: str) -> Column:
        return F.aggregate(
            F.transform(cells, lambda c: c.l[name]),
            F.lit(0).cast(lines.schema[name].dataType),
            lambda a, v: a + F.coalesce(v, F.lit(0).cast(lines.schema[name].dataType)),
        )

    def box(p: str) -> dict[str, Column]:
        left = F.array_min(F.transform(cells, lambda c: c.l[p + "x"]))
        top = F.array_min(F.transform(cells, lambda c: c.l[p + "y"]))
        right = F.array_max(F.transform(cells, lambda c: c.l[p + "x"] + c.l[p + "w"]))
        bottom = F.array_max(F.transform(cells, lambda c: c.l[p + "y"] + c.l[p + "h"]))
        return {p + "x": round3(left), p + "y": round3(top), p + "w": round3(right - left), p + "h": round3(bottom - top)}

    merged = {
        "text": F.array_join(F.transform(cells, lambda c: c.l.text), "\t"),
        "font_size": round3(array_median(F.transform(cells, lambda c: c.l.font_size))),
        "row_segments": F.size(cells),
        "is_table": F.lit(True),
        "items": F.flatten(F.transform(cells, lambda c: c.l["items"])),
        **{n: total(n) for n in ("n_items", "item_valid", "item_area", *[f"w_{d}" for d in DIRECTIONS])},
        **box("b"),
        **box("l"),
    }
    one = F.struct(
        *[merged[c].cast(lines.schema[c].dataType).alias(c) if c in merged else first[c].alias(c) for c in fields]
    )
    out = rows.withColumn(
        "_l", F.explode(F.when(F.col("_table"), F.array(one)).otherwise(plain))
    ).select(*keys, "row_ix", "_l.*")
    out = with_y_bands(out, keys, "ly", "_band")
    order = Window.partitionBy(*keys).orderBy("_band", "lx", "row_ix", "seg_ix")
    return out.withColumn("line_ix", F.row_number().over(order)).drop("_band")


def classify_lines(lines: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Adds ``type``: ordered rules against the median font of the page."""
    w = Window.partitionBy(*keys)
    body = F.coalesce(
        F.percentile(F.when(~F.col("is_table"), F.col("font_size")), F.lit(0.5)).over(w), F.lit(12.0)
    )
    df = lines.withColumn("_body", body)
    height = F.col("logical_height")
    edge = F.greatest(F.lit(24.0), height * 0.065)
    n = F.length("text")
    kind = (
        F.when(~F.col("is_main"), "rotated_text")
        .when(F.col("is_table"), "table")
        .when(F.col("ly") + F.col("lh") >= height - edge, "footer")
        .when((F.col("ly") >= height * 0.68) & (F.col("font_size") <= F.col("_body") * 0.8), "footnote")
        .when(F.rlike("text", F.lit(CAPTION_START)), "caption")
        .when(
            (n <= 240)
            & (F.rlike("text", F.lit(HEADING_START)) | (F.col("font_size") >= F.col("_body") * 1.22)),
            "heading",
        )
        .when((F.col("ly") <= edge) & (n <= 240), "header")
        .when((n <= 240) & F.rlike("text", F.lit(METADATA_LINE)), "metadata")
        .when(F.rlike("text", F.lit(LIST_START)), "list")
        .when(F.col("is_italic") & (n >= 20), "quote")
        .otherwise("paragraph")
    )
    return df.withColumn("type", kind).drop("_body")
