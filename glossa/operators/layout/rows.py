"""Text rows, gutters and the cut of rows into segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.packing import narrowed
from glossa.functions.text import round3

# One unit = the runs of a page that share a reading direction.
UNIT = ["doc_id", "page_no", "quarter"]

# Fixed value: the shape of an equation number.
EQUATION_NUMBER = r"(?i)\A(?:\(?[0-9]+(?:[a-z]|\.[0-9]+)?\)?|\[[0-9]+(?:[a-z]|\.[0-9]+)?\])\z"


def with_y_bands(df: DataFrame, keys: list[str], y: str, out: str) -> DataFrame:
    """Number groups of near-equal y: a new one starts when y grows by more than 0.5.

    This makes the tolerant "same height, then by x" order well defined.
    """
    w = Window.partitionBy(*keys).orderBy(y)
    step = F.when(F.col(y) - F.lag(y).over(w) > 0.5, 1).otherwise(0)
    # A range frame gives equal y the same number.
    upto = Window.partitionBy(*keys).orderBy(y).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_step", step).withColumn(out, F.sum("_step").over(upto)).drop("_step")


# Greedy clustering of one strip of runs (text rows that touch in y), in reading
# order.  State: b = the last six bands (top, height, fonts), n = bands before
# them, o = band number per run.  A run joins the nearest of those bands whose
# centre is within max(2, 0.48 * smaller font) or which overlaps it by at least
# 45 %.
_MEDIAN = (
    "(element_at(array_sort({f}), cast((size({f}) + 1) div 2 as int))"
    " + element_at(array_sort({f}), cast(size({f}) div 2 + 1 as int))) / 2"
)
_R3 = "(floor(({v}) * 1000.0D + 0.5D) / 1000.0D)"
_FOLD = f"""
aggregate(_members,
  named_struct('b', cast(array() as array<struct<t:double,h:double,f:array<double>>>),
               'n', 0, 'o', cast(array() as array<int>)),
  (s, x) -> transform(array(array_min(filter(
      transform(s.b, (b, i) -> named_struct(
        'd', abs(x.ly + x.lh / 2 - (b.t + b.h / 2)),
        'i', i,
        'ok', abs(x.ly + x.lh / 2 - (b.t + b.h / 2))
            <= greatest(2.0D, least(x.font_size, {_MEDIAN.format(f="b.f")}) * 0.48D)
          or greatest(0.0D, least(x.ly + x.lh, b.t + b.h) - greatest(x.ly, b.t))
            / greatest(1.0D, least(x.lh, b.h)) >= 0.45D)),
      c -> c.ok))),
    hit -> if(hit is null,
      named_struct('b', array_append(slice(s.b, if(size(s.b) < 6, 1, 2), 5),
                                     named_struct('t', x.ly, 'h', x.lh, 'f', array(x.font_size))),
                   'n', s.n + if(size(s.b) < 6, 0, 1),
                   'o', array_append(s.o, s.n + size(s.b))),
      named_struct('b', transform(s.b, (b, i) -> if(i = hit.i,
            named_struct('t', {_R3.format(v="least(b.t, x.ly)")},
                         'h', {_R3.format(v="greatest(b.t + b.h, x.ly + x.lh) - least(b.t, x.ly)")},
                         'f', array_append(b.f, x.font_size)), b)),
                   'n', s.n,
                   'o', array_append(s.o, s.n + hit.i))))[0],
  s -> s.o)"""


def row_bands(items: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Cluster runs into text rows; adds ``row_ix, row_y, row_h``.

    The clustering is sequential, but runs interact only where they touch in y.
    A unit is first cut into strips between which no run can join an earlier
    row; a strip whose runs all share one height and position is a single row.
    Only the remaining strips are folded, once each.
    """
    return narrowed(
        items,
        [*keys, "item_ix", "lx", "ly", "lh", "font_size"],
        lambda d: _row_bands(d, keys),
    )


def _row_bands(items: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    df = with_y_bands(items, keys, "ly", "_band")
    seq = Window.partitionBy(*keys).orderBy("_band", "lx", "item_ix")
    earlier = seq.rowsBetween(Window.unboundedPreceding, -1)
    # The running value over all later runs uses the reversed order: a frame that
    # is open at its end would be evaluated anew for every row.
    later = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("_band"), F.desc("lx"), F.desc("item_ix"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    centre = F.col("ly") + F.col("lh") / 2
    slack = F.greatest(F.lit(2.0), F.col("font_size") * 0.48)
    df = df.withColumns(
        {"_low_y": F.min("ly").over(later), "_low_centre": F.min(centre - slack).over(later)}
    )
    opens = (
        F.coalesce(F.lag("_band").over(seq) != F.col("_band"), F.lit(True))
        & (F.col("_low_y") >= F.max(F.col("ly") + F.col("lh")).over(earlier))
        & (F.col("_low_centre") > F.max(centre).over(earlier))
    )
    df = df.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int"))
    df = df.withColumn("_strip", F.sum("_opens").over(seq))

    # One row per strip, in the partitioning of its page; its runs come back one by one.
    carried = [c for c in items.columns if c not in (*keys, "lx", "item_ix")]
    member = F.struct("_band", "lx", "item_ix", *carried)
    strips = df.groupBy(*keys, "_strip").agg(
        F.array_sort(F.collect_list(member)).alias("_members"),
        ((F.min("ly") == F.max("ly")) & (F.min("lh") == F.max("lh"))).alias("_plain"),
    )
    number = F.when(F.col("_plain"), F.transform("_members", lambda m: F.lit(0))).otherwise(F.expr(_FOLD))
    df = strips.select(
        *keys, "_strip", F.explode(F.arrays_zip(F.col("_members").alias("m"), number.alias("k"))).alias("_z")
    ).select(
        *keys,
        "_strip",
        F.col("_z.k").alias("_sub"),
        *[F.col(f"_z.m.{c}").alias(c) for c in ("item_ix", "lx", *carried)],
    )

    band = Window.partitionBy(*keys, "_strip", "_sub")
    df = df.withColumns(
        {
            "row_y": round3(F.min("ly").over(band)),
            "row_h": round3(F.max(F.col("ly") + F.col("lh")).over(band) - F.min("ly").over(band)),
        }
    )
    ranked = Window.partitionBy(*keys).orderBy("row_y", "_strip", "_sub")
    df = df.withColumn("row_ix", (F.dense_rank().over(ranked) - 1).cast("int"))
    return df.drop("_strip", "_sub")


def with_neighbour(items: DataFrame, keys: list[str]) -> DataFrame:
    """Previous run of the row (``p``), the gap to it and the pair's font size."""
    w = Window.partitionBy(*keys, "row_ix").orderBy("lx", "item_ix")
    df = items.withColumn("_p", F.lag(F.struct("lx", "lw", "font_size", "has_eol")).over(w))
    narrow_number = F.rlike("text", F.lit(EQUATION_NUMBER)) & (
        F.col("lw") <= F.col("logical_width") * 0.08
    )
    return df.withColumns(
        {
            "_right": F.col("_p.lx") + F.col("_p.lw"),
            "_gap": F.col("lx") - (F.col("_p.lx") + F.col("_p.lw")),
            "_pair_font": (F.col("_p.font_size") + F.col("font_size")) / 2,
            "_eqno": narrow_number,
        }
    )


# Sweep over one unit: gap starts raise, gap ends lower the number of rows that
# are open at x (the gaps of a row never overlap, so gaps count rows).  At equal
# x ends come before candidates and candidates before starts, because a gap must
# cover its candidate strictly.  Best = most rows, then nearest to the centre,
# then first.
_SWEEP = """
aggregate(
  array_sort(flatten(transform(_gaps, (g, i) -> array(
    named_struct('x', g.s, 'kind', 2, 'rank', 0),
    named_struct('x', g.e, 'kind', 0, 'rank', 0),
    named_struct('x', (g.s + g.e) / 2, 'kind', 1, 'rank', 3 * i),
    named_struct('x', g.s + (g.e - g.s) * 0.3D, 'kind', 1, 'rank', 3 * i + 1),
    named_struct('x', g.s + (g.e - g.s) * 0.7D, 'kind', 1, 'rank', 3 * i + 2))))),
  named_struct('open', 0, 'score', 0, 'far', 0.0D, 'rank', 0, 'x', cast(null as double)),
  (a, v) -> if(v.kind = 2, named_struct('open', a.open + 1, 'score', a.score, 'far', a.far, 'rank', a.rank, 'x', a.x),
    if(v.kind = 0, named_struct('open', a.open - 1, 'score', a.score, 'far', a.far, 'rank', a.rank, 'x', a.x),
      if(v.x >= logical_width * 0.25D and v.x <= logical_width * 0.75D and a.open >= _min_rows
         and (a.x is null or a.open > a.score
              or (a.open = a.score and abs(v.x - logical_width / 2) < a.far)
              or (a.open = a.score and abs(v.x - logical_width / 2) = a.far and v.rank < a.rank)),
        named_struct('open', a.open, 'score', a.open, 'far', abs(v.x - logical_width / 2), 'rank', v.rank, 'x', v.x),
        a))),
  a -> named_struct('x', a.x, 'score', a.score))"""


def persistent_gutter(items: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Vertical white lane kept by several rows; adds ``gutter_lane`` (null = none).

    Needs the columns of ``with_neighbour``.  The three candidates of every gap
    are scored in one sorted sweep per unit, not by comparing all pairs.
    """
    return narrowed(
        items,
        [*keys, "row_ix", "item_ix", "lx", "_right", "_gap", "_pair_font", "_eqno", "logical_width"],
        lambda d: _persistent_gutter(d, keys),
    )


def _persistent_gutter(items: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    width = F.col("logical_width")
    counts = (
        ~F.col("_eqno")
        & (F.col("_gap") >= F.greatest(width * 0.008, F.col("_pair_font") * 1.05))
        & (F.col("_right") < width * 0.75)
        & (F.col("lx") > width * 0.25)
    )
    w = Window.partitionBy(*keys).orderBy("row_ix", "lx", "item_ix")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n_rows = F.max("row_ix").over(whole) + 1
    df = items.withColumns(
        {
            "_nth": F.row_number().over(w),
            "_gaps": F.collect_list(
                F.when(counts, F.struct(F.col("_right").alias("s"), F.col("lx").alias("e")))
            ).over(whole),
            "_min_rows": F.when(
                n_rows >= 6, F.greatest(F.lit(3), F.ceil(n_rows * F.lit(0.06)))
            ).otherwise(2),
        }
    )
    df = df.withColumn("_best", F.when((F.col("_nth") == 1) & (F.size("_gaps") >= 2), F.expr(_SWEEP)))
    df = df.withColumn("_best", F.first("_best", ignorenulls=True).over(whole))
    return df.withColumns(
        {"gutter_lane": round3(F.col("_best.x")), "gutter_rows": F.col("_best.score")}
    ).drop("_nth", "_gaps", "_min_rows", "_best")


def split_segments(items: DataFrame, keys: list[str] = UNIT, region: Column | None = None) -> DataFrame:
    """Cut rows at line ends, wide gaps, the persistent gutter and, when a
    ``region`` struct (x, top, bottom) is given, at its forced gutter.

    Adds ``seg_ix`` and ``row_segments``.
    """
    width, font, gap = F.col("logical_width"), F.col("_pair_font"), F.col("_gap")
    wide = F.greatest(width * 0.08, font * 5)
    lane = F.col("gutter_lane")
    cut = (
        (F.col("_p.has_eol") & ~F.col("_eqno"))
        | (gap > wide)
        | F.coalesce(
            (F.col("_right") < lane)
            & (F.col("lx") > lane)
            & (gap > F.greatest(width * 0.008, font * 1.05)),
            F.lit(False),
        )
    )
    if region is not None:
        middle = F.col("row_y") + F.col("row_h") / 2
        cut = cut | F.coalesce(
            ~F.col("row_preserved")
            & (middle >= region["top"])
            & (middle <= region["bottom"])
            & (F.col("_p.lx") + F.col("_p.lw") / 2 < region["x"])
            & (F.col("lx") + F.col("lw") / 2 > region["x"])
            & (gap >= F.greatest(F.lit(2.0), font * 0.45)),
            F.lit(False),
        )
    w = Window.partitionBy(*keys, "row_ix").orderBy("lx", "item_ix")
    df = items.withColumn(
        "_cut", F.when(F.col("_p").isNotNull() & cut, 1).otherwise(0)
    ).withColumn("seg_ix", F.sum("_cut").over(w).cast("int"))
    return df.withColumn(
        "row_segments",
        F.max("seg_ix").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1,
    ).drop("_cut", "_p", "_right", "_gap", "_pair_font", "_eqno")
