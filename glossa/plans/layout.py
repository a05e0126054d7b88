"""From positioned text runs to final lines, blocks and page facts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from glossa import limits
from glossa.operators.layout import blocks as B
from glossa.operators.layout import geometry as G
from glossa.operators.layout import rows as R
from glossa.operators.layout import units as U


#: Runs of one task at most.  The windows of the plan sort wide rows dozens of times and compressed sizes say little
#: about them (19 KB of sort and window memory a run, all operators together), so runs are counted instead.
RUNS_PER_TASK = 100_000
#: Up to the cores there are, tasks take this many runs.
LEAST_RUNS = 10_000


def tasks_for(runs: int, cores: int) -> int:
    """Tasks that share the pages; beyond the cores their number grows with the runs."""
    return max(1, math.ceil(runs / RUNS_PER_TASK), min(cores, math.ceil(runs / LEAST_RUNS)))


def prepared_items(items: DataFrame, page_views: DataFrame, font_styles: DataFrame) -> DataFrame:
    """Runs with boxes in their reading frame; marginal artefacts removed.

    The runs are counted first, so that their number decides how many tasks share the pages.
    """
    tasks = tasks_for(items.count(), items.sparkSession.sparkContext.defaultParallelism)
    return G.logical_geometry(G.with_orientation(G.item_geometry(items, page_views, font_styles, tasks)))


def segmented_items(prepared: DataFrame) -> DataFrame:
    keys = R.UNIT
    return R.split_segments(
        R.persistent_gutter(R.with_neighbour(R.row_bands(prepared, keys), keys), keys), keys
    )


def first_units(prepared: DataFrame) -> DataFrame:
    """Units with the typed lines of the first pass and the column layout of their page."""
    return U.with_columns_found(U.with_lines(U.with_gutter(U.with_rows(U.gather_units(prepared)))))


def ordered_units(units: DataFrame) -> DataFrame:
    """Units with their final lines in reading order, captions extended and paragraph signals."""
    return U.with_paragraphs(U.with_captions(U.ordered(U.refined(units))))


def analyze_units(items: DataFrame, page_views: DataFrame, font_styles: DataFrame) -> DataFrame:
    """All units of all pages, ready for ``segment_blocks``."""
    return ordered_units(first_units(prepared_items(items, page_views, font_styles)))


def analyze_pages(items: DataFrame, page_views: DataFrame, font_styles: DataFrame) -> DataFrame:
    """All lines of all pages, ready for ``page_verdict``."""
    return U.line_rows(analyze_units(items, page_views, font_styles))


def page_blocks(
    items: DataFrame,
    page_views: DataFrame,
    font_styles: DataFrame,
    max_chars: int = limits.MAX_BATCH_CHARS,
    drop_invalid: bool = True,
) -> DataFrame:
    """Final blocks of all text pages."""
    units = analyze_units(items, page_views, font_styles)
    placed = B.place_rotated_blocks(B.segment_blocks(units))
    return B.finalize_blocks(placed, max_chars, drop_invalid)
