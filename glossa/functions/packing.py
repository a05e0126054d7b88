"""Narrow rows for chains of windows.

A window operator copies every column of a row, field by field.  Columns a step
does not look at are packed into one struct, which is copied as a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REST = "_rest"


def narrowed(df: DataFrame, keep: Sequence[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``step`` on the columns in ``keep``; the others travel along packed."""
    keep = list(dict.fromkeys(keep))
    rest = [c for c in df.columns if c not in keep]
    if not rest:
        return step(df)
    out = step(df.select(*keep, F.struct(*rest).alias(_REST)))
    return out.select(*[c for c in out.columns if c != _REST], f"{_REST}.*")
