"""Column helpers for Unicode text.

The patterns use only syntax that Java and RE2 share, so that the same string
can be handed to another engine when results are compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space set (BOM included), as a regex class
# body and as the characters themselves.
SPACE_BODY = (
    r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = f"[{SPACE_BODY}]"
SPACE_CHARS = "".join(
    map(
        chr,
        [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680]
        + list(range(0x2000, 0x200B))
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF],
    )
)
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def trim_space(col: Column) -> Column:
    """Strip Unicode white space on both sides (no regex involved)."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def is_blank(col: Column) -> Column:
    return F.coalesce(trim_space(col), F.lit("")) == ""


def count_class(col: Column, body: str) -> Column:
    """Number of characters in a regex class given by its body.

    Removing the runs *outside* the class costs one match per run, which is far
    cheaper than one match per counted character.
    """
    return F.length(F.regexp_replace(col, f"[^{body}]+", "")).cast("bigint")


def valid_chars(col: Column) -> Column:
    """Letters and digits."""
    return count_class(col, r"\p{L}\p{N}")


def code_points(col: Column) -> Column:
    return F.length(col).cast("bigint")


def utf16_units(col: Column) -> Column:
    return code_points(col) + count_class(col, r"\x{10000}-\x{10FFFF}")


def utf8_bytes(col: Column) -> Column:
    return F.octet_length(col).cast("bigint")


def round_half_up(col: Column) -> Column:
    """Round to an integer, .5 towards positive infinity."""
    return F.floor(col + F.lit(0.5))


def round3(col: Column) -> Column:
    """Round to three decimals, .5 towards positive infinity."""
    return F.floor(col * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(1000.0)


def array_median(arr: Column) -> Column:
    """Exact median of a numeric array; the two middles are averaged."""
    s = F.array_sort(arr)
    n = F.size(arr)
    return F.when(
        n % 2 == 0, (F.get(s, (n / 2).cast("int") - 1) + F.get(s, (n / 2).cast("int"))) / 2
    ).otherwise(F.get(s, F.floor(n / 2).cast("int")))


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(col: Column) -> Column:
    out = F.coalesce(col.cast("string"), F.lit(""))
    for raw, entity in _HTML:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out
