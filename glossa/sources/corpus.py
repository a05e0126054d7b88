"""Text corpora and crawl tables."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import code_points, utf8_bytes
from glossa.operators.text import normalized


def read_corpus(spark: SparkSession, path: str, col: str = "text") -> DataFrame:
    """A text table with its counters derived from the text itself."""
    return (
        spark.read.parquet(path)
        .withColumn("n_chars", code_points(F.col(col)))
        .withColumn("utf8_bytes", utf8_bytes(F.col(col)))
    )


# Elements whose content is not visible, elements that may be
# editable regions, and block elements that end a line.
HIDDEN = ("script", "style", "textarea", "noscript", "template", "title")
EDITABLE = ("div", "p", "span", "section", "article", "li", "td", "pre", "h1", "h2", "h3")
BLOCK_END = r"(?i)<br[ /]*>|</(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer)>"
EDITING = r"\bcontenteditable(?:\s*=\s*(?:\"\"|''|\"true\"|'true'|true))?(?:[\s/][^>]*)?>"
AMPERSAND = "(?i)&(?:amp|#38|#x26);"
ENTITY = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def named_entities() -> dict[str, str]:
    """Named characters of HTML but the ampersand, which goes last; a fixed space is a space."""
    names = {name: chr(code) for name, code in name2codepoint.items()}
    return {k: v for k, v in (names | {"apos": "'", "nbsp": " "}).items() if k != "amp"}


def _character(entity: Column) -> Column:
    """The character an entity (without ``&`` and ``;``) stands for; null for unknown ones."""
    hexadecimal = F.rlike(entity, F.lit("^#[xX]"))
    code = F.when(hexadecimal, F.conv(F.substring(entity, 3, 6), 16, 10)).when(
        F.startswith(entity, F.lit("#")), F.substring(entity, 2, 7)
    )
    code = code.cast("bigint")
    # Surrogates, numbers beyond Unicode, NUL and the ampersand (which goes last) are no characters here.
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (code != 38)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    table = F.create_map(*[F.lit(x) for pair in named_entities().items() for x in pair])
    return F.when(code.isNull(), F.try_element_at(table, entity)).when(code == 160, " ").when(valid, char)


def decoded_entities(text: Column) -> Column:
    """Character references resolved, each kind that occurs once."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)))
    return F.regexp_replace(
        F.aggregate(
            found,
            text,
            lambda out, e: F.coalesce(F.replace(out, F.concat(F.lit("&"), e, F.lit(";")), _character(e)), out),
        ),
        AMPERSAND,
        "&",
    )


def visible_text(html: Column) -> Column:
    """Text a reader would select on a page.

    Comments, hidden elements and editable regions (up to the next end of an
    element of their name) go first, since a script may hold tags inside strings;
    then tags, then entities, '&amp;' last.
    """
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    for tag in EDITABLE:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*{EDITING}.*?</{tag}>", "")
    out = F.regexp_replace(out, BLOCK_END, "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    return normalized(decoded_entities(out))


def pages_to_requests(pages: DataFrame) -> DataFrame:
    """Crawled pages to translation requests; pages without text are dropped."""
    return (
        pages.select("page_id", "url", visible_text(F.col("html")).alias("text"))
        .filter(F.col("text") != "")
    )
