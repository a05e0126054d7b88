"""Sinks: bilingual HTML documents and request files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import escape_html, trim_space

# The exported page may use inline styles and data images only.
POLICY = "default-src 'none'; style-src 'unsafe-inline'; img-src data:; base-uri 'none'; form-action 'none'"
STYLE = (
    "body{font-family:sans-serif;margin:2rem auto;max-width:70rem}"
    ".pair{display:grid;grid-template-columns:1fr 1fr;gap:1rem}"
    ".text{white-space:pre-wrap}.pending{font-style:italic}"
)

LABELS = {
    "title_suffix": "bilingual",
    "source": "Source",
    "target": "Translation",
    "pending": "not translated yet",
    "empty_page": "no text on this page",
    "empty_document": "no pages",
    "page": "Page",
    "pages": "pages",
    "default_name": "document.html",
}


def safe_file_name(name: Column, default: str = LABELS["default_name"]) -> Column:
    """Replace characters no file system likes, strip trailing dots and blanks."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', "-")
    out = trim_space(F.regexp_replace(out, r"[. ]+\z", ""))
    return F.when(out == "", default).otherwise(out)


def page_sections(pages: DataFrame, pairs: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """One HTML section per page, with an empty marker for pages without blocks.

    ``pages``: ``doc_id, page_no, page_type``; ``pairs`` as made by
    ``bilingual_pairs`` plus ``block_ix``.  Only the blocks of one page, which
    admission keeps below the page limit, are gathered together.
    """
    shown = F.coalesce(F.col("target"), F.lit(""))
    article = F.concat(
        F.lit('<article class="pair" data-block="'),
        escape_html(F.col("block_id")),
        F.lit(f'"><div><h3>{labels["source"]}</h3><p class="text">'),
        escape_html(F.col("source")),
        F.lit(f'</p></div><div><h3>{labels["target"]}</h3>'),
        F.when(shown == "", F.lit(f'<p class="text pending">{labels["pending"]}'))
        .otherwise(F.concat(F.lit('<p class="text">'), escape_html(shown))),
        F.lit("</p></div></article>"),
    )
    bodies = (
        pairs.select("doc_id", "page_no", F.struct("block_ix", article.alias("html")).alias("_a"))
        .groupBy("doc_id", "page_no")
        .agg(F.array_sort(F.collect_list("_a")).alias("_as"))
        .select("doc_id", "page_no", F.array_join(F.col("_as.html"), "\n").alias("_body"))
    )
    return pages.join(bodies, ["doc_id", "page_no"], "left").select(
        "doc_id",
        "page_no",
        F.concat(
            F.lit('<section data-page="'),
            F.col("page_no").cast("string"),
            F.lit(f'"><h2>{labels["page"]} '),
            F.col("page_no").cast("string"),
            F.lit("</h2><p>"),
            escape_html(F.col("page_type")),
            F.lit("</p>\n"),
            F.coalesce("_body", F.lit(f'<p class="empty">{labels["empty_page"]}</p>')),
            F.lit("</section>"),
        ).alias("html"),
    )


def document_fragments(
    documents: DataFrame,
    pages: DataFrame,
    pairs: DataFrame,
    generated_at: str,
    labels: dict[str, str] = LABELS,
) -> DataFrame:
    """Rows ``doc_id, part_no, html``: head (0), one section per page, foot.

    In ``part_no`` order the fragments are the document, so a document of any
    length can be written without gathering it.
    """
    sections = page_sections(pages, pairs, labels)
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max("page_no").alias("_last"))
    named = documents.select("doc_id", F.coalesce("file_name", F.lit("")).alias("_name")).join(
        counts, "doc_id", "left"
    )
    n = F.coalesce("_n", F.lit(0))
    stem = F.regexp_replace("_name", r"(?i)\.pdf\z", "")
    title = escape_html(F.concat(stem, F.lit(f" - {labels['title_suffix']}")))
    head = F.concat(
        F.lit(
            '<!doctype html>\n<html><head><meta charset="utf-8">'
            f'<meta http-equiv="Content-Security-Policy" content="{POLICY}">'
            f"<style>{STYLE}</style><title>"
        ),
        title,
        F.lit("</title></head><body><header><h1>"),
        title,
        F.lit("</h1><p>"),
        escape_html(F.col("_name")),
        F.lit(" | "),
        n.cast("string"),
        F.lit(f" {labels['pages']} | {generated_at}</p></header>"),
        F.when(n == 0, f'<p class="empty">{labels["empty_document"]}</p>').otherwise(""),
    )
    heads = named.select("doc_id", F.lit(0).cast("bigint").alias("part_no"), head.alias("html"))
    feet = named.select(
        "doc_id",
        (F.coalesce("_last", F.lit(0)) + 1).cast("bigint").alias("part_no"),
        F.lit("</body></html>").alias("html"),
    )
    middle = sections.select("doc_id", F.col("page_no").cast("bigint").alias("part_no"), "html")
    return heads.unionByName(middle).unionByName(feet)


def whole_documents(fragments: DataFrame) -> DataFrame:
    """One HTML string per document, whatever its length.

    The string is one value, so a document must fit into a row here; ``write_bilingual_html``
    writes documents from their fragments and gathers none.
    """
    return (
        fragments.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("part_no", "html"))).alias("_p"))
        .select("doc_id", F.array_join(F.col("_p.html"), "\n").alias("html"))
    )


def write_bilingual_html(fragments: DataFrame, documents: DataFrame, path: str, buckets: int = 256) -> None:
    """Write ``path/bucket=<n>/document=<id>-<name>/part-*``; parts of a document sort by name.

    The id keeps documents of one name apart, and hashed buckets keep folders
    small.  Range partitioning keeps fragments in order and lets a long document
    span several part files.
    """
    key = F.col("doc_id")
    names = documents.select(
        "doc_id",
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"),
        F.concat(key.cast("string"), F.lit("-"), safe_file_name(F.col("file_name"))).alias("document"),
    )
    (
        fragments.join(names, "doc_id")
        .repartitionByRange("bucket", "document", "part_no")
        .sortWithinPartitions("bucket", "document", "part_no")
        .select("html", "bucket", "document")
        .write.mode("overwrite")
        .partitionBy("bucket", "document")
        .text(path)
    )


def write_requests_jsonl(requests: DataFrame, path: str) -> None:
    """One JSON request per line."""
    requests.select("payload").write.mode("overwrite").text(path)
