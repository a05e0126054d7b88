"""Bindings of generic tables (documents, conversations, events) to domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import sha256_hex


def conversation_blocks(conversations: DataFrame) -> DataFrame:
    """Batch = conversation, block = turn; some ids are damaged on purpose."""
    return conversations.select(
        F.col("conv_id").alias("batch_id"),
        F.col("turn").alias("block_ix"),
        F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 1), "-bad")
        .when((F.col("conv_id") % 13 == 0) & (F.col("turn") == 2), "t0")
        .otherwise(F.concat(F.lit("t"), F.col("turn")))
        .alias("block_id"),
        "text",
    )


def document_jobs(documents: DataFrame) -> DataFrame:
    """One job request per document; some are damaged on purpose."""
    digest = sha256_hex(F.col("text"))
    return documents.select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 17 == 0, "_job")
        .otherwise(F.concat(F.lit("job:"), digest))
        .alias("job_id"),
        F.when(F.col("doc_id") % 19 == 0, "short").otherwise(F.upper(digest)).alias("fingerprint"),
        F.floor(F.length("text") / 40).cast("bigint").alias("page_count"),
    )


def hard_wrapped(documents: DataFrame) -> DataFrame:
    """Documents with words of eight letters and more broken over two lines."""
    return documents.select(
        "doc_id", F.regexp_replace("text", r"([\p{L}]{5})([\p{L}]{3})", "$1-\n$2").alias("text")
    )


EVENT_MAP = {
    "click": "BATCH_STARTED",
    "view": "BATCH_PROGRESS",
    "purchase": "BATCH_DONE",
    "error": "BATCH_ERROR",
    "signup": "BATCH_CANCELLED",
}


def job_events(events: DataFrame, event_map: dict[str, str] = EVENT_MAP) -> DataFrame:
    """Job log: job = user, batch = ``props.k``, ten batches per page."""
    kind = F.lit(None).cast("string")
    for raw, mapped in event_map.items():
        kind = F.when(F.col("event_type") == raw, mapped).otherwise(kind)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("user_id").alias("job_id"),
        k.alias("batch_id"),
        (F.floor(k / 10) + 1).cast("bigint").alias("page_no"),
        "ts",
        "event_id",
        kind.alias("event_type"),
        "value",
    )


def job_pages(log: DataFrame) -> DataFrame:
    """Pages seen in the log and one more of each job, which has no batches; one in ten counts as scanned."""
    seen = log.select("job_id", "page_no")
    empty = log.select("job_id", F.lit(1_000).cast("bigint").alias("page_no"))
    return seen.unionByName(empty).distinct().withColumn(
        "is_scanned", (F.col("job_id") + F.col("page_no")) % 10 == 0
    )


def admission_rows(events: DataFrame) -> DataFrame:
    log = job_events(events)
    return log.select(
        "job_id",
        F.col("batch_id").cast("string").alias("batch_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.floor(F.col("value") * 10).cast("bigint").alias("chars"),
        (F.floor(F.col("value") * 10) + F.col("event_id") % 7).cast("bigint").alias("bytes"),
    )


def page_blocks(conversations: DataFrame) -> DataFrame:
    """Document = conversation, two turns per page, block = turn."""
    return conversations.select(
        F.col("conv_id").alias("doc_id"),
        (F.floor(F.col("turn") / 2) + 1).cast("bigint").alias("page_no"),
        F.col("turn").alias("block_ix"),
        F.concat(F.lit("b"), F.col("turn").cast("string")).alias("block_id"),
        F.col("text").alias("source"),
        "text",
        "role",
    )


def stub_translations(conversations: DataFrame) -> DataFrame:
    """Reversed text; some rows missing, some only partial."""
    key = F.col("conv_id") + F.col("turn")
    full = conversations.filter(key % 7 != 0).select(
        F.col("conv_id").alias("doc_id"),
        F.concat(F.lit("b"), F.col("turn").cast("string")).alias("block_id"),
        F.lit(2).cast("bigint").alias("seq"),
        F.reverse("text").alias("target"),
        (key % 5 != 0).alias("is_final"),
    )
    partial = full.select(
        "doc_id", "block_id", F.lit(1).cast("bigint").alias("seq"), F.left("target", F.lit(20)).alias("target"),
        F.lit(False).alias("is_final"),
    )
    return full.unionByName(partial)


#: Turns sent in one batch.
TURNS_PER_BATCH = 64


def turn_batch() -> Column:
    """Batch of a turn: a conversation is sent in runs of ``TURNS_PER_BATCH`` turns."""
    return F.concat_ws("-", "conv_id", F.floor(F.col("turn") / TURNS_PER_BATCH))


def answered_batches(conversations: DataFrame) -> DataFrame:
    """One JSON answer per batch of turns; by ``conv_id % 5`` fenced, or the first batch damaged in three ways."""
    sent = conversations.withColumn("batch_id", turn_batch())
    kind = F.col("conv_id") % 5
    entry = F.struct(
        F.when((kind == 3) & (F.col("turn") == 0), "zzz")
        .when((kind == 2) & (F.col("turn") == 1), "b0")
        .otherwise(F.concat(F.lit("b"), F.col("turn").cast("string")))
        .alias("id"),
        F.reverse("text").alias("target"),
    )
    body = (
        sent.filter(~((kind == 1) & (F.col("turn") == 0)))
        .groupBy("conv_id", "batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))).alias("_es"))
        .select("conv_id", "batch_id", F.to_json(F.col("_es.e")).alias("_json"))
    )
    return body.select(
        "batch_id",
        F.when(F.col("conv_id") % 5 == 4, F.concat(F.lit("```json\n"), F.col("_json"), F.lit("\n```")))
        .otherwise(F.col("_json"))
        .alias("response"),
    )


#: A turn and a chunk within it make one sequence number: a string has fewer than 2^31 characters.
LAST_TURN = 2**31 - 1
CHUNKS_PER_TURN = 2**32


def response_chunks(conversations: DataFrame, size: int = 17) -> DataFrame:
    """Event-stream text of each conversation, one frame per turn, cut into small chunks.

    A frame opens with the empty line that ends the frame before it, so chunk
    borders fall inside frames and inside breaks.  Damages by ``conv_id``: bad
    JSON (% 7 = 3), upstream error (% 11 = 4), no content (% 13 = 6), end marker
    missing (% 6 = 5).
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    content = F.when(conv % 13 == 6, "").otherwise(F.col("text"))
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("delta"))).alias("choices")))
    data = (
        F.when((conv % 7 == 3) & (turn == 1), "{oops")
        .when((conv % 11 == 4) & (turn == 1), '{"error":{"message":"overloaded"}}')
        .otherwise(payload)
    )
    frames = conversations.select(
        conv.alias("request_id"),
        turn.alias("turn"),
        F.concat(F.when(turn > 0, "\n\n").otherwise(""), F.lit("data: "), data).alias("frame"),
    )
    # The end marker is a frame of its own behind every turn a conversation can have.
    ends = conversations.filter((turn == 0) & (conv % 6 != 5)).select(
        conv.alias("request_id"), F.lit(LAST_TURN).cast("bigint").alias("turn"), F.lit("\n\ndata: [DONE]\n\n").alias("frame")
    )
    cut = frames.unionByName(ends).select(
        "request_id", "turn", F.posexplode(F.regexp_extract_all("frame", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("_i", "chunk")
    )
    return cut.select("request_id", (F.col("turn") * CHUNKS_PER_TURN + F.col("_i")).alias("seq"), "chunk")


#: More days than dates have.
DAYS = 10_000_000


def timed_chunks(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests = (user, day) with a day squeezed into 288 seconds."""
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    scaled = F.timestamp_micros(
        F.unix_micros(origin.cast("timestamp"))
        + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(origin.cast("timestamp"))) / 300).cast("bigint")
    )
    chunks = events.select(
        (F.col("user_id") * DAYS + day).alias("request_id"),
        F.col("event_id").alias("seq"),
        scaled.alias("ts"),
        (F.col("event_type") != "error").alias("is_content"),
        (F.col("event_type") == "error").alias("is_end"),
    )
    sent = F.timestamp_micros(F.unix_micros(origin.cast("timestamp")) + (F.col("request_id") % DAYS) * 288_000_000)
    requests = chunks.select("request_id").distinct().select("request_id", sent.alias("sent_at"))
    return chunks, requests


def regions_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Image regions on a 1280 x 800 viewport at device scale 2."""
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("region_id"),
        (F.col("l_quantity") * 20).alias("left"),
        (F.col("l_discount") * 5000).alias("top"),
        (F.col("l_extendedprice") / 50).alias("width"),
        (F.col("l_tax") * 10000).alias("height"),
        F.lit(1280.0).alias("viewport_width"),
        F.lit(800.0).alias("viewport_height"),
        F.lit(2560.0).alias("bitmap_width"),
        F.lit(1600.0).alias("bitmap_height"),
    )
