"""Streaming sources and a runner for finite inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossa.schemas import JOB_EVENTS, STREAM_CHUNKS


def read_event_stream(
    spark: SparkSession,
    path: str,
    schema: str = JOB_EVENTS,
    fmt: str = "parquet",
    delay: str = "1 minute",
    files_per_trigger: int = 1_000,
    glob: str | None = None,
) -> DataFrame:
    """Job events as a stream with a watermark on ``ts``."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def read_chunk_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    delay: str = "1 minute",
    files_per_trigger: int = 1_000,
    schema: str = STREAM_CHUNKS,
) -> DataFrame:
    """Response chunks as a stream with a watermark on ``ts``, each chunk once.

    A chunk that is sent again (same request and number) within the watermark's delay is
    dropped by keyed state that ends with the delay; rows later than the watermark are
    dropped too, so a replay after that comes too late as well.  Rows without a request, a
    number or a time can't be placed and are dropped.  ``dropped_rows`` gives the counts.
    """
    chunks = read_event_stream(spark, path, schema, fmt, delay, files_per_trigger)
    placed = chunks.filter("request_id is not null and seq is not null and ts is not null")
    return placed.dropDuplicatesWithinWatermark(["request_id", "seq"])


def closing_chunk(at: datetime, request_id: int = -1) -> tuple:
    """A last row for a finite source: its time lets the watermark pass everything before ``at``."""
    return (request_id, 0, at, None)


def dropped_rows(query: StreamingQuery) -> dict[str, int]:
    """Rows that the stateful operators of a query have dropped so far: late ones and repeats."""
    late = repeats = 0
    for progress in query.recentProgress:
        for state in progress["stateOperators"]:
            late += state["numRowsDroppedByWatermark"]
            repeats += state.get("customMetrics", {}).get("numDroppedDuplicateRows", 0)
    return {"late": late, "repeats": repeats}


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available and write it as Parquet below ``out``.

    Append results go to the file sink (exactly once).  Complete results replace
    the table on every trigger.  Returns the ended query.
    """
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(
            lambda df, _: df.write.mode("overwrite").parquet(out)
        )
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
