"""Rules for interactive requests: debounce, supersede, fresh context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import ordered

USER = ["user_id"]
ORDER = ["ts", "event_id"]


def debounce(events: DataFrame, gap: str = "320 milliseconds", segment_seconds: int = 86_400) -> DataFrame:
    """Last event before every quiet gap of a user."""
    nxt = ordered.next_row(
        events, USER, ORDER, ordered.time_segment(F.col("ts"), segment_seconds), ["ts"]
    )
    quiet = F.col("next_ts").isNull() | (F.col("next_ts") >= F.col("ts") + F.expr(f"interval {gap}"))
    return nxt.filter(quiet).drop("next_ts")


def debounce_stream(events: DataFrame, gap: str = "320 milliseconds", delay: str = "1 minute") -> DataFrame:
    """Streaming twin: a session per user closes after the gap and keeps its last event.

    In append mode a session is emitted once the watermark has passed its end,
    so the last sessions of a finished source stay open until a later event.
    """
    others = [c for c in events.columns if c not in ("user_id", "ts")]
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap).alias("_s"))
        .agg(F.max_by(F.struct("ts", *others), F.struct(*ORDER)).alias("_e"))
        .select("user_id", "_e.*")
    )


def supersede(requests: DataFrame, segment_seconds: int = 86_400) -> DataFrame:
    """Mark requests cancelled by the next one of the same user before they ended."""
    nxt = ordered.next_row(
        requests, USER, ORDER, ordered.time_segment(F.col("ts"), segment_seconds), ["ts"]
    )
    cut = F.coalesce(F.col("next_ts") < F.col("end_ts"), F.lit(False))
    return (
        nxt.withColumn("is_superseded", cut)
        .withColumn("end_ts", F.when(cut, F.col("next_ts")).otherwise(F.col("end_ts")))
        .drop("next_ts")
    )


def fresh_context(
    actions: DataFrame,
    contexts: DataFrame,
    max_age: str = "30 seconds",
    segment_seconds: int = 86_400,
) -> DataFrame:
    """Attach the latest context of the user to each action, if it is young enough.

    ``contexts`` holds ``user_id, ts, event_id, context``; a null context clears
    the memory.  An as-of join written as one ordered pass over both inputs.
    """
    both = actions.select(
        "user_id", "ts", "event_id", F.lit(True).alias("_act"), F.lit(None).cast("string").alias("context")
    ).unionByName(
        contexts.select("user_id", "ts", "event_id", F.lit(False).alias("_act"), F.col("context").cast("string"))
    )
    memory = F.when(~F.col("_act"), F.struct(F.col("ts").alias("at"), "context"))
    seen = ordered.running_last(
        both, USER, ORDER, ordered.time_segment(F.col("ts"), segment_seconds), memory, "_m"
    ).filter("_act")
    usable = (
        F.col("_m.context").isNotNull() & (F.col("ts") <= F.col("_m.at") + F.expr(f"interval {max_age}"))
    )
    return seen.select(
        "user_id",
        "ts",
        "event_id",
        F.when(usable, F.col("_m.context")).alias("context"),
        F.when(usable, F.col("_m.at")).alias("context_ts"),
        F.when(~F.coalesce(usable, F.lit(False)), "NO_FRESH_CONTEXT").alias("error_code"),
    )


def fresh_context_stream(
    actions: DataFrame, contexts: DataFrame, max_age: str = "30 seconds", delay: str = "1 minute"
) -> DataFrame:
    """Streaming twin: interval join within ``max_age``, then the latest context per action.

    Both sides carry a watermark, so join state older than the age is dropped, and an
    action that met no context comes out, rejected, once no context can come any more.
    Clearing contexts (null) take part in the join and win when they are latest.
    """
    a = actions.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id").withWatermark("ts", delay)
    c = contexts.select(
        F.col("user_id").alias("c_user"),
        F.col("ts").cast("timestamp").alias("c_ts"),
        F.col("event_id").alias("c_id"),
        "context",
    ).withWatermark("c_ts", delay)
    joined = a.join(
        c,
        (F.col("user_id") == F.col("c_user"))
        & (F.col("c_ts") <= F.col("ts"))
        & (F.col("ts") <= F.col("c_ts") + F.expr(f"interval {max_age}")),
        "leftOuter",
    )
    # A stream may carry one event-time column only: the context's becomes a number.
    plain = joined.select(
        "user_id", "ts", "event_id", F.struct(F.unix_micros("c_ts").alias("at"), "c_id").alias("_order"), "context"
    )
    latest = plain.groupBy("user_id", "ts", "event_id").agg(
        F.max_by(F.struct("context", F.col("_order.at").alias("at")), "_order").alias("_c")
    )
    usable = F.col("_c.context").isNotNull()
    return latest.select(
        "user_id",
        "ts",
        "event_id",
        F.col("_c.context").alias("context"),
        F.when(usable, F.timestamp_micros("_c.at")).alias("context_ts"),
        F.when(~usable, "NO_FRESH_CONTEXT").alias("error_code"),
    )
