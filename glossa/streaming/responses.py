"""Assembling server-sent event responses from their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa import limits
from glossa.functions import ordered
from glossa.functions.text import trim_space, utf16_units, utf8_bytes

BREAK = "\n\n"


def stream_guards(
    chunks: DataFrame,
    max_bytes: int = limits.MAX_STREAM_BYTES,
    max_remainder: int = limits.MAX_REMAINDER_UNITS,
    segment_rows: int = 10_000,
) -> DataFrame:
    """Chunks with running sizes and the first breach of their request.

    Input ``request_id, seq, chunk``.  Adds ``run_bytes``, ``remainder`` (units
    after the last empty line so far), ``breach_seq`` and ``breach_code``.
    Streams may be far longer than allowed, so all of it runs on distributed
    running values; nothing is gathered per request.
    """
    keys, order = ["request_id"], ["seq"]
    segment = ordered.sequence_segment(F.col("seq"), segment_rows)
    df = chunks.withColumn("_text", _newlines(F.col("chunk")))
    df = df.withColumn("_end", F.right("_text", F.lit(1)))
    df = ordered.previous_row(df, keys, order, segment, ["_end"])
    df = ordered.running_sums(
        df, keys, order, segment, {"run_bytes": utf8_bytes(F.col("chunk")), "_run": utf16_units(F.col("_text"))}
    )
    # An empty line may straddle two chunks: look at the last character before.
    seen = F.concat(F.coalesce("prev__end", F.lit("")), F.col("_text"))
    after = F.substring_index(seen, BREAK, -1)
    boundary = F.when(F.contains(seen, F.lit(BREAK)), F.col("_run") - utf16_units(after))
    df = ordered.running_last(df, keys, order, segment, boundary, "_from")
    df = df.withColumn("remainder", F.col("_run") - F.coalesce("_from", F.lit(0)))
    code = F.when(F.col("run_bytes") > max_bytes, "STREAM_RESPONSE_TOO_LARGE").when(
        F.col("remainder") > max_remainder, "SSE_REMAINDER_TOO_LARGE"
    )
    df = df.withColumn("_code", code)
    first = (
        df.filter(F.col("_code").isNotNull())
        .groupBy("request_id")
        .agg(F.min(F.struct("seq", "_code")).alias("_b"))
        .select("request_id", F.col("_b.seq").alias("breach_seq"), F.col("_b._code").alias("breach_code"))
    )
    df = df.join(first, keys, "left")
    return df.drop("_text", "_end", "prev__end", "_run", "_from", "_code")


def _newlines(col: Column) -> Column:
    return F.regexp_replace(col, "\r\n|\r", "\n")


def frame_event(frame: Column) -> Column:
    """One frame as (kind, delta)."""
    lines = F.filter(F.split(frame, "\n"), lambda x: F.startswith(x, F.lit("data:")))
    data = trim_space(F.array_join(F.transform(lines, lambda x: F.ltrim(F.substr(x, F.lit(6)))), "\n"))

    def classify(d: Column) -> Column:
        payload = F.try_parse_json(d)
        error = F.get_json_object(d, "$.error")
        bare = (
            F.coalesce(F.get_json_object(d, "$.code"), F.lit("")).isin("", "0", "false")
            | (F.coalesce(F.get_json_object(d, "$.message"), F.lit("")).isin("", "0", "false"))
            | F.get_json_object(d, "$.choices").isNotNull()
        )
        content = F.try_variant_get(payload, "$.choices[0].delta.content", "variant")
        text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
        kind = (
            F.when(d == "", "skip")
            .when(d == "[DONE]", "done")
            .when(payload.isNull(), "bad")
            .when(~F.coalesce(error, F.lit("")).isin("", "0", "false") | ~bare, "upstream")
            .otherwise("delta")
        )
        return F.struct(kind.alias("kind"), F.coalesce(text, F.lit("")).alias("delta"))

    return F.get(F.transform(F.array(data), classify), F.lit(0))


def assemble_responses(
    chunks: DataFrame,
    max_bytes: int = limits.MAX_STREAM_BYTES,
    max_remainder: int = limits.MAX_REMAINDER_UNITS,
    max_output: int = limits.MAX_RESPONSE_CHARS,
) -> DataFrame:
    """Output text, end marker and error per request.

    Only chunks up to the first guard breach are gathered, so at most
    ``max_bytes`` per request meet in one row.
    """
    guarded = stream_guards(chunks, max_bytes, max_remainder)
    within = guarded.filter(
        F.col("breach_seq").isNull()
        | (F.col("seq") < F.col("breach_seq"))
        | ((F.col("seq") == F.col("breach_seq")) & (F.col("breach_code") != "STREAM_RESPONSE_TOO_LARGE"))
    ).filter(F.col("chunk") != "")
    whole = within.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("_c"),
        F.first("breach_code").alias("_breach"),
    )
    text = _newlines(F.regexp_replace(F.array_join(F.transform("_c", lambda c: c.chunk), ""), r"\A\x{FEFF}", ""))
    events = whole.select("request_id", "_breach", text.alias("_text")).withColumn(
        "_events", F.transform(F.split("_text", BREAK), frame_event)
    )
    stop = F.array_position(
        F.transform("_events", lambda e: e.kind.isin("done", "bad", "upstream")), True
    ).cast("int")
    events = events.withColumn("_stop", F.when(stop > 0, stop))
    taken = F.when(
        F.col("_stop").isNotNull(), F.slice("_events", F.lit(1), F.greatest(F.col("_stop") - 1, F.lit(0)))
    ).otherwise(F.col("_events"))
    events = events.withColumns(
        {
            "output": F.array_join(F.transform(taken, lambda e: e.delta), ""),
            "_kind": F.get("_events", F.col("_stop") - 1).kind,
        }
    )
    too_long = utf16_units(F.col("output")) > max_output
    return events.select(
        "request_id",
        F.when(~too_long, F.col("output")).alias("output"),
        F.coalesce(F.col("_kind") == "done", F.lit(False)).alias("is_done"),
        F.when(too_long, "STREAM_OUTPUT_TOO_LARGE")
        .when(F.col("_kind") == "bad", "INVALID_STREAM_DATA")
        .when(F.col("_kind") == "upstream", "UPSTREAM_STREAM_ERROR")
        .when(F.coalesce(F.col("_kind"), F.lit("")) != "done", F.col("_breach"))
        .alias("error_code"),
    )


def completion_verdict(responses: DataFrame) -> DataFrame:
    """``complete`` or the reason why a response cannot be used."""
    return responses.withColumn(
        "verdict",
        F.coalesce(
            F.col("error_code"),
            F.when(~F.col("is_done"), "INCOMPLETE_STREAM")
            .when(F.col("output") == "", "EMPTY_COMPLETION")
            .otherwise("complete"),
        ),
    )


def stream_timeouts(
    chunks: DataFrame,
    requests: DataFrame,
    header_s: int = limits.HEADER_TIMEOUT_S,
    first_content_s: int = limits.FIRST_CONTENT_TIMEOUT_S,
    idle_s: int = limits.IDLE_TIMEOUT_S,
    total_s: int = limits.TOTAL_TIMEOUT_S,
    segment_seconds: int = 3_600,
) -> DataFrame:
    """The timer that fires first per request, or null.

    ``requests``: ``request_id, sent_at``; ``chunks``: ``request_id, seq, ts,
    is_content, is_end``.  The response starts with the first chunk; the idle
    timer runs from content to content (or to the end of the stream).
    """
    keys, order = ["request_id"], ["ts", "seq"]
    marks = chunks.filter(F.col("is_content") | F.col("is_end"))
    marks = ordered.next_row(
        marks, keys, order, ordered.time_segment(F.col("ts"), segment_seconds), ["ts"]
    )
    idle = F.expr(f"interval {idle_s} seconds")
    silent = F.col("is_content") & ~F.col("is_end") & (
        F.col("next_ts").isNull() | (F.col("next_ts") > F.col("ts") + idle)
    )
    per_mark = marks.groupBy("request_id").agg(
        F.min(F.when(F.col("is_content"), F.col("ts"))).alias("_content"),
        F.min(F.when(F.col("is_end"), F.col("ts"))).alias("_end"),
        F.min(F.when(silent, F.col("ts") + idle)).alias("_idle"),
    )
    starts = chunks.groupBy("request_id").agg(F.min("ts").alias("_head"))
    df = requests.select("request_id", "sent_at").join(starts, "request_id", "left").join(
        per_mark, "request_id", "left"
    )

    def after(col: str, seconds: int) -> Column:
        return F.col(col) + F.expr(f"interval {seconds} seconds")

    def late(event: str, deadline: Column) -> Column:
        return F.col(event).isNull() | (F.col(event) > deadline)

    timers = [
        (late("_end", after("sent_at", total_s)), after("sent_at", total_s), "REQUEST_TOTAL_TIMEOUT"),
        (late("_head", after("sent_at", header_s)), after("sent_at", header_s), "RESPONSE_HEADER_TIMEOUT"),
        (
            F.col("_head").isNotNull()
            & late("_content", after("_head", first_content_s))
            & late("_end", after("_head", first_content_s)),
            after("_head", first_content_s),
            "FIRST_CONTENT_TIMEOUT",
        ),
        (F.col("_idle").isNotNull(), F.col("_idle"), "STREAM_TIMEOUT"),
    ]
    fired = F.array_min(
        F.array_compact(
            F.array(
                *[
                    F.when(cond, F.struct(at.alias("at"), F.lit(rank).alias("rank"), F.lit(code).alias("code")))
                    for rank, (cond, at, code) in enumerate(timers)
                ]
            )
        )
    )
    # A timer that would fire after the stream ended never does.
    df = df.withColumn("_f", fired)
    live = F.col("_end").isNull() | (F.col("_f.at") < F.col("_end"))
    return df.select(
        "request_id",
        F.when(live, F.col("_f.code")).alias("error_code"),
        F.when(live, F.col("_f.at")).alias("fired_at"),
    )
