"""State, progress and results derived from the job event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import ordered
from glossa.functions.text import round_half_up

BATCH = ["job_id", "batch_id"]
ORDER = ["ts", "event_id"]

# Event types that end an attempt and the state they lead to.
TERMINAL = {"BATCH_DONE": "completed", "BATCH_ERROR": "failed", "BATCH_CANCELLED": "cancelled"}


def with_attempts(events: DataFrame, segment_seconds: int = 86_400) -> DataFrame:
    """Number the attempts: an event belongs to the latest BATCH_STARTED before it."""
    started = F.when(F.col("event_type") == "BATCH_STARTED", 1).otherwise(0)
    return ordered.running_sums(
        events,
        BATCH,
        ORDER,
        ordered.time_segment(F.col("ts"), segment_seconds),
        {"attempt": started},
        totals={"current_attempt": "attempt"},
    )


def current_attempt_events(
    events: DataFrame, batches: DataFrame | None = None, segment_seconds: int = 86_400
) -> DataFrame:
    """Events of the latest attempt of each batch; stray and superseded ones are dropped.

    ``batches`` optionally restricts the log to known ``job_id, batch_id`` pairs.
    """
    log = with_attempts(events, segment_seconds)
    kept = log.filter((F.col("attempt") > 0) & (F.col("attempt") == F.col("current_attempt")))
    kept = kept.drop("current_attempt")
    if batches is not None:
        known = batches.select(*BATCH).distinct()
        kept = kept.join(known, BATCH, "left_semi")
    return kept


def batch_state(events: DataFrame, segment_seconds: int = 86_400) -> DataFrame:
    """State of every batch after the log; the first terminal event is final."""
    log = with_attempts(events, segment_seconds)
    state = F.lit(None).cast("string")
    for event, value in TERMINAL.items():
        state = F.when(F.col("event_type") == event, value).otherwise(state)
    current = (F.col("attempt") > 0) & (F.col("attempt") == F.col("current_attempt"))
    at = F.when(current & state.isNotNull(), F.struct(*ORDER))
    keys = [c for c in ("job_id", "batch_id", "page_no") if c in events.columns]
    return (
        log.groupBy(*keys)
        .agg(F.max("attempt").alias("attempt"), F.min_by(state, at).alias("_end"))
        .withColumn(
            "state",
            F.when(F.col("attempt") == 0, "pending").otherwise(F.coalesce("_end", F.lit("translating"))),
        )
        .drop("_end")
    )


def page_status(pages: DataFrame, batches: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Status per page: scanned, failed, translating, completed, cancelled, pending.

    ``jobs`` (``job_id, phase``) tells which jobs were cancelled: in those, a page with any
    cancelled batch counts as cancelled.
    """
    page = ["job_id", "page_no"]
    states = batches.groupBy(*page).agg(
        F.count("*").alias("n_batches"),
        *[F.count_if(F.col("state") == s).alias(f"_{s}") for s in ("failed", "translating", "completed", "cancelled")],
    )
    n = F.coalesce("n_batches", F.lit(0))
    joined = pages.join(states, page, "left")
    if jobs is None:
        stopped = F.lit(False)
    else:
        gone = jobs.filter("phase = 'cancelled'").select("job_id", F.lit(True).alias("_stopped")).distinct()
        joined = joined.join(gone, "job_id", "left")
        stopped = F.coalesce("_stopped", F.lit(False))
    return joined.select(
        *page,
        "is_scanned",
        n.cast("bigint").alias("n_batches"),
        F.when(F.col("is_scanned"), "scanned")
        .when(F.col("_failed") > 0, "failed")
        .when(F.col("_translating") > 0, "translating")
        .when(F.coalesce("_completed", F.lit(0)) == n, "completed")
        .when((F.col("_cancelled") == n) | (stopped & (F.col("_cancelled") > 0)), "cancelled")
        .otherwise("pending")
        .alias("status"),
    )


def job_progress(pages: DataFrame, batches: DataFrame) -> DataFrame:
    """Share of scanned and fully completed pages, in whole percent."""
    status = page_status(pages, batches)
    done = (F.col("status") == "scanned") | (
        (F.col("status") == "completed") & (F.col("n_batches") > 0)
    )
    return (
        status.groupBy("job_id")
        .agg(F.count("*").alias("n_pages"), F.count_if(done).alias("n_done"))
        .withColumn(
            "percent", round_half_up(F.col("n_done") * F.lit(100.0) / F.col("n_pages")).cast("bigint")
        )
    )


def job_settlement(batches: DataFrame) -> DataFrame:
    """Whether a job is settled, and how it ended."""
    open_ = F.col("state").isin("pending", "translating")
    return (
        batches.groupBy("job_id")
        .agg(
            F.count("*").alias("n_batches"),
            F.count_if(open_).alias("n_open"),
            F.count_if(F.col("state") == "failed").alias("n_failed"),
        )
        .withColumn("settled", F.col("n_open") == 0)
        .withColumn(
            "outcome",
            F.when(F.col("settled"), F.when(F.col("n_failed") > 0, "finished_with_errors").otherwise("completed")),
        )
    )


def sample_progress(
    events: DataFrame, tick: str = "64 milliseconds", segment_seconds: int = 86_400
) -> DataFrame:
    """Last progress value per tick and batch, only when longer than all before.

    Input: ``job_id, batch_id, ts, event_id, progress``.
    """
    ticks = (
        events.groupBy(*BATCH, F.window("ts", tick).alias("_w"))
        .agg(F.max_by("progress", F.struct(*ORDER)).alias("progress"))
        .select(*BATCH, F.col("_w.start").alias("tick_start"), "progress")
    )
    seen = ordered.running_extreme(
        ticks,
        BATCH,
        ["tick_start"],
        ordered.time_segment(F.col("tick_start"), segment_seconds),
        F.col("progress"),
        "_seen",
        largest=True,
        inclusive=False,
    )
    return seen.filter(F.col("progress") > F.coalesce("_seen", F.lit(0))).drop("_seen")


def bilingual_pairs(blocks: DataFrame, translations: DataFrame, view: str = "bilingual") -> DataFrame:
    """Source and target per block; a final target wins over a partial one.

    ``blocks``: ``doc_id, page_no, block_id, source``; ``translations``:
    ``doc_id, block_id, seq, target, is_final``.
    """
    best = translations.filter(F.length("target") > 0).groupBy("doc_id", "block_id").agg(
        F.max_by(F.struct("target", "is_final"), F.struct("is_final", "seq")).alias("_t")
    )
    pairs = blocks.join(best, ["doc_id", "block_id"], "left").select(
        "doc_id",
        "page_no",
        "block_id",
        "source",
        F.col("_t.target").alias("target"),
        F.when(F.col("_t").isNull(), "pending")
        .when(F.col("_t.is_final"), "final")
        .otherwise("partial")
        .alias("status"),
    )
    hidden = {"original": "target", "translated": "source", "bilingual": None}[view]
    return pairs.drop(hidden) if hidden else pairs
