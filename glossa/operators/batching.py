"""Batching, budgets and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa import limits
from glossa.functions import ordered
from glossa.functions.text import code_points, trim_space
from glossa.session import cut_lineage

JOINT = "\n\n"


def build_page_batches(blocks: DataFrame, max_chars: int = limits.MAX_BATCH_CHARS) -> DataFrame:
    """One batch per page from ``doc_id, page_no, block_ix, text``.

    Blank blocks are dropped, the others are joined by an empty line.  A page
    above the cap becomes a reject row; its size is known from a sum, so its
    text is never gathered.  What is gathered is bounded by ``max_chars``.
    """
    page = ["doc_id", "page_no"]
    clean = blocks.select(*page, "block_ix", trim_space(F.col("text")).alias("text")).filter(
        F.col("text") != ""
    )
    sizes = clean.groupBy(*page).agg(
        (F.sum(code_points(F.col("text"))) + (F.count("*") - 1) * len(JOINT)).alias("n_chars")
    )
    over = sizes.filter(F.col("n_chars") > max_chars)
    kept = clean.join(over.select(*page), page, "left_anti")
    batches = kept.groupBy(*page).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda b: b.text),
            JOINT,
        ).alias("text")
    )
    batch_id = F.concat(F.lit("p"), F.col("page_no"), F.lit("-page"))
    return batches.select(
        *page,
        batch_id.alias("batch_id"),
        "text",
        code_points(F.col("text")).alias("n_chars"),
        F.lit(None).cast("string").alias("error_code"),
    ).unionByName(
        over.select(
            *page,
            batch_id.alias("batch_id"),
            F.lit(None).cast("string").alias("text"),
            "n_chars",
            F.lit("PAGE_TEXT_TOO_LONG").alias("error_code"),
        )
    )


def build_requests(
    batches: DataFrame,
    system_prompt: str,
    user_template: str,
    object_style_providers: tuple[str, ...] = ("a",),
) -> DataFrame:
    """Add ``payload``: the two-message JSON body of a streaming chat request.

    ``user_template`` may use {language}, {content_type} and {text}.  Providers
    listed in ``object_style_providers`` switch reasoning off with an object,
    the others with a flag.  Columns ``provider, model, text`` are required,
    ``language`` and ``content_type`` are optional.
    """
    user: Column = F.lit(user_template)
    for name in ("language", "content_type"):
        value = F.coalesce(F.col(name), F.lit("")) if name in batches.columns else F.lit("")
        user = F.replace(user, F.lit("{" + name + "}"), value)
    # The text is placed last and once: placeholders inside it stay as they are.
    head = F.substring_index(user, "{text}", 1)
    tail = F.substring_index(user, "{text}", -1)
    user = F.when(F.contains(user, F.lit("{text}")), F.concat(head, F.col("text"), tail)).otherwise(user)
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    ).alias("messages")
    base = [F.col("model").alias("model"), messages, F.lit(True).alias("stream")]
    with_object = F.to_json(
        F.struct(*base, F.struct(F.lit("disabled").alias("type")).alias("thinking"))
    )
    with_flag = F.to_json(F.struct(*base, F.lit(False).alias("enable_thinking")))
    return batches.withColumn(
        "payload",
        F.when(F.col("provider").isin(*object_style_providers), with_object).otherwise(with_flag),
    )


_CODES = {
    "duplicate": "BATCH_ALREADY_EXISTS",
    "count": "JOB_BATCH_LIMIT",
    "chars": "JOB_TEXT_TOO_LONG",
    "bytes": "JOB_UTF8_TOO_LARGE",
}


def admit_batches(
    batches: DataFrame,
    max_batches: int = limits.MAX_JOB_BATCHES,
    max_chars: int = limits.MAX_JOB_CHARS,
    max_bytes: int = limits.MAX_JOB_BYTES,
    fold_rows: int = 4_000,
    segment_seconds: int = 86_400,
) -> DataFrame:
    """Arrival-order admission under per-job budgets.

    Input: ``job_id, batch_id, ts, seq, chars, bytes``; (ts, seq) orders a job.
    A rejected batch consumes nothing, so this is not a running sum.  Jobs of at
    most ``fold_rows`` rows are folded over one bounded array.  Larger jobs are
    settled in rounds: each round admits, with distributed running sums, the
    longest prefix that fits, drops what can no longer fit, and goes on behind
    the first row that did not fit, until no candidate is left.
    """
    cols = ["job_id", "batch_id", "ts", "seq", "chars", "bytes"]
    rows = batches.select(*cols)
    large = rows.groupBy("job_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > fold_rows)
    large = large.select("job_id")
    small_rows = rows.join(large, ["job_id"], "left_anti")
    folded = _admit_by_fold(small_rows, max_batches, max_chars, max_bytes)
    if large.isEmpty():
        return folded
    large_rows = cut_lineage(rows.join(large, ["job_id"], "left_semi"))
    return folded.unionByName(
        _admit_by_rounds(large_rows, max_batches, max_chars, max_bytes, segment_seconds)
    )


def _admit_by_fold(rows: DataFrame, max_batches: int, max_chars: int, max_bytes: int) -> DataFrame:
    entry = F.struct("ts", "seq", "batch_id", "chars", "bytes")
    start = F.expr(
        "named_struct('n', 0, 'c', 0L, 'b', 0L, 'seen', cast(array() as array<string>), "
        "'codes', cast(array() as array<string>))"
    )

    # The verdict is bound once per row (a one-element transform), otherwise its
    # conditions would be evaluated again for every field of the state.
    def advance(acc: Column, x: Column) -> Column:
        code = (
            F.when(F.array_contains(acc["seen"], x["batch_id"]), _CODES["duplicate"])
            .when(acc["n"] >= max_batches, _CODES["count"])
            .when(acc["c"] + x["chars"] > max_chars, _CODES["chars"])
            .when(acc["b"] + x["bytes"] > max_bytes, _CODES["bytes"])
            .otherwise("")
        )
        return F.get(
            F.transform(
                F.array(code),
                lambda k: F.struct(
                    (acc["n"] + F.when(k == "", 1).otherwise(0)).alias("n"),
                    (acc["c"] + F.when(k == "", x["chars"]).otherwise(F.lit(0).cast("bigint"))).alias("c"),
                    (acc["b"] + F.when(k == "", x["bytes"]).otherwise(F.lit(0).cast("bigint"))).alias("b"),
                    F.when(k == "", F.array_append(acc["seen"], x["batch_id"]))
                    .otherwise(acc["seen"])
                    .alias("seen"),
                    F.array_append(acc["codes"], k).alias("codes"),
                ),
            ),
            F.lit(0),
        )

    return (
        rows.groupBy("job_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
        .withColumn("_codes", F.aggregate("_rows", start, advance, lambda a: a["codes"]))
        .select("job_id", F.explode(F.arrays_zip("_rows", "_codes")).alias("_z"))
        .select(
            "job_id",
            *[F.col(f"_z._rows.{c}").alias(c) for c in ("batch_id", "ts", "seq", "chars", "bytes")],
            F.nullif(F.col("_z._codes"), F.lit("")).alias("error_code"),
        )
        .withColumn("admitted", F.col("error_code").isNull())
    )


def _admit_by_rounds(
    rows: DataFrame, max_batches: int, max_chars: int, max_bytes: int, segment_seconds: int
) -> DataFrame:
    order = ["ts", "seq"]
    segment = ordered.time_segment(F.col("ts"), segment_seconds)
    candidates = rows
    state = rows.select("job_id").distinct().select(
        "job_id", *[F.lit(0).cast("bigint").alias(c) for c in ("_n0", "_c0", "_b0")]
    )
    admitted: DataFrame | None = None
    while True:
        # Repeats of an id inside the coming prefix are duplicates, so only the
        # first candidate row of each id counts.
        first = (
            candidates.groupBy("job_id", "batch_id")
            .agg(F.min_by(F.struct("ts", "seq", "chars", "bytes"), F.struct(*order)).alias("_f"))
            .select("job_id", "batch_id", "_f.*")
        )
        run = ordered.running_sums(
            first,
            ["job_id"],
            order,
            segment,
            {"_n": F.lit(1), "_c": F.col("chars"), "_b": F.col("bytes")},
        )
        run = run.join(state, ["job_id"], "inner")
        misfit = (
            (F.col("_n0") + F.col("_n") > max_batches)
            | (F.col("_c0") + F.col("_c") > max_chars)
            | (F.col("_b0") + F.col("_b") > max_bytes)
        )
        run = cut_lineage(run.withColumn("_misfit", misfit))
        stop = run.groupBy("job_id").agg(
            F.min(F.when(F.col("_misfit"), F.struct(*order))).alias("_stop")
        )
        fits = run.join(stop, ["job_id"], "inner").filter(
            F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))
        )
        fits = fits.select("job_id", "batch_id", *order, "chars", "bytes")
        admitted = cut_lineage(fits if admitted is None else admitted.unionByName(fits))
        used = admitted.groupBy("job_id").agg(
            F.count("*").alias("_n0"), F.sum("chars").alias("_c0"), F.sum("bytes").alias("_b0")
        )
        state = cut_lineage(
            stop.join(used, "job_id", "left").select(
                "job_id", "_stop", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("_n0", "_c0", "_b0")]
            )
        )
        open_state = state.filter(F.col("_stop").isNotNull() & (F.col("_n0") < max_batches))
        left = candidates.join(open_state, ["job_id"], "inner").filter(
            (F.struct(*order) > F.col("_stop"))
            & (F.col("_c0") + F.col("chars") <= max_chars)
            & (F.col("_b0") + F.col("bytes") <= max_bytes)
        )
        left = left.select(*rows.columns).join(
            admitted.select("job_id", "batch_id"), ["job_id", "batch_id"], "left_anti"
        )
        candidates = cut_lineage(left)
        state = state.drop("_stop")
        if candidates.isEmpty():
            break

    taken = admitted.select("job_id", "batch_id", F.struct(*order).alias("_at"))
    marked = rows.join(taken, ["job_id", "batch_id"], "left")
    is_in = F.coalesce(F.col("_at") == F.struct(*order), F.lit(False))
    zero = F.lit(0).cast("bigint")
    run = ordered.running_sums(
        marked.withColumn("admitted", is_in),
        ["job_id"],
        order,
        segment,
        {
            "_n": F.when(F.col("admitted"), 1).otherwise(0),
            "_c": F.when(F.col("admitted"), F.col("chars")).otherwise(zero),
            "_b": F.when(F.col("admitted"), F.col("bytes")).otherwise(zero),
        },
    )
    return run.withColumn(
        "error_code",
        F.when(F.col("admitted"), F.lit(None).cast("string"))
        .when(F.struct(*order) > F.col("_at"), _CODES["duplicate"])
        .when(F.col("_n") >= max_batches, _CODES["count"])
        .when(F.col("_c") + F.col("chars") > max_chars, _CODES["chars"])
        .otherwise(_CODES["bytes"]),
    ).select("job_id", "batch_id", "ts", "seq", "chars", "bytes", "error_code", "admitted")


def queue_pressure(
    events: DataFrame,
    max_active: int = limits.MAX_ACTIVE_BATCHES,
    max_queued: int = limits.MAX_QUEUED_BATCHES,
    max_jobs: int = limits.MAX_ACTIVE_JOBS,
    segment_seconds: int = 86_400,
    global_seconds: int = 600,
) -> DataFrame:
    """Active and queued batches per job, and active jobs, after every event.

    Counters never fall below zero.  One pass gives both counters of a job and
    their values before each event; a second one adds up the jobs that open and
    close, over all jobs in segments of ``global_seconds``.
    """
    kind = F.col("event_type")
    ended = kind.isin("BATCH_DONE", "BATCH_ERROR", "BATCH_CANCELLED")
    order = ["ts", "event_id"]
    segment = ordered.time_segment(F.col("ts"), segment_seconds)
    deltas = events.select(
        "job_id",
        *order,
        "event_type",
        F.when(kind == "BATCH_STARTED", 1).when(ended, -1).otherwise(0).cast("bigint").alias("_da"),
        F.when(kind == "BATCH_QUEUED", 1).when(kind == "BATCH_STARTED", -1).otherwise(0).cast("bigint").alias("_dq"),
    )
    run = ordered.clamped_counters(
        deltas, ["job_id"], order, segment, {"active": F.col("_da"), "queued": F.col("_dq")}
    )
    opened = (F.col("active") > 0).cast("bigint") - (F.col("prev_active") > 0).cast("bigint")
    everywhere = ordered.time_segment(F.col("ts"), global_seconds)
    run = ordered.running_sums(run, [], order, everywhere, {"active_jobs": opened})
    return run.select(
        "job_id",
        *order,
        "event_type",
        "active",
        "queued",
        "active_jobs",
        (F.col("active") > max_active).alias("active_breach"),
        (F.col("queued") > max_queued).alias("queue_breach"),
        (F.col("active_jobs") > max_jobs).alias("jobs_breach"),
    )


def route_requests(requests: DataFrame, settings: DataFrame) -> DataFrame:
    """Choose provider ``a`` or ``b`` per request from the settings of its tenant.

    Whether ``settings`` is broadcast is left to the optimizer's size check.
    """
    joined = requests.join(settings, "tenant", "left")
    has_a = F.coalesce("has_a", F.lit(False))
    has_b = F.coalesce("has_b", F.lit(False))
    mode = F.coalesce("mode", F.lit("legacy_a_first"))
    image = F.col("kind") == "image"
    text_provider = (
        F.when(mode == "a", F.when(has_a, "a").otherwise(""))
        .when(mode == "b", F.when(has_b, "b").otherwise(""))
        .when(has_a, "a")
        .when(has_b, "b")
        .otherwise("")
    )
    provider = F.when(image, F.when(has_b, "b").otherwise("")).otherwise(text_provider)
    return (
        joined.withColumn("provider", provider)
        .withColumn(
            "error_code",
            F.when(F.col("provider") == "", F.when(~image & (mode == "a"), "A_KEY_MISSING").otherwise("B_KEY_MISSING")),
        )
        .drop("mode", "has_a", "has_b")
    )
