"""Translation calls, error classes, reconciliation, retry and resume."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa import limits
from glossa.functions.text import SPACE_CHARS, is_blank, trim_space

# Fixed value: the shape of an error code that may be shown as it is.
SAFE_CODE = r"\A[A-Z0-9_]{1,64}\z"


class TranslationError(Exception):
    """Raised by the called service to report a status or a code."""

    def __init__(self, message: str, code: str | None = None, status: int | None = None):
        super().__init__(message)
        self.code = code
        self.status = status

    def __reduce__(self):
        return type(self), (str(self), self.code, self.status)


def translate(
    batches: DataFrame,
    service: Callable[[str], str],
    keys: tuple[str, ...],
    max_response_chars: int = limits.MAX_RESPONSE_CHARS,
    parallelism: int | None = None,
) -> DataFrame:
    """Call an external service with ``text`` of every batch.

    Rows are dealt evenly over as many partitions as a shuffle has; ``parallelism``
    lowers the number of simultaneous calls where a service asks for it.  The outcome has ``state``, ``target``, ``code``,
    ``status`` and ``retryable`` per batch; one failing call fails one row.
    """
    key_fields = [f for f in batches.schema if f.name in keys]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields]
        + ["state string", "target string", "code string", "status int"]
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            outcomes = [_call(service, text, max_response_chars) for text in part["text"]]
            done = part[[f.name for f in key_fields]].reset_index(drop=True)
            done["state"] = ["failed" if code else "completed" for _, code, _ in outcomes]
            done["target"] = [target for target, _, _ in outcomes]
            done["code"] = [code for _, code, _ in outcomes]
            done["status"] = pd.array([status for _, _, status in outcomes], dtype="Int32")
            yield done

    tasks = parallelism or int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = batches.select(*[f.name for f in key_fields], "text").repartition(tasks)
    return spread.mapInPandas(run, schema).withColumn(
        "retryable", is_retryable(F.col("status"), F.col("code"))
    )


def _call(service, text, max_units):
    """(target, code, status) of one call."""
    try:
        output = service(text)
        if not isinstance(output, str):
            return None, "EMPTY_PAGE_RESPONSE", None
        if len(output.encode("utf-16-le", "surrogatepass")) // 2 > max_units:
            return None, "BATCH_OUTPUT_TOO_LARGE", None
        output = output.strip(SPACE_CHARS)
    except Exception as error:  # noqa: BLE001 - any failure of the callable is an outcome
        status = getattr(error, "status", None)
        code = getattr(error, "code", None) or (f"HTTP_{status}" if status else "JOB_FAILED")
        return None, code, status
    return (output, None, None) if output else (None, "EMPTY_PAGE_RESPONSE", None)


def is_retryable(status: Column, code: Column) -> Column:
    return F.coalesce(
        (status == 429) | status.between(500, 599), F.lit(False)
    ) | F.coalesce(F.rlike(code, F.lit(r"\AHTTP_(?:429|5[0-9]{2})\z")), F.lit(False))


def classify_errors(df: DataFrame, default_code: str = "JOB_FAILED", default_message: str = "failed") -> DataFrame:
    """Error code, retry flag and shortened texts from ``status, code, message, detail``."""
    code = (
        F.when(F.col("status").isNotNull(), F.concat(F.lit("HTTP_"), F.col("status").cast("string")))
        .when(F.coalesce(F.rlike("code", F.lit(SAFE_CODE)), F.lit(False)), F.col("code"))
        .otherwise(default_code)
    )
    return (
        df.withColumn("error_code", code)
        .withColumn("retryable", is_retryable(F.col("status"), F.col("error_code")))
        .withColumn(
            "message",
            F.when(is_blank(F.col("message")), default_message).otherwise(F.left("message", F.lit(500))),
        )
        .withColumn("detail", F.left(F.coalesce("detail", F.lit("")), F.lit(240)))
    )


def error_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("provider", "error_code").agg(
        F.count("*").alias("n_errors"), F.count_if("retryable").alias("n_retryable")
    )


def returned_pairs(responses: DataFrame) -> DataFrame:
    """Pairs found in each response, one row per array element.

    A response that is not a JSON array of ``{id, target}`` string pairs gives a
    single row with ``well_formed`` false.
    """
    raw = trim_space(F.col("response"))
    body = F.regexp_extract(raw, r"(?is)\A```(?:json)?\s*(.*?)\s*```\z", 1)
    text = F.when(F.startswith(raw, F.lit("```")), body).otherwise(raw)
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return (
        responses.select("batch_id", parsed.alias("_items"))
        .select("batch_id", F.explode_outer("_items").alias("_item"), F.size("_items").alias("_n"))
        .select(
            "batch_id",
            F.try_variant_get("_item", "$.id", "string").alias("block_id"),
            F.try_variant_get("_item", "$.target", "string").alias("target"),
            F.coalesce(
                F.schema_of_variant("_item") == "OBJECT<id: STRING, target: STRING>", F.lit(False)
            ).alias("well_formed"),
        )
    )


def reconcile_results(responses: DataFrame, requested: DataFrame) -> DataFrame:
    """Strict match of returned pairs with requested ids, all or nothing per batch.

    ``requested`` holds ``batch_id, block_id``.  Both sides are stacked and
    aggregated per (batch, id), which combines before the shuffle, instead of a
    full outer join on keys that may be hot.
    """
    asked = requested.select(
        "batch_id",
        "block_id",
        F.lit(1).alias("_asked"),
        F.lit(0).alias("_got"),
        F.lit(True).alias("well_formed"),
        F.lit(None).cast("string").alias("target"),
    )
    got = returned_pairs(responses).select(
        "batch_id", "block_id", F.lit(0).alias("_asked"), F.lit(1).alias("_got"), "well_formed", "target"
    )
    matched = asked.unionByName(got).groupBy("batch_id", "block_id").agg(
        F.sum("_asked").alias("_asked"),
        F.sum("_got").alias("_got"),
        F.bool_and("well_formed").alias("_ok"),
        F.max("target").alias("target"),
    ).withColumn(
        "_ok",
        F.col("_ok") & (F.col("_asked") == 1) & (F.col("_got") == 1) & ~is_blank(F.col("target")),
    )
    failed = (
        matched.groupBy("batch_id")
        .agg(F.bool_and("_ok").alias("_all"))
        .filter(~F.col("_all"))
        .select("batch_id", F.lit("INVALID_BATCH_RESPONSE").alias("error_code"))
    )
    rows = matched.filter(F.col("_asked") > 0).select("batch_id", "block_id", "target")
    joined = rows.join(failed, ["batch_id"], "left")
    return joined.select(
        "batch_id",
        "block_id",
        F.when(F.col("error_code").isNull(), F.col("target")).alias("target"),
        "error_code",
    )


def retry_plan(batches: DataFrame, pages: DataFrame) -> DataFrame:
    """Failed batches of the chosen pages go back to pending, others stay.

    The attempt number is kept; it rises when the batch is started again.
    """
    chosen = pages.select("job_id", "page_no").distinct().withColumn("_chosen", F.lit(True))
    joined = batches.join(chosen, ["job_id", "page_no"], "left")
    again = F.coalesce("_chosen", F.lit(False)) & (F.col("state") == "failed")
    return (
        joined.withColumn("retried", again)
        .withColumn("state", F.when(again, "pending").otherwise(F.col("state")))
        .withColumn("attempt_id", F.when(F.col("retried"), "").otherwise(F.col("attempt_id")))
        .withColumn("error_code", F.when(F.col("retried"), "").otherwise(F.col("error_code")))
        .withColumn("retryable", F.when(F.col("retried"), False).otherwise(F.col("retryable")))
        .drop("_chosen")
    )


def resume_set(batches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Batches still to do: no completed or failed outcome, in-flight work reset."""
    finished = outcomes.filter(F.col("state").isin("completed", "failed")).select("job_id", "batch_id")
    return batches.join(finished, ["job_id", "batch_id"], "left_anti").select(
        *[c for c in batches.columns if c not in ("state", "attempt_id", "partial")],
        F.lit("pending").alias("state"),
        F.lit("").alias("attempt_id"),
    )
