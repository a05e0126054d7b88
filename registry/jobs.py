"""Queries over the job event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import batching as B
from glossa.operators import execution as X
from glossa.operators import progress as E
from glossa.operators.queueing import admit_queue
from glossa.plans import bindings
from registry.common import table

QUERIES = {}
ORACLES = {}

EV = """ev AS (SELECT user_id AS job_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS batch_id,
  CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) // 10 + 1 AS page_no, ts, event_id,
  CASE event_type WHEN 'click' THEN 'BATCH_STARTED' WHEN 'view' THEN 'BATCH_PROGRESS' WHEN 'purchase' THEN 'BATCH_DONE'
    WHEN 'error' THEN 'BATCH_ERROR' WHEN 'signup' THEN 'BATCH_CANCELLED' END AS event_type, value FROM events)"""
AT = """att AS (SELECT *, CAST(sum(CASE WHEN event_type = 'BATCH_STARTED' THEN 1 ELSE 0 END)
    OVER (PARTITION BY job_id, batch_id ORDER BY ts, event_id) AS BIGINT) AS attempt,
  CAST(sum(CASE WHEN event_type = 'BATCH_STARTED' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, batch_id) AS BIGINT)
    AS current_attempt FROM ev)"""
BS = """bs AS (SELECT job_id, batch_id, page_no, max(attempt) AS attempt,
  CASE WHEN max(attempt) = 0 THEN 'pending' ELSE coalesce(arg_min(
    CASE event_type WHEN 'BATCH_DONE' THEN 'completed' WHEN 'BATCH_ERROR' THEN 'failed'
      WHEN 'BATCH_CANCELLED' THEN 'cancelled' END, (ts, event_id))
    FILTER (attempt > 0 AND attempt = current_attempt
      AND event_type IN ('BATCH_DONE', 'BATCH_ERROR', 'BATCH_CANCELLED')), 'translating') END AS state
  FROM att GROUP BY job_id, batch_id, page_no)"""
PG = """pg AS (SELECT DISTINCT job_id, page_no, (job_id + page_no) % 10 = 0 AS is_scanned
  FROM (SELECT job_id, page_no FROM ev UNION ALL SELECT job_id, 1000 FROM ev))"""
PS = """ps AS (SELECT pg.job_id, pg.page_no, is_scanned, count(state) AS n_batches,
  CASE WHEN is_scanned THEN 'scanned' WHEN count(*) FILTER (state = 'failed') > 0 THEN 'failed'
    WHEN count(*) FILTER (state = 'translating') > 0 THEN 'translating'
    WHEN count(*) FILTER (state = 'completed') = count(state) THEN 'completed'
    WHEN count(*) FILTER (state = 'cancelled') = count(state) THEN 'cancelled' ELSE 'pending' END AS status
  FROM pg LEFT JOIN sent USING (job_id, page_no) GROUP BY pg.job_id, pg.page_no, is_scanned)"""
SENT = "sent AS (SELECT * FROM bs)"


def _log(spark, d):
    return bindings.job_events(table(spark, d, "events"))


def _states(spark, d):
    return E.batch_state(_log(spark, d))


def _pages(spark, d):
    return bindings.job_pages(_log(spark, d))


QUERIES["current_attempt_events"] = lambda spark, d: E.current_attempt_events(
    _log(spark, d), _states(spark, d)
).select("job_id", "batch_id", "ts", "event_id", "event_type", "attempt")
ORACLES["current_attempt_events"] = f"""WITH {EV}, {AT}, {BS}
SELECT job_id, batch_id, ts, event_id, event_type, att.attempt FROM att SEMI JOIN bs
USING (job_id, batch_id) WHERE att.attempt > 0 AND att.attempt = current_attempt"""

QUERIES["batch_state"] = _states
ORACLES["batch_state"] = f"WITH {EV}, {AT}, {BS} SELECT job_id, batch_id, page_no, attempt, state FROM bs"

QUERIES["page_status"] = lambda spark, d: E.page_status(_pages(spark, d), _states(spark, d))
ORACLES["page_status"] = (
    f"WITH {EV}, {AT}, {BS}, {SENT}, {PG}, {PS} SELECT job_id, page_no, is_scanned, n_batches, status FROM ps"
)

QUERIES["job_progress"] = lambda spark, d: E.job_progress(_pages(spark, d), _states(spark, d))
ORACLES["job_progress"] = f"""WITH {EV}, {AT}, {BS}, {SENT}, {PG}, {PS},
t AS (SELECT job_id, count(*) AS n_pages,
  count(*) FILTER (status = 'scanned' OR (status = 'completed' AND n_batches > 0)) AS n_done FROM ps GROUP BY job_id)
SELECT job_id, n_pages, n_done, CAST(floor(n_done * 100.0::DOUBLE / n_pages + 0.5) AS BIGINT) AS percent FROM t"""

QUERIES["job_settlement"] = lambda spark, d: E.job_settlement(_states(spark, d))
ORACLES["job_settlement"] = f"""WITH {EV}, {AT}, {BS}, {SENT},
t AS (SELECT job_id, count(*) AS n_batches, count(*) FILTER (state IN ('pending', 'translating')) AS n_open,
  count(*) FILTER (state = 'failed') AS n_failed FROM sent GROUP BY job_id)
SELECT *, n_open = 0 AS settled, CASE WHEN n_open = 0 THEN
  CASE WHEN n_failed > 0 THEN 'finished_with_errors' ELSE 'completed' END END AS outcome FROM t"""

QUERIES["sample_progress"] = lambda spark, d: E.sample_progress(
    _log(spark, d).filter("event_type = 'BATCH_PROGRESS'").select(
        "job_id", (F.col("batch_id") % 2).alias("batch_id"), "ts", "event_id", F.col("value").alias("progress")
    ),
    "6 hours",
).select("job_id", "batch_id", F.col("tick_start").cast("timestamp_ntz").alias("tick_start"), "progress")
ORACLES["sample_progress"] = f"""WITH {EV},
t AS (SELECT job_id, batch_id % 2 AS batch_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS tick_start,
  arg_max(value, (ts, event_id)) AS progress FROM ev WHERE event_type = 'BATCH_PROGRESS' GROUP BY ALL),
s AS (SELECT *, max(progress) OVER (PARTITION BY job_id, batch_id ORDER BY tick_start
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t)
SELECT job_id, batch_id, tick_start, progress FROM s WHERE progress > coalesce(seen, 0)"""

# --- budgets ------------------------------------------------------------------

CAPS = (25, 6_000, 6_100)

QUERIES["admit_batches"] = lambda spark, d: B.admit_batches(
    bindings.admission_rows(table(spark, d, "events")), *CAPS
)
ORACLES["admit_batches"] = f"""WITH RECURSIVE {EV},
o AS (SELECT job_id, CAST(batch_id AS VARCHAR) AS batch_id, ts, event_id AS seq, CAST(floor(value * 10) AS BIGINT) AS chars,
  CAST(floor(value * 10) + event_id % 7 AS BIGINT) AS bytes,
  row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM ev),
f AS (
  SELECT job_id, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS c, 0::BIGINT AS b, CAST([] AS VARCHAR[]) AS seen,
    CAST(NULL AS VARCHAR) AS code FROM (SELECT DISTINCT job_id FROM o)
  UNION ALL
  SELECT job_id, i, CASE WHEN k = '' THEN n + 1 ELSE n END, CASE WHEN k = '' THEN c + chars ELSE c END,
    CASE WHEN k = '' THEN b + bytes ELSE b END, CASE WHEN k = '' THEN list_append(seen, batch_id) ELSE seen END, k
  FROM (SELECT f.job_id, o.i, n, c, b, seen, chars, bytes, batch_id,
      CASE WHEN list_contains(seen, batch_id) THEN 'BATCH_ALREADY_EXISTS' WHEN n >= {CAPS[0]} THEN 'JOB_BATCH_LIMIT'
        WHEN c + chars > {CAPS[1]} THEN 'JOB_TEXT_TOO_LONG' WHEN b + bytes > {CAPS[2]} THEN 'JOB_UTF8_TOO_LARGE'
        ELSE '' END AS k FROM f JOIN o ON o.job_id = f.job_id AND o.i = f.i + 1))
SELECT o.job_id, batch_id, ts, seq, chars, bytes, nullif(f.code, '') AS error_code, f.code = '' AS admitted
FROM f JOIN o USING (job_id, i)"""

PRESSURE_MAP = dict(bindings.EVENT_MAP, view="BATCH_QUEUED")
QUEUE_LIMIT = 3
ARRIVALS = ("BATCH_STARTED", "BATCH_PROGRESS")

QUERIES["admit_queue"] = lambda spark, d: admit_queue(
    _log(spark, d).select(
        "job_id", "batch_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").isin(*ARRIVALS).alias("arrives")
    ),
    QUEUE_LIMIT,
)
ORACLES["admit_queue"] = f"""WITH RECURSIVE {EV},
o AS (SELECT job_id, batch_id, ts, event_id, event_type IN {ARRIVALS} AS arrives,
  row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM ev),
q AS (SELECT job_id, 1::BIGINT AS rn, 0::BIGINT AS queued FROM o WHERE rn = 1
  UNION ALL SELECT q.job_id, q.rn + 1, CASE WHEN arrives THEN least(queued + 1, {QUEUE_LIMIT}) ELSE greatest(queued - 1, 0) END
  FROM q JOIN o USING (job_id, rn))
SELECT job_id, batch_id, ts, event_id AS seq, queued, CASE WHEN queued >= {QUEUE_LIMIT} THEN 'JOB_QUEUE_FULL' END AS error_code,
  queued < {QUEUE_LIMIT} AS admitted FROM o JOIN q USING (job_id, rn) WHERE arrives"""

QUERIES["queue_pressure"] = lambda spark, d: B.queue_pressure(
    bindings.job_events(table(spark, d, "events"), PRESSURE_MAP), 3, 4, 60
)
ORACLES["queue_pressure"] = f"""WITH {EV},
d AS (SELECT job_id, ts, event_id, CASE event_type WHEN 'BATCH_PROGRESS' THEN 'BATCH_QUEUED' ELSE event_type END
    AS event_type,
  CASE event_type WHEN 'BATCH_STARTED' THEN 1 WHEN 'BATCH_PROGRESS' THEN 0 ELSE -1 END AS da,
  CASE event_type WHEN 'BATCH_PROGRESS' THEN 1 WHEN 'BATCH_STARTED' THEN -1 ELSE 0 END AS dq FROM ev),
r AS (SELECT *, sum(da) OVER w AS ra, sum(dq) OVER w AS rq FROM d
  WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
c AS (SELECT *, CAST(ra - least(min(ra) OVER w, 0) AS BIGINT) AS active, CAST(rq - least(min(rq) OVER w, 0) AS BIGINT)
    AS queued FROM r WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
p AS (SELECT *, (active > 0)::INT - (coalesce(lag(active) OVER (PARTITION BY job_id ORDER BY ts, event_id), 0) > 0)::INT
    AS opened FROM c),
j AS (SELECT *, CAST(sum(opened) OVER (ORDER BY ts, event_id) AS BIGINT) AS active_jobs FROM p)
SELECT job_id, ts, event_id, event_type, active, queued, active_jobs, active > 3 AS active_breach,
  queued > 4 AS queue_breach, active_jobs > 60 AS jobs_breach FROM j"""

# --- errors, retry, resume ------------------------------------------------------


def _errors(spark, d):
    e = F.col("event_id")
    status = (
        F.when(e % 6 == 1, 401).when(e % 6 == 2, 403).when(e % 6 == 3, 429).when(e % 6 == 4, 500).when(e % 6 == 5, 418)
    )
    code = F.when(e % 4 == 0, F.upper("event_type")).when(e % 4 == 1, "not safe").when(e % 4 == 2, "HTTP_503")
    return X.classify_errors(
        table(spark, d, "events").select(
            "event_id",
            F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"),
            status.alias("status"),
            code.alias("code"),
            F.when(e % 9 == 0, "  ").otherwise(F.repeat("props", F.lit(60))).alias("message"),
            F.repeat("event_type", F.lit(50)).alias("detail"),
        )
    )


SQL_ERRORS = """
e AS (SELECT event_id, 'p' || (user_id % 3) AS provider,
  CASE event_id % 6 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 418 END AS status,
  CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN 'not safe' WHEN 2 THEN 'HTTP_503' END AS code,
  CASE WHEN event_id % 9 = 0 THEN '  ' ELSE repeat(props, 60) END AS message, repeat(event_type, 50) AS detail FROM events),
c AS (SELECT *, CASE WHEN status IS NOT NULL THEN 'HTTP_' || status WHEN regexp_full_match(code, '[A-Z0-9_]{1,64}')
    THEN code ELSE 'JOB_FAILED' END AS error_code FROM e),
k AS (SELECT event_id, provider, error_code,
  coalesce(status = 429 OR status BETWEEN 500 AND 599, false) OR regexp_full_match(error_code, 'HTTP_(429|5[0-9]{2})')
    AS retryable,
  CASE WHEN trim(message) = '' THEN 'failed' ELSE left(message, 500) END AS message, left(detail, 240) AS detail FROM c)"""

QUERIES["classify_errors"] = lambda spark, d: _errors(spark, d).select(
    "event_id", "provider", "error_code", "retryable", "message", "detail"
)
ORACLES["classify_errors"] = f"WITH {SQL_ERRORS} SELECT * FROM k"
QUERIES["error_summary"] = lambda spark, d: X.error_summary(_errors(spark, d))
ORACLES["error_summary"] = f"""WITH {SQL_ERRORS} SELECT provider, error_code, count(*) AS n_errors,
  count(*) FILTER (retryable) AS n_retryable FROM k GROUP BY provider, error_code"""


def _batch_table(spark, d):
    return _states(spark, d).select(
        "job_id",
        "batch_id",
        "page_no",
        "state",
        "attempt",
        F.concat(F.lit("a"), F.col("attempt").cast("string")).alias("attempt_id"),
        F.when(F.col("state") == "failed", "HTTP_429").otherwise("").alias("error_code"),
        (F.col("state") == "failed").alias("retryable"),
    )


SQL_BT = """bt AS (SELECT job_id, batch_id, page_no, state, attempt, 'a' || attempt AS attempt_id,
  CASE WHEN state = 'failed' THEN 'HTTP_429' ELSE '' END AS error_code, state = 'failed' AS retryable FROM bs)"""

QUERIES["retry_plan"] = lambda spark, d: X.retry_plan(
    _batch_table(spark, d), _pages(spark, d).filter("not is_scanned and page_no <= 6")
)
ORACLES["retry_plan"] = f"""WITH {EV}, {AT}, {BS}, {SQL_BT}, {PG},
r AS (SELECT bt.*, state = 'failed' AND EXISTS (SELECT 1 FROM pg WHERE pg.job_id = bt.job_id
  AND pg.page_no = bt.page_no AND NOT is_scanned AND pg.page_no <= 6) AS retried FROM bt)
SELECT job_id, batch_id, page_no, attempt, retried, CASE WHEN retried THEN 'pending' ELSE state END AS state,
  CASE WHEN retried THEN '' ELSE attempt_id END AS attempt_id, CASE WHEN retried THEN '' ELSE error_code END AS error_code,
  retryable AND NOT retried AS retryable FROM r"""

QUERIES["resume_set"] = lambda spark, d: X.resume_set(
    _batch_table(spark, d).select("job_id", "batch_id", "page_no", "attempt", "state", "attempt_id"), _states(spark, d)
)
ORACLES["resume_set"] = f"""WITH {EV}, {AT}, {BS}
SELECT job_id, batch_id, page_no, attempt, 'pending' AS state, '' AS attempt_id FROM bs
WHERE state NOT IN ('completed', 'failed')"""
