"""Response streams, timers, interactive rules and streaming runs."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from glossa.plans import bindings
from glossa.session import shared_folder
from glossa.sources import streams as S
from glossa.streaming import responses as R
from glossa.streaming import selection as Q
from glossa.streaming import stateful as W
from glossa.streaming import timers as T
from registry.common import table
from registry.jobs import CAPS, EV

QUERIES = {}
ORACLES = {}


def _chunks(spark, d):
    return bindings.response_chunks(table(spark, d, "conversations"))


SQL_CHUNKS = """fr AS (SELECT conv_id AS request_id, turn, CASE WHEN turn > 0 THEN chr(10) || chr(10) ELSE '' END || 'data: ' ||
    CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN '{oops' WHEN conv_id % 11 = 4 AND turn = 1
      THEN '{"error":{"message":"overloaded"}}' ELSE '{"choices":[{"delta":{"content":' ||
        to_json(CASE WHEN conv_id % 13 = 6 THEN '' ELSE text END)::VARCHAR || '}}]}' END AS frame FROM conversations
  UNION ALL SELECT conv_id, 2147483647, chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) FROM conversations
    WHERE turn = 0 AND conv_id % 6 <> 5),
cp AS (SELECT request_id, turn, regexp_extract_all(frame, '(?s).{1,17}') AS cs FROM fr),
ch AS (SELECT request_id, turn * 4294967296 + generate_subscripts(cs, 1) - 1 AS seq, unnest(cs) AS chunk FROM cp)"""
SQL_ANSWER = """an AS (SELECT conv_id AS request_id,
  coalesce(string_agg(CASE WHEN conv_id % 13 = 6 THEN '' ELSE text END, '' ORDER BY turn)
    FILTER (NOT ((conv_id % 7 = 3 OR conv_id % 11 = 4) AND turn >= 1)), '') AS output,
  conv_id % 6 <> 5 AND conv_id % 7 <> 3 AND conv_id % 11 <> 4 AS is_done,
  CASE WHEN conv_id % 7 = 3 THEN 'INVALID_STREAM_DATA' WHEN conv_id % 11 = 4 THEN 'UPSTREAM_STREAM_ERROR' END AS error_code
  FROM conversations GROUP BY conv_id)"""

QUERIES["assemble_responses"] = lambda spark, d: R.assemble_responses(_chunks(spark, d))
ORACLES["assemble_responses"] = f"WITH {SQL_ANSWER} SELECT request_id, output, is_done, error_code FROM an"
QUERIES["completion_verdict"] = lambda spark, d: R.completion_verdict(
    R.assemble_responses(_chunks(spark, d))
).select("request_id", "verdict")
ORACLES["completion_verdict"] = f"""WITH {SQL_ANSWER}
SELECT request_id, coalesce(error_code, CASE WHEN NOT is_done THEN 'INCOMPLETE_STREAM' WHEN output = '' THEN
  'EMPTY_COMPLETION' ELSE 'complete' END) AS verdict FROM an"""

BYTES, REST = 3_000, 900
QUERIES["stream_guards"] = lambda spark, d: R.stream_guards(_chunks(spark, d), BYTES, REST).select(
    "request_id", "seq", "run_bytes", "remainder", "breach_seq", "breach_code"
)
ORACLES["stream_guards"] = f"""WITH {SQL_CHUNKS},
w AS (SELECT request_id, seq, CAST(sum(strlen(chunk)) OVER o AS BIGINT) AS run_bytes, string_agg(chunk, '') OVER o AS pre
  FROM ch WINDOW o AS (PARTITION BY request_id ORDER BY seq)),
r AS (SELECT request_id, seq, run_bytes,
    CAST(length(regexp_extract(pre, '(?s)^(?:.*\\n\\n)?(.*)$', 1)) AS BIGINT) AS remainder FROM w),
b AS (SELECT request_id, min(seq) AS breach_seq, arg_min(CASE WHEN run_bytes > {BYTES} THEN 'STREAM_RESPONSE_TOO_LARGE'
    ELSE 'SSE_REMAINDER_TOO_LARGE' END, seq) AS breach_code FROM r WHERE run_bytes > {BYTES} OR remainder > {REST} GROUP BY request_id)
SELECT request_id, seq, run_bytes, remainder, breach_seq, breach_code FROM r LEFT JOIN b USING (request_id)"""

QUERIES["stream_timeouts"] = lambda spark, d: R.stream_timeouts(
    *bindings.timed_chunks(table(spark, d, "events"))
).select("request_id", "error_code", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"))
ORACLES["stream_timeouts"] = """
WITH c AS (SELECT user_id * 10000000 + date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS request_id, event_id,
    make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 300) AS ts,
    event_type = 'error' AS is_end FROM events),
n AS (SELECT *, lead(ts) OVER (PARTITION BY request_id ORDER BY ts, event_id) AS nx FROM c),
a AS (SELECT request_id, make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (request_id % 10000000) * 288000000) AS sent,
    min(ts) AS head, min(ts) FILTER (NOT is_end) AS content, min(ts) FILTER (is_end) AS fin,
    min(ts + INTERVAL 45 SECOND) FILTER (NOT is_end AND (nx IS NULL OR nx > ts + INTERVAL 45 SECOND)) AS idle
  FROM n GROUP BY request_id),
f AS (SELECT request_id, fin, sent + INTERVAL 180 SECOND AS fired, 0 AS rk, 'REQUEST_TOTAL_TIMEOUT' AS code FROM a
    WHERE fin IS NULL OR fin > sent + INTERVAL 180 SECOND
  UNION ALL SELECT request_id, fin, sent + INTERVAL 60 SECOND, 1, 'RESPONSE_HEADER_TIMEOUT' FROM a
    WHERE head > sent + INTERVAL 60 SECOND
  UNION ALL SELECT request_id, fin, head + INTERVAL 120 SECOND, 2, 'FIRST_CONTENT_TIMEOUT' FROM a
    WHERE (content IS NULL OR content > head + INTERVAL 120 SECOND) AND (fin IS NULL OR fin > head + INTERVAL 120 SECOND)
  UNION ALL SELECT request_id, fin, idle, 3, 'STREAM_TIMEOUT' FROM a WHERE idle IS NOT NULL),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY fired, rk) = 1)
SELECT a.request_id, CASE WHEN t.fin IS NULL OR fired < t.fin THEN code END AS error_code,
  CASE WHEN t.fin IS NULL OR fired < t.fin THEN fired END AS fired_at FROM a LEFT JOIN t USING (request_id)"""

# --- interactive rules ---------------------------------------------------------

QUERIES["debounce"] = lambda spark, d: Q.debounce(
    table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "6 hours"
)
ORACLES["debounce"] = """SELECT user_id, ts, event_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR nx >= ts + INTERVAL 6 HOUR"""

QUERIES["supersede"] = lambda spark, d: Q.supersede(
    table(spark, d, "events").select(
        "user_id", "ts", "event_id", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, value * 600)").alias("end_ts")
    )
)
ORACLES["supersede"] = """WITH r AS (SELECT user_id, ts, event_id, ts + to_microseconds(CAST(round(value * 600 * 1000000) AS BIGINT)) AS e,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT user_id, ts, event_id, CASE WHEN nx < e THEN nx ELSE e END AS end_ts, coalesce(nx < e, false) AS is_superseded FROM r"""


def _context(spark, d):
    e = table(spark, d, "events")
    contexts = e.filter("event_type in ('view', 'signup')").select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") == "view", F.col("props")).alias("context")
    )
    return e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), contexts


QUERIES["fresh_context"] = lambda spark, d: Q.fresh_context(*_context(spark, d), "4 hours")
ORACLES["fresh_context"] = """
WITH c AS (SELECT user_id, ts, CASE WHEN event_type = 'view' THEN props END AS context FROM events
    WHERE event_type IN ('view', 'signup')),
a AS (SELECT e.user_id, e.ts, e.event_id, c.context, c.ts AS cts FROM (SELECT * FROM events WHERE event_type = 'purchase') e
  ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts),
u AS (SELECT *, coalesce(context IS NOT NULL AND ts <= cts + INTERVAL 4 HOUR, false) AS ok FROM a)
SELECT user_id, ts, event_id, CASE WHEN ok THEN context END AS context, CASE WHEN ok THEN cts END AS context_ts,
  CASE WHEN NOT ok THEN 'NO_FRESH_CONTEXT' END AS error_code FROM u"""

# --- streaming runs --------------------------------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CONVERSATIONS_DDL = "conv_id bigint, turn bigint, role string, text string"


def _work_dir(spark):
    """A fresh folder below the shared folder of the session."""
    return f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def _drained(spark, stream, mode="append"):
    base = _work_dir(spark)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        S.drain(stream, f"{base}/out", f"{base}/checkpoint", mode)
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    # A stream may end without any row, and so without a file that tells the schema.
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _table_path(d, name):
    """A table is one file or a folder of files; as a glob pattern the path may be either for a streaming source."""
    return f"{d}/{name}.parque[t]"


def _stream(spark, d, name, ddl):
    return spark.readStream.schema(ddl).parquet(_table_path(d, name))


QUERIES["event_stream_counts"] = lambda spark, d: _drained(
    spark,
    S.read_event_stream(spark, _table_path(d, "events"), EVENTS_DDL)
    .groupBy("user_id", "event_type")
    .agg(F.count("*").alias("n_events")),
    "complete",
)
ORACLES["event_stream_counts"] = (
    "SELECT user_id, event_type, count(*) AS n_events FROM events GROUP BY user_id, event_type"
)

QUERIES["admit_stream"] = lambda spark, d: _drained(
    spark, W.admit_stream(bindings.admission_rows(_stream(spark, d, "events", EVENTS_DDL)), *CAPS)
)


def _finished(spark, df, closing, ddl):
    """``df``, written to the shared folder, as a stream that ends with ``closing`` rows, which let the watermark pass all others."""
    path = f"{_work_dir(spark)}/in"
    df.select(*[F.col(c).cast(t) for c, t in (f.split(" ") for f in ddl.split(", "))]).write.parquet(path)
    spark.createDataFrame(closing, ddl).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).parquet(path)


FAR = datetime(2100, 1, 1)
CHUNKS = "request_id bigint, seq bigint, ts timestamp, chunk string"


def _chunk_stream(spark, d):
    """Chunks written as JSON, every fifth one sent twice, read as a stream and counted per request."""
    path = f"{_work_dir(spark)}/in"
    chunks = _chunks(spark, d).withColumn("ts", F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("seq") % 100_000))
    chunks.unionByName(chunks.filter("seq % 5 = 0")).write.json(path)
    spark.createDataFrame([S.closing_chunk(FAR)], CHUNKS).write.mode("append").json(path)
    got = _drained(spark, S.read_chunk_stream(spark, path, delay="10 minutes", schema=CHUNKS)).filter("request_id >= 0")
    return got.groupBy("request_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.char_length("chunk")).cast("bigint").alias("n_chars"), F.max("seq").alias("last_seq")
    )


QUERIES["chunk_stream"] = _chunk_stream
ORACLES["chunk_stream"] = f"""WITH {SQL_CHUNKS}
SELECT request_id, count(*) AS n_chunks, CAST(sum(length(chunk)) AS BIGINT) AS n_chars, max(seq) AS last_seq FROM ch GROUP BY request_id"""

MARKS = "request_id bigint, ts timestamp, is_content boolean, is_end boolean, sent_at timestamp"


def _timeouts_stream(spark, d):
    chunks, requests = bindings.timed_chunks(table(spark, d, "events"))
    marks = chunks.select("request_id", "ts", "is_content", "is_end").unionByName(
        requests.select("request_id", "sent_at"), allowMissingColumns=True
    )
    stream = _finished(spark, marks, [(-1, None, None, None, FAR), (-1, FAR, True, True, None)], MARKS)
    settled = T.timeouts_stream(
        stream.filter("sent_at is null").drop("sent_at"), stream.filter("sent_at is not null").select("request_id", "sent_at")
    )
    return (
        _drained(spark, settled).filter("request_id >= 0").withColumn("fired_at", F.col("fired_at").cast("timestamp_ntz"))
    )


QUERIES["timeouts_stream"] = _timeouts_stream
ORACLES["timeouts_stream"] = ORACLES["stream_timeouts"]


def _supersede_stream(spark, d):
    events = table(spark, d, "events").select(
        "user_id", "ts", "event_id", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, value * 600)").alias("end_ts")
    )
    # The last request of a user is settled when its end has passed.
    stream = _finished(
        spark, events, [(-1, FAR, -1, FAR)], "user_id bigint, ts timestamp, event_id bigint, end_ts timestamp"
    )
    done = _drained(spark, T.supersede_stream(stream)).filter("user_id >= 0")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "end_ts")})


QUERIES["supersede_stream"] = _supersede_stream
ORACLES["supersede_stream"] = ORACLES["supersede"]


def _context_stream(spark, d):
    actions, contexts = _context(spark, d)
    ddl = "user_id bigint, ts timestamp, event_id bigint, context string"
    streams = (
        _finished(spark, rows.select("user_id", "ts", "event_id", context), [(-1, FAR, -1, None)], ddl)
        for rows, context in ((actions, F.lit(None).alias("context")), (contexts, "context"))
    )
    done = _drained(spark, Q.fresh_context_stream(*streams, "4 hours")).filter("user_id >= 0")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "context_ts")})


QUERIES["fresh_context_stream"] = _context_stream
ORACLES["fresh_context_stream"] = ORACLES["fresh_context"]

# The SQL of the batch twin, reduced to the columns a stream emits.
from registry.jobs import ORACLES as _JOBS  # noqa: E402

ORACLES["admit_stream"] = (
    f"SELECT job_id, batch_id, seq, error_code FROM ({_JOBS['admit_batches']})"
)

QUERIES["assemble_stream"] = lambda spark, d: W.joined_deltas(
    _drained(spark, W.assemble_stream(bindings.response_chunks(_stream(spark, d, "conversations", CONVERSATIONS_DDL))))
)
# A stream never sees the end of a response: a last frame without its empty line is
# still waiting, and a response without any whole frame has no row.
ORACLES["assemble_stream"] = """
WITH t AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS lastt,
    conv_id % 7 = 3 OR conv_id % 11 = 4 AS err, conv_id % 6 = 5 AS open FROM conversations),
a AS (SELECT conv_id AS request_id, any_value(err) AS err, any_value(open) AS open, any_value(lastt) AS lastt,
    coalesce(string_agg(CASE WHEN conv_id % 13 = 6 THEN '' ELSE text END, '' ORDER BY turn)
      FILTER (NOT (err AND turn >= 1) AND NOT (open AND turn = lastt)), '') AS output FROM t GROUP BY conv_id)
SELECT request_id, output, NOT open AND NOT err AS is_done FROM a
WHERE lastt > 0 OR NOT open"""
