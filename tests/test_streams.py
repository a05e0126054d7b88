import random
import tempfile
from datetime import datetime, timedelta

from glossa.functions.text import SPACE_CHARS
from glossa.sources import streams as S
from glossa.streaming import responses as R
from glossa.streaming import selection as Q
from glossa.streaming import stateful as W
from glossa.streaming import timers as T

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def delta(text):
    return '{"choices":[{"delta":{"content":"' + text + '"}}]}'


CASES = {
    1: (["﻿data: " + delta("a") + "\r", "\n\r\ndata: " + delta("b") + "\n\ndata: [DONE]\n\n"], "ab", True, None),
    2: ([": ping\n\ndata: " + delta("a")[:9], delta("a")[9:] + "\n", "\ndata:[DONE]\n\n"], "a", True, None),
    3: (["data: " + delta("a") + "\n\ndata: {oops\n\ndata: [DONE]\n\n"], "a", False, "INVALID_STREAM_DATA"),
    4: (['data: {"error":{"message":"x"}}\n\n'], "", False, "UPSTREAM_STREAM_ERROR"),
    5: (["data: " + delta("a") + "\n\ndata: " + delta("b")], "ab", False, None),
    6: (['data: {"choices":[{"delta":{"content":5}}]}\n\ndata: [DONE]\n\ndata: ' + delta("z") + "\n\n"], "", True, None),
    7: (['data: {"code":"x","message":"y"}\n\n'], "", False, "UPSTREAM_STREAM_ERROR"),
}


def chunk_table(spark):
    rows = [(r, i, c) for r, (chunks, *_) in CASES.items() for i, c in enumerate(chunks)]
    return spark.createDataFrame(rows, "request_id int, seq bigint, chunk string")


def test_assembling_responses(spark):
    got = {r.request_id: (r.output, r.is_done, r.error_code) for r in R.assemble_responses(chunk_table(spark)).collect()}
    assert got == {r: tuple(want) for r, (_, *want) in CASES.items()}
    verdicts = {r.request_id: r.verdict for r in R.completion_verdict(R.assemble_responses(chunk_table(spark))).collect()}
    assert (verdicts[1], verdicts[5], verdicts[6]) == ("complete", "INCOMPLETE_STREAM", "EMPTY_COMPLETION")


def test_guards_stop_long_streams(spark):
    rows = [(1, i, "x" * 10) for i in range(30)] + [(2, i, "data: 1\n\n") for i in range(30)]
    df = spark.createDataFrame(rows, "request_id int, seq bigint, chunk string")
    got = {r.request_id: (r.breach_seq, r.breach_code) for r in R.stream_guards(df, 200, 55, segment_rows=4).collect()}
    assert got == {1: (5, "SSE_REMAINDER_TOO_LARGE"), 2: (22, "STREAM_RESPONSE_TOO_LARGE")}


def test_timers(spark):
    chunks = [  # request, second, content?, end?
        (1, 60, True, False), (1, 70, True, True),
        (2, 61, True, False),
        (3, 10, False, False), (3, 131, True, False),
        (4, 1, True, False), (4, 46, True, False), (4, 92, True, False),
        (5, 1, True, False), *[(5, s, True, False) for s in range(40, 240, 40)],
        (6, 5, False, False), (6, 125, True, False), (6, 126, True, True),
    ]
    df = spark.createDataFrame(
        [(r, i, at(s), c, e) for i, (r, s, c, e) in enumerate(chunks)],
        "request_id int, seq bigint, ts timestamp, is_content boolean, is_end boolean",
    )
    requests = spark.createDataFrame([(r, at(0)) for r in range(1, 8)], "request_id int, sent_at timestamp")
    got = {r.request_id: r.error_code for r in R.stream_timeouts(df, requests).collect()}
    assert got == {1: None, 2: "RESPONSE_HEADER_TIMEOUT", 3: "FIRST_CONTENT_TIMEOUT", 4: "STREAM_TIMEOUT",
                   5: "REQUEST_TOTAL_TIMEOUT", 6: None, 7: "RESPONSE_HEADER_TIMEOUT"}


def drained(spark, df, transform, mode="append"):
    """Run a transformation over the table as a stream with one trigger."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.coalesce(1).write.parquet(f"{base}/in")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    S.drain(transform(spark.readStream.schema(df.schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/cp", mode)
    return spark.read.parquet(f"{base}/out")


def test_stream_assembly_equals_batch(spark):
    got = {r.request_id: (r.output, r.is_done) for r in W.joined_deltas(drained(spark, chunk_table(spark), W.assemble_stream)).collect()}
    want = {r: (out, done) for r, (_, out, done, _) in CASES.items()}
    want[5] = ("a", False)  # the last frame of an open stream is still waiting
    assert got == want


def test_stream_debounce_equals_batch(spark):
    rows = [(u, at(s), u * 1000 + i, f"{u}-{i}") for u in (1, 2) for i, s in enumerate([0, 1, 2, 10, 11, 30, 50])]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_id bigint, text string")
    closing = spark.createDataFrame([(9, at(9_000), 1, "close")], df.schema)
    batch = {r.event_id for r in Q.debounce(df, "5 seconds").collect()}
    stream = drained(spark, df.unionByName(closing), lambda s: Q.debounce_stream(s, "5 seconds"))
    assert {r.event_id for r in stream.collect() if r.user_id != 9} == batch


def test_fresh_context_and_supersede(spark):
    contexts = spark.createDataFrame(
        [(1, at(0), 1, "c0"), (1, at(20), 2, "c1"), (1, at(100), 3, None)], "user_id int, ts timestamp, event_id bigint, context string"
    )
    actions = spark.createDataFrame(
        [(1, at(s), 10 + i) for i, s in enumerate([10, 50, 51, 105])], "user_id int, ts timestamp, event_id bigint"
    )
    got = {r.event_id: r.context for r in Q.fresh_context(actions, contexts, segment_seconds=15).collect()}
    assert got == {10: "c0", 11: "c1", 12: None, 13: None}
    requests = spark.createDataFrame(
        [(1, at(0), 1, at(10)), (1, at(5), 2, at(6)), (1, at(9), 3, at(20))], "user_id int, ts timestamp, event_id bigint, end_ts timestamp"
    )
    assert [r.is_superseded for r in Q.supersede(requests).orderBy("event_id").collect()] == [True, False, False]


def test_stream_context_equals_batch(spark):
    rows = [(1, at(0), 1, "c0"), (1, at(20), 2, "c1"), (1, at(100), 3, None), (2, at(0), 4, "d"),
            (1, at(10), 10, "act"), (1, at(50), 11, "act"), (1, at(51), 12, "act"), (2, at(29), 13, "act"),
            (1, at(101), 14, "act"), (3, at(5), 15, "act"), (9, at(90_000), 90, "act"), (9, at(90_000), 91, "x")]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_id bigint, context string")

    def both(d):
        return d.filter("context = 'act'").drop("context"), d.filter("context is null or context <> 'act'")

    def closed(d):
        return sorted(tuple(r) for r in d.collect() if r.user_id != 9)

    want = closed(Q.fresh_context(*both(df)))
    assert {r[2]: r[3] for r in want} == {10: "c0", 11: "c1", 12: None, 13: "d", 14: None, 15: None}
    assert closed(drained(spark, df, lambda s: Q.fresh_context_stream(*both(s)))) == want


def in_steps(spark, parts, transform):
    """Run a transformation over tables as a stream, one trigger for each table."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{base}/in")
        S.drain(transform(stream), f"{base}/out", f"{base}/cp")
    return spark.read.parquet(f"{base}/out")


MARKS = "request_id int, seq bigint, ts timestamp, is_content boolean, is_end boolean, sent_at timestamp"


def timed(df):
    """(chunks, requests) of one table of marks."""
    return df.filter("sent_at is null").drop("sent_at"), df.filter("sent_at is not null").select("request_id", "sent_at")


def test_stream_timers_equal_batch(spark):
    rnd = random.Random(4)
    rows = [(r, 0, None, None, None, at(rnd.randint(0, 20))) for r in range(60)]
    for r in range(60):
        t = rows[r][5] + timedelta(milliseconds=rnd.choice([1, 59_999, 60_000, 60_001, 5_000]))
        for i in range(rnd.randint(0, 9)):
            rows.append((r, i, t, rnd.random() < 0.6, rnd.random() < 0.15, None))
            t += timedelta(microseconds=rnd.choice([1, 1_000_000, 44_999_999, 45_000_000, 45_000_001, 121_000_000]))
    close = [(99, 0, None, None, None, at(90_000)), (98, 0, at(90_000), False, False, None)]
    df = spark.createDataFrame(rows, MARKS)
    want = sorted(tuple(r) for r in R.stream_timeouts(*timed(df)).collect())
    assert {r[1] for r in want} == {None, *T.TimeoutProcessor.CODES}
    one = in_steps(spark, [df.unionByName(spark.createDataFrame(close, MARKS))], lambda s: T.timeouts_stream(*timed(s)))
    assert sorted(tuple(r) for r in one.collect()) == want
    # The same in triggers of one minute; rows of a trigger in any order.
    by_minute = {}
    for row in rows:
        by_minute.setdefault(((row[2] or row[5]) - T0).seconds // 60, []).append(row)
    parts = [spark.createDataFrame(rnd.sample(by_minute[m], len(by_minute[m])), MARKS) for m in sorted(by_minute)[:4]]
    parts.append(spark.createDataFrame([row for m in sorted(by_minute)[4:] for row in by_minute[m]] + close, MARKS))
    steps = in_steps(spark, parts, lambda s: T.timeouts_stream(*timed(s)))
    assert sorted(tuple(r) for r in steps.collect()) == want


def test_stream_timers_late_row_and_idle_key(spark):
    first = [(1, 0, None, None, None, at(0)), (1, 0, at(1), True, False, None), (2, 0, None, None, None, at(0)), (3, 0, at(2), True, False, None)]
    onward = [(8, 0, None, None, None, at(400)), (8, 0, at(400), True, True, None)]
    late = [(1, 1, at(30), True, True, None)]  # in time for the request, but far behind the watermark
    close = [(9, 0, None, None, None, at(9_000)), (7, 0, at(9_000), True, False, None)]
    parts = [spark.createDataFrame(p, MARKS) for p in (first, onward, late, close)]
    got = {r.request_id: (r.error_code, r.fired_at) for r in in_steps(spark, parts, lambda s: T.timeouts_stream(*timed(s))).collect()}
    assert got == {1: ("STREAM_TIMEOUT", at(46)), 2: ("RESPONSE_HEADER_TIMEOUT", at(60)), 8: (None, None)}


def test_stream_supersede_equals_batch(spark):
    rnd = random.Random(6)
    rows = [(u, at(t), u * 1000 + i, at(t + rnd.choice([0, 1, 5, 30]))) for u in range(8) for i, t in enumerate(sorted(rnd.sample(range(200), 15)))]
    rows.append((3, rows[50][1], 9_000, None))
    schema = "user_id int, ts timestamp, event_id bigint, end_ts timestamp"
    close = [(u, at(9_000), 10_000 + u, at(9_001)) for u in range(8)]
    names = ["user_id", "ts", "event_id", "end_ts", "is_superseded"]
    want = Q.supersede(spark.createDataFrame(rows + close, schema)).select(*names).filter("event_id < 10000")
    rows.sort(key=lambda r: r[1])
    parts = [spark.createDataFrame(rnd.sample(rows[i : i + 40], len(rows[i : i + 40])), schema) for i in range(0, 120, 40)]
    parts.append(spark.createDataFrame(rows[120:] + close, schema))
    got = in_steps(spark, parts, T.supersede_stream).select(*names).filter("event_id < 10000")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_chunk_source_drops_replays_and_late_rows(spark):
    schema = "request_id string, seq int, ts timestamp, chunk string"
    first = [("a", i, at(i), f"c{i}") for i in range(5)] + [("a", 2, at(3), "again"), (None, 1, at(1), "x"), ("a", None, at(1), "x")]
    second = [("a", 4, at(5), "again"), ("b", 0, at(100), "b0")]
    third = [("a", 9, at(6), "too late"), ("b", 0, at(101), "again"), ("b", 1, at(200), "b1")]
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    dropped = []
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{base}/in")
        query = S.drain(S.read_chunk_stream(spark, f"{base}/in", delay="10 seconds"), f"{base}/out", f"{base}/cp")
        dropped.append(S.dropped_rows(query))
    got = spark.read.parquet(f"{base}/out")
    assert sorted((r.request_id, r.seq, r.chunk) for r in got.collect()) == [*(("a", i, f"c{i}") for i in range(5)), ("b", 0, "b0"), ("b", 1, "b1")]
    assert dropped == [{"late": 0, "repeats": 1}, {"late": 0, "repeats": 1}, {"late": 1, "repeats": 1}]


def test_space_set_is_fixed():
    assert len(SPACE_CHARS) == 25


def test_stream_queries_read_tables_of_one_or_several_files(spark, small, tmp_path):
    """A table may be a folder of files or without rows; streams read it as they read a single file."""
    import __spark_entry__ as entry

    for name in ("conversations", "events"):
        table = spark.read.parquet(f"{small}/{name}.parquet")
        table.repartition(3).write.parquet(f"{tmp_path}/parts/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    for name in ("assemble_stream", "event_stream_counts"):
        query = entry.queries()[name]
        one = sorted(query(spark, small).collect())
        assert one and sorted(query(spark, f"{tmp_path}/parts").collect()) == one
    assert entry.queries()["assemble_stream"](spark, f"{tmp_path}/none").collect() == []


def test_admission_calls_its_state_once_per_trigger():
    """Ids accepted in an earlier trigger are known in the next; the number of state calls doesn't grow with the rows."""
    import pandas as pd

    from glossa.streaming.stateful import AdmissionProcessor

    calls = []

    class State:
        def __init__(self, empty):
            self.held = empty

        def get(self):
            calls.append("get")
            return self.held if not isinstance(self.held, list) else iter(self.held)

        def update(self, value):
            calls.append("update")
            self.held = value

        def appendList(self, rows):
            calls.append("appendList")
            self.held = [*self.held, *rows]

    class Handle:
        def getValueState(self, name, schema):
            return State(None)

        def getListState(self, name, schema):
            return State([])

    job = AdmissionProcessor(300, 10**9, 10**9)
    job.init(Handle())

    def sent(ids):
        part = pd.DataFrame({"job_id": 1, "batch_id": ids, "seq": range(len(ids)), "ts": 0, "chars": 1, "bytes": 1})
        calls.clear()
        return list(next(job.handleInputRows((1,), iter([part]), None))["error_code"])

    assert sent([f"b{i}" for i in range(200)] + ["b0"]) == [None] * 200 + ["BATCH_ALREADY_EXISTS"] and len(calls) <= 4
    assert sent(["b199", *(f"c{i}" for i in range(101))]) == ["BATCH_ALREADY_EXISTS", *[None] * 100, "JOB_BATCH_LIMIT"]
    assert len(calls) <= 4


def test_timers_call_the_state_per_slot_not_per_key():
    """A slot of 500 requests: their number of state calls is that of one request."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def __getattribute__(self, name):
            if name in ("exists", "get", "put", "appendList", "clear"):
                calls.append(name)
            return object.__getattribute__(self, name)

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):
            self.rows = self.rows + list(rows)

        def clear(self):
            self.rows = []

    class Handle:
        def getListState(self, *_):
            return State()

        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append("registerTimer")

    class Now:
        def getCurrentWatermarkInMs(self):
            return 100_000

    def run(n):
        calls.clear()
        job = T.TimeoutProcessor(60, 120, 45, 180)
        job.init(Handle())
        rows = [(f"={i}", 0, T.SENT) for i in range(n)] + [(f"={i}", T.SECOND * (1 + i % 2 * 70), T.END) for i in range(n)]
        list(job.handleInputRows((3,), iter([pd.DataFrame(rows, columns=["key", "at", "mark"])]), Now()))
        # Two timers of the slot are up at one watermark.
        out = [part for _ in range(2) for part in job.handleExpiredTimer((3,), Now(), None)]
        return len(calls), {r.key: r.error_code for part in out for r in part.itertuples()}

    few, _ = run(1)
    many, got = run(500)
    assert got == {f"={i}": "RESPONSE_HEADER_TIMEOUT" if i % 2 else None for i in range(500)}
    assert many == few <= 10


def test_timers_of_null_and_text_keys(spark):
    names = "user_id string, ts timestamp, event_id bigint, end_ts timestamp"
    big = (1 << 53) + 1  # does not survive as a fraction
    rows = [(None, at(0), big, None), (None, at(5), 2, at(6)), ("-", at(1), 3, at(2)), ("", at(1), 4, at(3)), ("z", at(9_000), 5, at(9_000))]
    got = in_steps(spark, [spark.createDataFrame(rows, names)], T.supersede_stream).filter("event_id <> 5")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(None, at(0), big, None, False), (None, at(5), 2, at(6), False), ("-", at(1), 3, at(2), False), ("", at(1), 4, at(3), False)], key=str
    )
