import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glossa.operators import batching as B
from glossa.operators import execution as X
from glossa.operators import progress as E
from glossa.plans import bindings
from glossa.streaming import responses as R
from registry.jobs import QUERIES

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.mark.parametrize(
    "mode,has_a,has_b,expected",
    [
        ("a", True, True, "a"),
        ("b", True, True, "b"),
        ("a", False, True, ""),
        ("b", True, False, ""),
        ("legacy_a_first", False, True, "b"),
        (None, True, None, "a"),
    ],
)
def test_routing(spark, mode, has_a, has_b, expected):
    requests = spark.createDataFrame([(1, 1, "text")], "request_id int, tenant int, kind string")
    settings = spark.createDataFrame([(1, mode, has_a, has_b)], "tenant int, mode string, has_a boolean, has_b boolean")
    assert B.route_requests(requests, settings).first().provider == expected


def brute_admission(rows, caps):
    state, out = {}, {}
    for job, batch, ts, seq, c, b in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        n, chars, size, seen = state.get(job, (0, 0, 0, frozenset()))
        if batch in seen:
            code = "BATCH_ALREADY_EXISTS"
        elif n >= caps[0]:
            code = "JOB_BATCH_LIMIT"
        elif chars + c > caps[1]:
            code = "JOB_TEXT_TOO_LONG"
        elif size + b > caps[2]:
            code = "JOB_UTF8_TOO_LARGE"
        else:
            code, state[job] = None, (n + 1, chars + c, size + b, seen | {batch})
        out[seq] = code
    return out


@pytest.mark.parametrize("fold_rows", [10_000, 30])
def test_admission_equals_brute_force(spark, fold_rows):
    """One hot job holds most rows; with a small fold limit it is settled in rounds."""
    rng = random.Random(5)
    rows = [
        (0 if rng.random() < 0.7 else rng.randint(1, 8), f"b{rng.randint(0, 90)}", at(rng.randint(0, 400_000)), i,
         rng.randint(1, 60), rng.randint(1, 70))
        for i in range(300)
    ]
    caps = (25, 600, 590)
    df = spark.createDataFrame(rows, "job_id int, batch_id string, ts timestamp, seq bigint, chars bigint, bytes bigint")
    got = {r.seq: r.error_code for r in B.admit_batches(df, *caps, fold_rows=fold_rows, segment_seconds=20_000).collect()}
    assert got == brute_admission(rows, caps)


def test_queue_counters_never_fall_below_zero(spark):
    rng = random.Random(3)
    kinds = ["BATCH_QUEUED", "BATCH_STARTED", "BATCH_DONE", "BATCH_ERROR"]
    rows = [(rng.randint(0, 2), at(i * 500), i, rng.choice(kinds)) for i in range(200)]
    df = spark.createDataFrame(rows, "job_id int, ts timestamp, event_id bigint, event_type string")
    active, queued, want = {}, {}, {}
    for job, _, i, kind in rows:
        a, q = active.get(job, 0), queued.get(job, 0)
        if kind == "BATCH_QUEUED":
            q += 1
        elif kind == "BATCH_STARTED":
            a, q = a + 1, max(0, q - 1)
        else:
            a = max(0, a - 1)
        active[job], queued[job] = a, q
        want[i] = (a, q, sum(v > 0 for v in active.values()))
    got = {r.event_id: (r.active, r.queued, r.active_jobs) for r in B.queue_pressure(df, segment_seconds=7_000).collect()}
    assert got == want


def test_terminal_states_absorb_and_attempts_restart(spark):
    log = [
        (1, 1, "BATCH_STARTED"), (1, 1, "BATCH_DONE"), (1, 1, "BATCH_CANCELLED"),
        (1, 2, "BATCH_STARTED"), (1, 2, "BATCH_ERROR"), (1, 2, "BATCH_STARTED"),
        (1, 3, "BATCH_DONE"), (1, 4, "BATCH_STARTED"), (1, 4, "BATCH_CANCELLED"), (1, 4, "BATCH_DONE"),
    ]
    df = spark.createDataFrame(
        [(j, b, at(i * 90_000), i, t) for i, (j, b, t) in enumerate(log)],
        "job_id int, batch_id int, ts timestamp, event_id bigint, event_type string",
    )
    got = {r.batch_id: (r.state, r.attempt) for r in E.batch_state(df).collect()}
    assert got == {1: ("completed", 1), 2: ("translating", 2), 3: ("pending", 0), 4: ("cancelled", 1)}


def test_page_status_and_settlement(spark):
    pages = spark.createDataFrame([(1, p, p == 1) for p in range(1, 8)], "job_id int, page_no int, is_scanned boolean")
    states = {1: ["failed"], 2: ["completed", "failed"], 3: ["completed", "translating"], 4: ["completed"] * 2,
              5: ["cancelled"] * 2, 6: ["completed", "pending"]}
    batches = spark.createDataFrame([(1, p, s) for p, ss in states.items() for s in ss], "job_id int, page_no int, state string")
    got = {r.page_no: r.status for r in E.page_status(pages, batches).collect()}
    assert got == {1: "scanned", 2: "failed", 3: "translating", 4: "completed", 5: "cancelled", 6: "pending", 7: "completed"}
    assert E.job_progress(pages, batches).first().percent == 29  # scanned page 1 and page 4 of 7
    done = E.job_settlement(batches.filter("state in ('completed', 'failed')")).first()
    assert (done.settled, done.outcome, done.n_failed) == (True, "finished_with_errors", 2)
    assert not E.job_settlement(batches).first().settled


def test_job_queries_read_all_batches(spark, tmp_path):
    """Batches without an attempt are open, and the events of failed batches belong to the log."""
    kinds = ["click", "error", "view", "click", "purchase"]
    batches = [1, 1, 2, 3, 3]  # failed, pending, completed
    rows = [(i, at(i * 60), 1, kind, 0.5, f'{{"k": {b}}}') for i, (kind, b) in enumerate(zip(kinds, batches, strict=True))]
    rows.append((5, at(300), 2, "view", 0.5, '{"k": 4}'))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.job_id: (r.n_batches, r.n_open, r.n_failed, r.settled) for r in QUERIES["job_settlement"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 1, 1, False), 2: (1, 1, 0, False)}
    events = QUERIES["current_attempt_events"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id, r.event_type) for r in events) == [
        (0, "BATCH_STARTED"), (1, "BATCH_ERROR"), (3, "BATCH_STARTED"), (4, "BATCH_DONE"),
    ]


def test_reconciliation_is_all_or_nothing(spark):
    ok = '[{"id":"x","target":"1"},{"id":"y","target":"2"}]'
    answers = {
        1: ok,
        2: f"```json\n{ok}\n```",
        3: '[{"id":"x","target":"1"}]',
        4: '[{"id":"x","target":"1"},{"id":"x","target":"2"}]',
        5: '[{"id":"x","target":"1"},{"id":"y","target":"2","extra":1}]',
        6: '[{"id":"x","target":"1"},{"id":"y","target":3}]',
        7: "not json",
        8: '[{"id":"x","target":"1"},{"id":"y","target":" "}]',
        9: '{"id":"x","target":"1"}',
        10: "```json\n[",
    }
    responses = spark.createDataFrame(list(answers.items()), "batch_id int, response string")
    requested = spark.createDataFrame([(b, i) for b in [*answers, 11] for i in "xy"], "batch_id int, block_id string")
    got = {}
    for r in X.reconcile_results(responses, requested).collect():
        got.setdefault(r.batch_id, set()).add((r.block_id, r.target, r.error_code))
    good = {("x", "1", None), ("y", "2", None)}
    bad = {("x", None, "INVALID_BATCH_RESPONSE"), ("y", None, "INVALID_BATCH_RESPONSE")}
    assert got == {b: good if b in (1, 2) else bad for b in [*answers, 11]}


def test_request_template_leaves_placeholders_in_texts_alone(spark):
    df = spark.createDataFrame([("a", "m", "say {text} {language}", "en", "word")],
                               "provider string, model string, text string, language string, content_type string")
    payload = B.build_requests(df, "sys", "[{language}|{content_type}] {text}!").first().payload
    assert '"content":"[en|word] say {text} {language}!"' in payload
    assert '"thinking":{"type":"disabled"}' in payload


def test_null_answers_fail_their_row_only(spark):
    def service(text):
        return None if text == "none" else text.upper()

    df = spark.createDataFrame([(1, "none"), (2, "ok")], "doc_id int, text string")
    got = {r.doc_id: (r.state, r.target, r.code) for r in X.translate(df, service, ("doc_id",)).collect()}
    assert got == {1: ("failed", None, "EMPTY_PAGE_RESPONSE"), 2: ("completed", "OK", None)}


def test_long_conversations_keep_all_turns(spark):
    df = spark.createDataFrame([(5, t, "user", f"text {t}.") for t in range(1_100)], "conv_id bigint, turn bigint, role string, text string")
    done = R.assemble_responses(bindings.response_chunks(df)).collect()[0]
    assert done.output == "".join(f"text {t}." for t in range(1_100)) and not done.is_done  # 5 % 6 = 5: no end marker
    asked = df.select(bindings.turn_batch().alias("batch_id"), F.concat(F.lit("b"), "turn").alias("block_id"))
    got = X.reconcile_results(bindings.answered_batches(df), asked)
    assert got.filter("error_code is null").count() == 1_100


def test_cancelled_jobs(spark):
    pages = spark.createDataFrame([(1, 1, False), (2, 1, False)], "job_id int, page_no int, is_scanned boolean")
    batches = spark.createDataFrame([(j, b, 1, s) for j in (1, 2) for b, s in enumerate(["completed", "cancelled"])], "job_id int, batch_id int, page_no int, state string")
    jobs = spark.createDataFrame([(1, "cancelled"), (2, "running")], "job_id int, phase string")
    got = {r.job_id: r.status for r in E.page_status(pages, batches, jobs).collect()}
    assert got == {1: "cancelled", 2: "pending"}
