import random
from datetime import datetime, timedelta

import pytest

from glossa.operators import queueing as Q

T0 = datetime(2024, 1, 1)
SCHEMA = "job_id long, batch_id string, ts timestamp, seq long, arrives boolean"


def plain(rows, limit):
    """The rule, row by row."""
    waiting, out = {}, []
    for job, batch, ts, seq, arrives in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])):
        n = waiting.get(job, 0)
        if arrives:
            full = n >= limit
            out.append((job, batch, ts, seq, n, Q.CODE if full else None, not full))
            waiting[job] = n if full else n + 1
        else:
            waiting[job] = max(n - 1, 0)
    return sorted(out, key=str)


def log(n, jobs, seed):
    rnd = random.Random(seed)
    return [
        (rnd.choice(jobs), f"b{i}", T0 + timedelta(seconds=rnd.randint(0, n)), i, rnd.choice([True, True, True, False, False, None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("limit", [0, 1, 3, 64])
def test_hot_job_over_many_ranges(spark, limit):
    rows = log(3_000, [7, 7, 7, 7, 1, 2, 3, None], limit)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert sorted((tuple(r) for r in Q.admit_queue(df, limit).collect()), key=str) == plain(rows, limit)


def test_job_fills_whole_ranges(spark):
    rows = log(2_000, [5], 1)
    assert sorted((tuple(r) for r in Q.admit_queue(spark.createDataFrame(rows, SCHEMA), 2).collect()), key=str) == plain(rows, 2)


def test_maps_compose():
    rnd = random.Random(3)
    for _ in range(200):
        moves = [rnd.choice(Q._moves(4)) for _ in range(rnd.randint(1, 20))]
        whole = Q._moves(4)[0]
        for move in moves:
            whole = whole.then(move)
        for x in range(5):
            step = x
            for move in moves:
                step = move(step)
            assert whole(x) == step


def test_nothing(spark):
    assert Q.admit_queue(spark.createDataFrame([], SCHEMA)).count() == 0
