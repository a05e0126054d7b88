"""Admission to bounded queues: arrivals and departures of a job in one order.

The number of waiting batches is a counter with a floor (nothing leaves an empty queue) and
a ceiling (an arrival at a full queue is rejected and not counted).  A run of rows maps the
counter x to min(high, max(low, x + shift)), and two such maps in a row are one again.

Rows are dealt by ranges of (job, order), so a hot job is spread over many tasks.  Each
range reduces its first and its last job to one map; put together in order, one number per
range, they say how full the queue is where a range begins in the middle of a job.  A
second pass over the same ranges then decides every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa import limits
from glossa.session import cut_lineage

CODE = "JOB_QUEUE_FULL"


class Clamp(NamedTuple):
    """x to min(high, max(low, x + shift))."""

    shift: int
    low: int
    high: int

    def __call__(self, x: int) -> int:
        return min(self.high, max(self.low, x + self.shift))

    def then(self, after: Clamp) -> Clamp:
        return Clamp(self.shift + after.shift, after(self.low), after(self.high))


def _moves(limit: int) -> tuple[Clamp, Clamp, Clamp]:
    """No move, an arrival, a departure."""
    return Clamp(0, 0, limit), Clamp(1, 0, limit), Clamp(-1, 0, limit)


def _entries(ends: list[dict[str, Any]]) -> dict[int, int]:
    """Waiting batches of the first job of each range before that range, from the maps of first and last jobs."""
    entries, job, waiting = {}, object(), 0
    for end in sorted(ends, key=lambda e: e["part"]):
        entry = waiting if end["first_job"] == job else 0
        entries[end["part"]] = entry
        waiting = Clamp(*end["last"])(entry if end["one_job"] else 0)
        job = end["last_job"]
    return entries


def admit_queue(log: DataFrame, max_queued: int = limits.MAX_QUEUED_BATCHES) -> DataFrame:
    """Arrivals under the queue limit: job_id, batch_id, ts, seq, queued, error_code and admitted.

    Input: ``job_id, batch_id, ts, seq, arrives``; (ts, seq) orders a job, rows where
    ``arrives`` is false are departures (a batch was started or given up).  ``queued`` is the
    number of waiting batches that an arrival meets.  Budgets of the job apply to what is
    admitted here (``batching.admit_batches``).  Null jobs are one job, null ``arrives`` a
    departure; rows that tie are taken in any order.  An empty log gives no rows.
    """
    kind = log.schema["job_id"].dataType.simpleString()
    batch_kind = log.schema["batch_id"].dataType.simpleString()
    keys = ["job_id", "ts", "seq", "_tie"]
    rows = cut_lineage(log.select("job_id", "batch_id", "ts", "seq", F.coalesce("arrives", F.lit(False)).alias("arrives")))
    dealt = cut_lineage(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("part", F.spark_partition_id())
    )
    still, arrival, departure = _moves(max_queued)

    def reduce_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first_job, job, jobs, own = None, None, None, 0, still
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("job_id", "arrives"))
            for name, own_rows in groupby(zip(*columns, strict=True), key=lambda row: row[0]):
                if part is None or name != job:
                    jobs, job, own = jobs + 1, name, still
                if part is None:
                    part, first_job = batch.column("part")[0].as_py(), name
                for _, arrives in own_rows:
                    own = own.then(arrival if arrives else departure)
        if part is not None:
            ids = [pa.array([v], batch.schema.field("job_id").type) for v in (first_job, job)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *ids, pa.array([jobs == 1]), pa.array([list(own)], pa.list_(pa.int64()))],
                ["part", "first_job", "last_job", "one_job", "last"],
            )

    needed = dealt.select("part", "job_id", "arrives")
    ends = needed.mapInArrow(
        reduce_ends, f"part int, first_job {kind}, last_job {kind}, one_job boolean, last array<bigint>"
    )
    entries = log.sparkSession.sparkContext.broadcast(_entries([r.asDict() for r in ends.collect()]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, job, waiting = False, None, 0
        for batch in batches:
            met = []
            for name, arrives in zip(batch.column("job_id").to_pylist(), batch.column("arrives").to_pylist(), strict=True):
                if not started:
                    started, job, waiting = True, name, entries.value[batch.column("part")[0].as_py()]
                elif name != job:
                    job, waiting = name, 0
                met.append(waiting)
                waiting = (arrival if arrives else departure)(waiting)
            kept = [batch.column(c) for c in ("job_id", "batch_id", "ts", "seq", "arrives")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(met, pa.int64())], ["job_id", "batch_id", "ts", "seq", "arrives", "queued"]
            )

    times = log.schema["ts"].dataType.simpleString(), log.schema["seq"].dataType.simpleString()
    decided = dealt.mapInArrow(
        decide,
        f"job_id {kind}, batch_id {batch_kind}, ts {times[0]}, seq {times[1]}, arrives boolean, queued bigint",
    )
    full = F.col("queued") >= max_queued
    return decided.filter("arrives").select(
        "job_id", "batch_id", "ts", "seq", "queued", F.when(full, CODE).alias("error_code"), (~full).alias("admitted")
    )
