"""Streaming rules with event-time timers: request timeouts and last-request-wins.

Rows of a key may arrive in any order within the watermark's delay.  They wait in state
until the watermark has passed them and are then settled in order of time, so a result
does not depend on how the input was cut into triggers.  Rows later than the watermark are
dropped before they get here.  Timers wake keys for their next waiting row or deadline;
nothing is kept for a key once its last deadline has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glossa import limits

SECOND = 1_000_000
#: Kinds of marks, in the order in which marks of one instant count.
SENT, OTHER, CONTENT, END = range(4)
#: Null in a state: lists of a state may not hold nulls among whole numbers.
NONE = -(1 << 62)
#: Parts that the keys are dealt over; each has its state and timers.
SLOTS = 2_048


class OrderedProcessor(StatefulProcessor):
    """Holds rows back until the watermark passes their time, in microseconds, in column ``at``.

    Every call of a state is a round trip, so keys are dealt over slots, and a slot has the
    state of all its keys: calls are made per slot and trigger, not per key.
    """

    #: Columns of a waiting row and of what is known of a key, whole numbers, ``NONE`` for null.
    #: Rows of a key are settled in order of the first two, ``at`` and another one.
    fields: tuple[str, ...] = ()
    known: tuple[str, ...] = ()
    #: Columns of a result behind the key.
    columns: tuple[str, ...] = ()
    times: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["key string", *(f"{name} bigint" for name in self.fields)]))
        self.open = handle.getListState("open", ", ".join(["key string", *(f"{name} bigint" for name in self.known)]))
        self.settled: dict[Any, int] = {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = self.wanted([row for part in rows for row in zip(*(part[c].tolist() for c in ("key", *self.fields)), strict=True)])
        if new:
            self.waiting.appendList(new)
            self.wake(min(row[1] for row in new))
        return
        yield

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.settled.get(key) == now:
            return  # another timer of the slot came first
        self.settled[key] = now
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        facts = {row[0]: tuple(_null(v) for v in row[1:]) for row in self.open.get()} if self.open.exists() else {}
        due: dict[str, list[tuple]] = {name: [] for name in facts}
        later = []
        for row in rows:
            if row[1] <= now:
                due.setdefault(row[0], []).append(tuple(_null(v) for v in row[1:]))
            else:
                later.append(tuple(row))
        wakes, out, left = [row[1] for row in later], [], []
        for name, own in due.items():
            done, state, deadline = self.settle(facts.get(name), sorted(own, key=lambda row: row[:2]), now)
            out += [(name, *row) for row in done]
            if state is not None:
                left.append((name, *(NONE if v is None else v for v in state)))
            if deadline is not None:
                wakes.append(deadline)
        if len(later) < len(rows):
            _put(self.waiting, later)
        if left or facts:
            _put(self.open, left)
        if wakes:
            self.wake(min(wakes))
        if out:
            frame = pd.DataFrame(out, columns=["key", *self.columns])
            for c in self.times:
                frame[c] = pd.to_datetime(frame[c].astype("Int64"), unit="us").astype("datetime64[us]")
            yield frame

    def wake(self, at: int) -> None:
        """Timers have whole milliseconds; the next one after ``at``."""
        self.handle.registerTimer(int(-(-at // 1000)))

    def wanted(self, rows: list[tuple]) -> list[tuple]:
        """The rows, with their keys in front, that have to wait."""
        return rows

    def settle(self, state: tuple | None, due: list[tuple], now: int) -> tuple[list[tuple], tuple | None, int | None]:
        """Results of the rows of a key that are due, what is known of it from then on, and its next deadline."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _null(value: int) -> int | None:
    return None if value == NONE else value


def _put(state: Any, rows: list[tuple]) -> None:
    state.put(rows) if rows else state.clear()


def _by_slots(rows: DataFrame, key: str, processor: OrderedProcessor, results: str, slots: int) -> DataFrame:
    """Results of the processor over ``rows``, which have ``key``, ts and the fields of the processor."""
    # Null keys are one key; in the state, keys are strings behind a mark.
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))
    dealt = rows.select(
        F.pmod(F.xxhash64(key), F.lit(slots)).alias("slot"),
        "ts",
        named.alias("key"),
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(NONE)).alias(c) for c in processor.fields],
    )
    found = dealt.groupBy("slot").transformWithStateInPandas(processor, f"key string, {results}", "Append", "EventTime")
    own = F.when(F.col("key") != "-", F.expr("substring(key, 2)")).cast(rows.schema[key].dataType).alias(key)
    return found.select(own, *[c for c in found.columns if c != "key"])


class TimeoutProcessor(OrderedProcessor):
    """The timer of a request that fires first, or none when it ends before."""

    fields = ("at", "mark")
    #: Times that are known so far; ``rank`` is a timer that fired before the request itself was seen.
    known = ("sent", "head", "content", "active", "fired", "rank", "done")
    columns, times = ("error_code", "fired_at"), ("fired_at",)
    CODES = ("REQUEST_TOTAL_TIMEOUT", "RESPONSE_HEADER_TIMEOUT", "FIRST_CONTENT_TIMEOUT", "STREAM_TIMEOUT")

    def __init__(self, header_s: int, first_content_s: int, idle_s: int, total_s: int):
        self.header, self.first_content, self.idle, self.total = (
            s * SECOND for s in (header_s, first_content_s, idle_s, total_s)
        )

    def wanted(self, rows: list[tuple]) -> list[tuple]:
        """Of rows of a key without content only the first counts: it starts the response."""
        plain: dict[str, tuple] = {}
        for row in rows:
            if row[2] == OTHER and (row[0] not in plain or row < plain[row[0]]):
                plain[row[0]] = row
        return [row for row in rows if row[2] != OTHER] + list(plain.values())

    def _deadlines(self, f: dict) -> list[tuple[int, int]]:
        timers = []
        if f["sent"] is not None:
            timers.append((f["sent"] + self.total, 0))
            if f["head"] is None:
                timers.append((f["sent"] + self.header, 1))
        if f["head"] is not None and f["content"] is None:
            timers.append((f["head"] + self.first_content, 2))
        if f["active"] is not None:
            timers.append((f["active"] + self.idle, 3))
        return timers

    def _fire(self, f: dict, before: int) -> None:
        """Note the first timer that is up before ``before``."""
        if f["fired"] is None and (up := min((t for t in self._deadlines(f) if t[0] < before), default=None)):
            f["fired"], f["rank"] = up

    def settle(self, state: tuple | None, due: list[tuple], now: int) -> tuple[list[tuple], tuple | None, int | None]:
        f = dict(zip(self.known, state or [None] * len(self.known), strict=True))
        if f["done"] is not None:
            if now >= f["done"] + self.total:
                return [], None, None
            return [], state, f["done"] + self.total
        ended = None
        for at, mark in due:
            self._fire(f, at)
            if mark == SENT:
                f["sent"] = at if f["sent"] is None else f["sent"]
            else:
                f["head"] = at if f["head"] is None else f["head"]
                if mark == CONTENT:
                    f["content"], f["active"] = (at if f["content"] is None else f["content"]), at
                elif mark == END and ended is None:
                    ended = at
            if f["sent"] is not None and (f["fired"] is not None or ended is not None):
                break
        if ended is None:
            self._fire(f, now + 1)
        out, closed = [], f["fired"] if f["fired"] is not None else ended
        if f["sent"] is not None and closed is not None:
            out.append((self.CODES[f["rank"]] if f["fired"] is not None else None, f["fired"]))
            f["done"] = closed
        elif f["sent"] is None and f["head"] is not None and now >= f["head"] + self.total:
            return [], None, None  # chunks whose request never came
        state = tuple(f[name] for name in self.known)
        if f["done"] is not None:
            return out, state, f["done"] + self.total
        open_timers = [t for t, _ in self._deadlines(f) if t > now]
        if f["sent"] is None and f["head"] is not None:
            open_timers.append(f["head"] + self.total)
        return out, state, min(open_timers, default=None)


def timeouts_stream(
    chunks: DataFrame,
    requests: DataFrame,
    header_s: int = limits.HEADER_TIMEOUT_S,
    first_content_s: int = limits.FIRST_CONTENT_TIMEOUT_S,
    idle_s: int = limits.IDLE_TIMEOUT_S,
    total_s: int = limits.TOTAL_TIMEOUT_S,
    delay: str = "1 minute",
    slots: int = SLOTS,
) -> DataFrame:
    """Streaming ``stream_timeouts``: one row per request as soon as the watermark settles it.

    Rows of one response should not be later than ``delay``; later ones are dropped, as if
    they had not come.  Chunks without a request give no row.  Needs the RocksDB state store.
    """
    kind = F.when(F.col("is_end"), END).when(F.col("is_content"), CONTENT).otherwise(OTHER)
    # A chunk with content that also ends the response counts as both.
    kinds = F.when(F.col("is_content") & F.col("is_end"), F.array(F.lit(CONTENT), F.lit(END))).otherwise(F.array(kind))
    marks = requests.select("request_id", F.col("sent_at").alias("ts"), F.lit(SENT).alias("mark")).unionByName(
        chunks.select("request_id", "ts", F.explode(kinds).alias("mark"))
    )
    timed = marks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select("request_id", "ts", _micros("ts").alias("at"), "mark")
    processor = TimeoutProcessor(header_s, first_content_s, idle_s, total_s)
    return _by_slots(rows, "request_id", processor, "error_code string, fired_at timestamp", slots)


class SupersedeProcessor(OrderedProcessor):
    """Holds the one open request of a user until the next one comes or its end has passed."""

    fields = known = ("at", "event_id", "until")
    columns, times = ("ts", "event_id", "end_ts", "is_superseded"), ("ts", "end_ts")

    def settle(self, state: tuple | None, due: list[tuple], now: int) -> tuple[list[tuple], tuple | None, int | None]:
        held, done = state, []
        for row in due:
            if held is not None:
                cut = held[2] is not None and row[0] < held[2]
                done.append((held[0], held[1], row[0] if cut else held[2], cut))
            held = row
        # A request is settled too once all rows up to its end have been seen.
        if held is not None and held[2] is not None and held[2] <= now:
            done.append((held[0], held[1], held[2], False))
            held = None
        return done, held, held[2] if held else None


def supersede_stream(requests: DataFrame, delay: str = "1 minute", slots: int = SLOTS) -> DataFrame:
    """Streaming ``supersede`` of ``user_id, ts, event_id, end_ts``: requests come out when settled.

    A request without an end is open until the next one of the user.  Needs the RocksDB
    state store.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select(
        "user_id", "ts", _micros("ts").alias("at"), F.col("event_id").cast("bigint").alias("event_id"),
        F.unix_micros(F.col("end_ts").cast("timestamp")).alias("until"),
    )
    results = "ts timestamp, event_id bigint, end_ts timestamp, is_superseded boolean"
    return _by_slots(rows, "user_id", SupersedeProcessor(), results, slots)


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name))
