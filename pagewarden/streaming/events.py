"""Event operators: batch forms, and stateful forms on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import exact, masked


def scan_times(changes: DataFrame, delay: int, pause: int) -> DataFrame:
    """page_id, scan_at: a timer of ``delay`` starts at a page's first change; later changes don't move it, and a scan
    within ``pause`` of the last one is dropped.  ``changes`` has page_id and at in milliseconds; rows without page_id are one page, those without a time are left out.

    A page's changes pass in order and leave two numbers behind, so no page is ever held as a whole.
    """

    def run(batches):
        page, timer, last = None, None, None
        for pdf in batches:
            at, ids, known = pdf["at"].to_numpy(np.int64), pdf["page_id"].to_numpy(np.int64), pdf["page_id_known"].to_numpy(bool)
            turns = np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1])) + 1
            out = []
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(at)], strict=True):
                if a == b:
                    continue
                if (name := (int(ids[a]), bool(known[a]))) != page:
                    if timer is not None and (last is None or timer - last >= pause):
                        out.append((*page, timer))
                    page, timer, last = name, None, None
                k = a
                while k < b:
                    if timer is not None:
                        # The first change that the timer doesn't cover; it has fired by then.
                        k += int(np.searchsorted(at[k:b], timer, "left"))
                        if k == b:
                            break
                        if last is None or timer - last >= pause:
                            out.append((*page, timer))
                            last = timer
                    timer = int(at[k]) + delay
            yield _scans(out)
        if timer is not None and (last is None or timer - last >= pause):
            yield _scans([(*page, timer)])

    rows = changes.filter("at IS NOT NULL").select(*exact("page_id"), F.col("at").cast("long").alias("at"))
    order = ["page_id_known", "page_id"]
    return rows.repartition(*order).sortWithinPartitions(*order, "at").mapInPandas(run, "page_id long, scan_at long")


def _scans(found: list[tuple]) -> pd.DataFrame:
    ids = masked(np.asarray([f[0] for f in found], np.int64), np.asarray([f[1] for f in found], bool))
    return pd.DataFrame({"page_id": ids, "scan_at": np.asarray([f[2] for f in found], np.int64)})


def in_order_stream(events: DataFrame, key: str, fold: Callable, tick: Callable, state: str, out: str, lateness: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """A stateful operator of a stream (``key``, event_id, event_type, ts) that takes each key's events in the order of (ts, event_id), however batches cut them.

    Events wait in the state until the watermark has passed them; those that come later than ``lateness`` are dropped.  ``fold(values, at, event_id,
    event_type)`` and ``tick(values, mark)`` give the next values and rows of ``out``; ``tick`` comes after the events up to the watermark (both in
    microseconds), and gives the time at which it wants to be called again, or null.  ``values`` starts as nulls in the columns of ``state``; a key whose
    values are all null and that has no waiting event is forgotten.  Events of other types than ``only`` just move the watermark: they are left out in
    the step, as Spark takes a filter on the type below the watermark, which then stops at the last event of these kinds.
    """
    width, columns = len(state.split(", ")), [c.split()[0] for c in out.split(", ")]

    def step(name, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        values, wait = (None,) * width, []
        if held.exists:
            *values, times, ids, kinds = held.get
            values, wait = tuple(values), list(zip(times, ids, kinds, strict=True))
        for pdf in () if held.hasTimedOut else batches:
            pdf = pdf if only is None else pdf[pdf["event_type"].isin(only)]
            wait += [(int(t.value // 1000), int(i), k) for t, i, k in zip(pdf["ts"], pdf["event_id"], pdf["event_type"], strict=True)]
        mark, rows = held.getCurrentWatermarkMs() * 1000, []
        wait.sort()
        for event in [w for w in wait if w[0] <= mark]:
            values, found = fold(values, *event)
            rows += found
        wait = [w for w in wait if w[0] > mark]
        values, found, due = tick(values, mark)
        rows += found
        due = min([w[0] for w in wait[:1]] + [d for d in (due,) if d is not None], default=None)
        if any(v is not None for v in values) or wait:
            held.update((*values, [w[0] for w in wait], [w[1] for w in wait], [w[2] for w in wait]))
            if due is not None:
                held.setTimeoutTimestamp(max(mark // 1000 + 1, -(-due // 1000)))
        elif held.exists:
            held.remove()
        yield pd.DataFrame([(name[0], *r) for r in rows], columns=[key, *columns]).astype("int64")

    kept = f"{state}, times array<long>, ids array<long>, kinds array<string>"
    return events.withWatermark("ts", lateness).select(key, "event_id", "event_type", "ts").groupBy(key).applyInPandasWithState(step, f"{key} long, {out}", kept, "append", "EventTimeTimeout")


def scan_stream(changes: DataFrame, key: str, delay: int, pause: int, lateness: str = "1 hour") -> DataFrame:
    """The stateful form of ``scan_times`` for a stream (``key``, event_id, event_type, ts); ``delay`` and ``pause`` in milliseconds.

    A timer fires when the watermark passes it; a page is forgotten once no pause can drop its next scan.
    """
    delay, pause = 1000 * delay, 1000 * pause

    def fired(timer, last):
        fires = last is None or timer - last >= pause
        return (timer, [(timer // 1000,)]) if fires else (last, [])

    def fold(values, at, event_id, event_type):
        timer, last = values
        rows = []
        if timer is not None and timer <= at:
            (last, rows), timer = fired(timer, last), None
        return (at + delay if timer is None else timer, last), rows

    def tick(values, mark):
        timer, last = values
        rows = []
        # An event at the timer's own time may still be on its way, but it only starts the next timer.
        if timer is not None and timer <= mark:
            (last, rows), timer = fired(timer, last), None
        if timer is None and last is not None and last + pause <= mark + delay:
            last = None
        return (timer, last), rows, timer if timer is not None else (last + pause - delay if last is not None else None)

    return in_order_stream(changes, key, fold, tick, "timer long, last long", "scan_at long", lateness)


def change_feed(events: DataFrame, key: str, change: str, begin: str, end: str, *, hold: bool = False) -> DataFrame:
    """``key``, event_id, told_by: the changes that a key's follower gets, in a batch of events (``key``, event_id, event_type, ts).

    While the key is busy (from ``begin`` to ``end``) changes are ignored, or with ``hold`` the last of them is told by the event that ends it.
    Other changes are told by themselves.  A begin within a busy time, and an end outside one, mean nothing.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    busy = F.last(F.when(F.col("event_type").isin(begin, end), F.col("event_type")), ignorenulls=True).over(w) == begin
    rows = events.filter(F.col("event_type").isin(change, begin, end)).withColumn("busy", F.coalesce(busy, F.lit(False)))
    told = rows.filter((F.col("event_type") == change) & ~F.col("busy")).select(key, "event_id", F.col("event_id").alias("told_by"))
    if not hold:
        return told
    # A busy time is what stands between two ends; its last change waits for the end after it.
    spans = rows.withColumn("span", F.count_if(F.col("event_type") == end).over(w) - F.when(F.col("event_type") == end, 1).otherwise(0))
    place = F.struct("ts", "event_id")
    last = spans.groupBy(key, "span").agg(F.max_by("event_id", F.when((F.col("event_type") == change) & F.col("busy"), place)).alias("event_id"), F.max(F.when(F.col("event_type") == end, F.col("event_id"))).alias("told_by"))
    return told.unionByName(last.filter("event_id IS NOT NULL AND told_by IS NOT NULL").select(key, "event_id", "told_by"))


def change_stream(events: DataFrame, key: str, change: str, begin: str, end: str, *, hold: bool = False, lateness: str = "1 hour") -> DataFrame:
    """The stateful form of ``change_feed``: the same rows under any cut into batches, as long as no event is later than ``lateness``."""

    def fold(values, at, event_id, event_type):
        busy, waiting = values
        if event_type == begin:
            return (1, waiting), []
        if event_type == end:
            return (None, None), [(waiting, event_id)] if busy and waiting is not None else []
        if busy:
            return (busy, event_id if hold else None), []
        return values, [(event_id, event_id)]

    return in_order_stream(events, key, fold, lambda values, mark: (values, [], None), "busy long, waiting long", "event_id long, told_by long", lateness, (change, begin, end))


def debounced(events: DataFrame, key: str, gap: str) -> DataFrame:
    """One row for each burst of a key: when it starts, how many events, the last one.  Works on batches and, below a
    watermark on ts, on streams."""
    grouped = events.groupBy(key, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event")).select(key, F.col("w.start").alias("session_start"), "n", "last_event")


def _before(events: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    own = events.filter(F.col("event_type").isin(kinds))
    return own.select(key, "event_id", "event_type", "ts", F.lag("event_type").over(w).alias("b_type"), F.lag("event_id").over(w).alias("b_id"), F.lag("ts").over(w).alias("b_ts"))


def started(events: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Begin events of a key that find none under way."""
    return _before(events, key, [begin, end]).filter((F.col("event_type") == begin) & (F.col("b_type").isNull() | (F.col("b_type") != begin)))


def continuations(events: DataFrame, key: str, put: str, take: str, ttl_seconds: int) -> DataFrame:
    """Each take with the put just before it, which it uses up, if that is not older than the limit."""
    rows = _before(events, key, [put, take]).filter((F.col("event_type") == take) & (F.col("b_type") == put))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("b_ts").cast("timestamp"))
    return rows.filter(age <= ttl_seconds * 1_000_000).select(key, "event_id", F.col("b_id").alias("set_id"))


def continuation_stream(events: DataFrame, put: str, take: str, ttl_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """The stateful form of ``continuations`` for a stream (user_id, event_id, event_type, ts).

    Rows wait in the state until the watermark has passed them, so they are taken in the order of event time however the batches cut
    them; rows that come later than ``lateness`` are dropped.  A key's state is one value with its time and the rows that
    wait; the value goes when it is taken or when the watermark is past its limit.
    """
    ttl = ttl_seconds * 1_000_000

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, held_at, times, ids, puts = state.get if state.exists else (None, None, [], [], [])
        wait = list(zip(times, ids, puts, strict=True))
        for pdf in () if state.hasTimedOut else batches:
            pdf = pdf[pdf["event_type"].isin([put, take])]
            wait += [(int(t.value // 1000), int(i), k == put) for t, i, k in zip(pdf["ts"], pdf["event_id"], pdf["event_type"], strict=True)]
        mark, out = state.getCurrentWatermarkMs(), []
        wait.sort()
        for at, event_id, is_put in [w for w in wait if w[0] <= mark * 1000]:
            if is_put:
                held, held_at = event_id, at
            else:
                if held is not None and at - held_at <= ttl:
                    out.append((key[0], event_id, held))
                held, held_at = None, None
        wait = [w for w in wait if w[0] > mark * 1000]
        if held is not None and held_at + ttl < mark * 1000:
            held, held_at = None, None
        due = [w[0] for w in wait[:1]] + ([] if held is None else [held_at + ttl])
        if due:
            state.update((held, held_at, [w[0] for w in wait], [w[1] for w in wait], [w[2] for w in wait]))
            state.setTimeoutTimestamp(max(mark + 1, -(-min(due) // 1000)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "set_id"]).astype("int64")

    # Events of other types move the watermark too, so they are left out in the step: Spark would take a filter below it.
    own = events.withWatermark("ts", lateness)
    kept = "held long, held_at long, times array<long>, ids array<long>, puts array<boolean>"
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, set_id long", kept, "append", "EventTimeTimeout")


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each key, the later event_id at equal times where there is one; a running aggregate on a stream."""
    order = F.struct(*[c for c in ("ts", "event_id") if c in events.columns])
    return events.groupBy("user_id").agg(F.max_by("event_type", order).alias("status"), F.max("ts").alias("at"))
