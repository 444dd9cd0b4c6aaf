"""Event operators: throttling against a small model, and the stream against the batch form."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from pagewarden.streaming import events as E


def model(times, delay, pause):
    timer, last, out = None, None, []
    for at in [*sorted(times), float("inf")]:
        if timer is not None and timer <= at:
            if last is None or timer - last >= pause:
                out.append(timer)
                last = timer
            timer = None
        if timer is None and at != float("inf"):
            timer = at + delay
    return out


def test_scan_times(spark):
    rng = random.Random(5)
    pages = {p: [rng.randint(0, 60_000) for _ in range(rng.randint(1, 30))] for p in range(12)}
    rows = spark.createDataFrame([(p, t) for p, ts in pages.items() for t in ts], "page_id long, at long")
    found = {}
    for r in E.scan_times(rows, 2000, 15_000).collect():
        found.setdefault(r.page_id, []).append(r.scan_at)
    assert {p: sorted(v) for p, v in found.items()} == {p: model(ts, 2000, 15_000) for p, ts in pages.items()}


def test_continuation_stream_equals_batch(spark):
    """Events in ten files in no order, one file a batch; a last event far ahead lets the watermark pass all."""
    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=40 * k), rng.randint(0, 3), rng.choice(["signup", "purchase", "view"])) for k in range(200)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    path = tempfile.mkdtemp(prefix="spark-")
    rng.shuffle(rows)
    for k in range(10):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], frame.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    last = spark.createDataFrame([(-1, start + dt.timedelta(days=9), -1, "signup")], frame.schema)
    last.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = E.continuation_stream(stream, "signup", "purchase", 120, lateness="3 hours")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    batch = E.continuations(frame, "user_id", "signup", "purchase", 120).select("event_id", "set_id")
    got = spark.read.schema("user_id long, event_id long, set_id long").parquet(f"{path}/out").select("event_id", "set_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect())) and len(got) > 5


def test_debounce(spark):
    rows = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1, 0, 0, 0)), (1, 2, dt.datetime(2024, 1, 1, 0, 0, 1)), (1, 3, dt.datetime(2024, 1, 1, 0, 9, 0))], "user_id long, event_id long, ts timestamp")
    got = E.debounced(rows, "user_id", "5 seconds").select("n", "last_event").orderBy("last_event").collect()
    assert [tuple(r) for r in got] == [(2, 2), (1, 3)]


def test_latest_status(spark):
    rows = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (1, "b", dt.datetime(2024, 1, 2))], "user_id long, event_type string, ts timestamp")
    assert E.latest_status(rows).select(F.col("status")).first().status == "b"
