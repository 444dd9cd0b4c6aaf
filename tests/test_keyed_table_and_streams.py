"""The keyed table writes what a batch touches; the throttle and the change feed give the same rows as streams under any cut."""

from __future__ import annotations

import datetime as dt
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagewarden.sources import sinks
from pagewarden.streaming import events as E

KEYED = "k long, at long, v string"


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def stored(path: str) -> dict[str, int]:
    return {str(p): p.stat().st_size for p in Path(path).rglob("*.parquet")}


def test_bytes_written_follow_the_batch(spark):
    path = folder()
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    sinks.upsert(rows, f"file://{path}/t", "k", ["at"], buckets=50)
    first = stored(path)
    assert len({Path(p).parent.name for p in first}) == 50
    sinks.upsert(spark.createDataFrame([(5, 2, "new"), (5, 0, "old")], KEYED), f"file://{path}/t", "k", ["at"])
    new = {p: n for p, n in stored(path).items() if p not in first}
    assert len({Path(p).parent.name for p in new}) == 1 and 20 * sum(new.values()) < sum(first.values())
    table = sinks.read_latest(spark, f"file://{path}/t", KEYED)
    assert table.count() == 20_000 and table.filter("k = 5").first().v == "new"


def test_a_batch_counts_once_and_readers_see_whole_tables(spark):
    path = f"file://{folder()}/t"
    one, two = spark.createDataFrame([(1, 1, "a"), (None, 1, "n"), (2**53 + 1, 1, "l")], KEYED), spark.createDataFrame([(1, 2, "b")], KEYED)
    sinks.upsert(one, path, "k", ["at"], batch_id=0, source="s")
    before = sinks.read_latest(spark, path, KEYED)
    sinks.upsert(two, path, "k", ["at"], batch_id=1, source="s")
    names = sinks._generations(spark, path)
    sinks.upsert(spark.createDataFrame([(1, 9, "again")], KEYED), path, "k", ["at"], batch_id=1, source="s")
    assert sinks._generations(spark, path) == names
    assert {(r.k, r.v) for r in before.collect()} == {(1, "a"), (None, "n"), (2**53 + 1, "l")}
    assert {(r.k, r.v) for r in sinks.read_latest(spark, path, KEYED).collect()} == {(1, "b"), (None, "n"), (2**53 + 1, "l")}
    sinks.upsert(one.limit(0), path, "k", ["at"], batch_id=2, source="s")
    sinks.upsert(two, path, "k", ["at"], batch_id=0, source="other")
    assert sinks.read_latest(spark, path, KEYED).count() == 3


def test_unfinished_writes_are_not_read(spark):
    path = folder()
    sinks.upsert(spark.createDataFrame([(1, 1, "a")], KEYED), f"file://{path}/t", "k", ["at"])
    spark.createDataFrame([(1, 5, "half")], KEYED).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"file://{path}/t/000000000002-dead")
    assert sinks.read_latest(spark, f"file://{path}/t", KEYED).first().v == "a"
    sinks.upsert(spark.createDataFrame([(2, 1, "b")], KEYED), f"file://{path}/t", "k", ["at"])
    assert sinks.read_latest(spark, f"file://{path}/t", KEYED).count() == 2 and not (Path(path) / "t" / "000000000002-dead").exists()


def events(n: int, seed: int) -> list[tuple]:
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    return [(k, start + dt.timedelta(milliseconds=rng.choice([0, 500, 37_000]) + 20_000 * k), rng.randint(0, 3), rng.choice(["click", "click", "view", "purchase"])) for k in range(n)]


def streamed(spark, rows: list[tuple], files: int, run, seed: int):
    """The rows of a stream that gets ``rows`` in ``files`` files, a file a batch, out of order within three hours, and then an event far ahead."""
    path, schema = folder(), "event_id long, ts timestamp, user_id long, event_type string"
    rows = rows.copy()
    random.Random(seed).shuffle(rows)
    last = (-1, dt.datetime(2024, 3, 1), -1, "view")
    for part in [*(rows[k::files] for k in range(files)), [last]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    out = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{path}/out").filter("user_id >= 0").collect())


@pytest.mark.parametrize("files, seed", [(1, 3), (7, 4)])
def test_throttle_stream_equals_batch(spark, files, seed):
    rows = events(150, seed)
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    batch = E.scan_times(frame.select(F.col("user_id").alias("page_id"), F.unix_millis("ts").alias("at")), 60_000, 400_000)
    got = streamed(spark, rows, files, lambda s: E.scan_stream(s, "user_id", 60_000, 400_000, "3 hours"), seed)
    assert got == sorted(map(tuple, batch.collect())) and len(got) > 8


@pytest.mark.parametrize("hold", [False, True])
@pytest.mark.parametrize("files, seed", [(1, 5), (6, 6)])
def test_change_stream_equals_batch(spark, hold, files, seed):
    rows = events(120, seed)
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    batch = E.change_feed(frame, "user_id", "click", "view", "purchase", hold=hold)
    want, busy, waiting = [], {}, {}
    for event_id, _, user, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "view":
            busy[user] = True
        elif kind == "purchase":
            if busy.pop(user, False) and hold and waiting.get(user) is not None:
                want.append((user, waiting[user], event_id))
            waiting[user] = None
        elif busy.get(user):
            waiting[user] = event_id
        else:
            want.append((user, event_id, event_id))
    assert sorted(map(tuple, batch.collect())) == sorted(want)
    got = streamed(spark, rows, files, lambda s: E.change_stream(s, "user_id", "click", "view", "purchase", hold=hold, lateness="3 hours"), seed)
    assert got == sorted(want)


def test_late_changes_are_dropped_by_the_stream(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(days=2), 1, "click"), (2, start, 1, "click")]
    path, schema = folder(), "event_id long, ts timestamp, user_id long, event_type string"
    for part in ([rows[0]], [(9, start + dt.timedelta(days=2, hours=1), 2, "click")], [rows[1]], [(-1, start + dt.timedelta(days=9), -1, "view")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    out = E.change_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in"), "user_id", "click", "view", "purchase")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert {r.event_id for r in spark.read.schema(out.schema).parquet(f"{path}/out").collect()} >= {1, 9}


@pytest.mark.parametrize("run, rows, want", [
    (lambda s: E.change_stream(s, "user_id", "click", "view", "purchase", hold=True), ["view", "click", "click", "purchase", "click"], [(1, 2, 3), (1, 4, 4)]),
    (lambda s: E.continuation_stream(s, "view", "purchase", 86_400), ["view", "click", "view", "purchase"], [(1, 3, 2)]),
])
def test_events_of_other_types_move_the_watermark(spark, run, rows, want):
    """The last event of a stream is of a type that the operator has no use for, and the ones before it come out all the same."""
    start, path = dt.datetime(2024, 1, 1), folder()
    own = [(k, start + dt.timedelta(minutes=k), 1, kind) for k, kind in enumerate(rows)]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for part in (own, [(-1, start + dt.timedelta(days=9), -1, "signup")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    out = run(spark.readStream.schema(schema).parquet(f"{path}/in"))
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{path}/out").collect())) == want


def test_throttle_of_odd_rows(spark):
    rows = [(None, 5), (None, 9), (1, None), (2**53 + 1, 7), (2**53 + 2, 8)]
    got = E.scan_times(spark.createDataFrame(rows, "page_id long, at long").coalesce(1), 10, 100).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 15), (2**53 + 1, 17), (2**53 + 2, 18)], key=str)
    assert E.scan_times(spark.createDataFrame([], "page_id long, at long"), 10, 100).collect() == []
