"""Sinks: a report of which the latest wins, and a table with one value a key, in batches and on streams."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder of the session's shared folder; a local one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/pagewarden-{uuid.uuid4().hex}"


def write_report(report: DataFrame, path: str) -> None:
    """Write the latest report as JSON lines over the one before it."""
    report.write.mode("overwrite").json(path)


class _Table:
    """The files of a keyed table: data folders, and a manifest for each finished write that names the folder of every bucket."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark._jvm
        self.system = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.at(self.path))) if self.system.exists(self.at(self.path)) else []

    def manifests(self) -> list[str]:
        """The finished writes, oldest first."""
        return [n for n in self.names() if n.endswith(".json") and not n.startswith(".")]

    def load(self, name: str) -> dict:
        source = self.system.open(self.at(f"{self.path}/{name}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def commit(self, name: str, manifest: dict) -> None:
        """Write a manifest under its name at once: readers see it whole or not at all."""
        draft = self.at(f"{self.path}/.{name}")
        out = self.system.create(draft, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if not self.system.rename(draft, self.at(f"{self.path}/{name}")):
            raise OSError(f"{self.path}/{name} is there already: another writer was faster")

    def delete(self, name: str) -> None:
        self.system.delete(self.at(f"{self.path}/{name}"), True)


def _generations(spark: SparkSession, path: str) -> list[str]:
    """The finished writes that are still kept, oldest first."""
    return _Table(spark, path).manifests()


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as its last finished write left it; empty before the first."""
    table = _Table(spark, path)
    found = table.manifests()
    folders = table.load(found[-1])["buckets"] if found else {}
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}/bucket={b}" for b, folder in folders.items()]) if folders else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, path: str, key: str, order: list[str], keep: int = 2, *, buckets: int = 64, batch_id: int | None = None, source: str = "") -> None:
    """Put the last row of each key of ``batch`` (by ``order``) over that of the table at ``path``.

    Keys are dealt over hash buckets (as many as the table's first write asked for), and only the buckets that the batch touches are read and written
    anew; the manifest of a write names the folder of each bucket, so readers see a whole table.  A ``batch_id`` of a ``source`` that is not above the
    last one written changes nothing.  A null key is a key.  Folders that the last ``keep`` manifests don't name go.
    """
    spark, columns = batch.sparkSession, batch.columns
    table = _Table(spark, path)
    found = table.manifests()
    old = table.load(found[-1]) if found else {"n": buckets, "buckets": {}, "batches": {}}
    if batch_id is not None and batch_id <= old["batches"].get(source, -1):
        return
    own = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(old["n"])).cast("int"))
    # A row a bucket: as many as the table has buckets.
    touched = {str(r[0]) for r in own.select("bucket").distinct().collect()}
    before = [f"{path}/{folder}/bucket={b}" for b, folder in old["buckets"].items() if b in touched]
    rows = own
    if before:
        rows = own.unionByName(spark.read.schema(batch.schema).parquet(*before).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(old["n"])).cast("int")))
    last = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select("bucket", "r.*")
    number = 1 + (int(found[-1].removesuffix(".json")) if found else 0)
    name = f"{number:012d}-{uuid.uuid4().hex}"
    if touched:
        last.repartition(min(len(touched), int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
    folders = old["buckets"] | dict.fromkeys(touched, name)
    table.commit(f"{number:012d}.json", {"n": old["n"], "buckets": folders, "batches": old["batches"] | ({} if batch_id is None else {source: batch_id})})
    for gone in table.manifests()[:-keep]:
        table.delete(gone)
    named = {folder for m in table.manifests() for folder in table.load(m)["buckets"].values()}
    for folder in table.names():
        if not folder.endswith(".json") and folder not in named:
            table.delete(folder)


def upsert_stream(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str, **options):
    """The same on a stream: each micro-batch is one upsert, and one that is repeated after a failure changes nothing."""
    put = lambda batch, number: upsert(batch, path, key, order, batch_id=number, source=checkpoint, **options)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
