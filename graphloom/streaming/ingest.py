"""Incremental ingest: a stream of file snapshots merged into a table of current digests, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(batch: DataFrame) -> DataFrame:
    """The last version of each path in a batch."""
    w = Window.partitionBy("path").orderBy(F.col("ts").desc(), F.col("digest"))
    return batch.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def changed_only(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch whose digest differs from the known one of their path."""
    return latest(batch).join(known.select("path", "digest"), ["path", "digest"], "left_anti")


def run(spark: SparkSession, source: DataFrame, state_dir: str, checkpoint_dir: str, late: str = "1 day", whole: int = 16):
    """Starts a query over a stream of (path, digest, ts) that appends what changed to ``state_dir``, then stops.

    Rows later than ``late`` behind the watermark are dropped together with their state. A replayed batch writes the same
    file set again under its own number, so nothing is counted twice. Every ``whole`` batches the current digests are
    written as one table, so a batch reads that and the few batches since. A folder is known by its mark of success, so a
    failed read is an error and never taken for an empty state.
    """
    schema = "path string, digest string, ts timestamp, batch long"

    def numbers(kind: str) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/{kind}=*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)

    def state(n: int) -> DataFrame:
        base = max((b for b in numbers("whole") if b < n), default=-1)
        dirs = [f"{state_dir}/whole={base}"] * (base >= 0) + [f"{state_dir}/batch={b}" for b in numbers("batch") if base < b < n]
        old = spark.read.schema("path string, digest string, ts timestamp").parquet(*dirs) if dirs else spark.createDataFrame([], schema)
        return latest(old.select("path", "digest", "ts"))

    def merge(batch: DataFrame, n: int) -> None:
        if n and n % whole == 0:
            state(n).write.mode("overwrite").parquet(f"{state_dir}/whole={n - 1}")
        known = state(n)
        changed_only(batch, known).select("path", "digest", F.col("ts").cast("timestamp"), F.lit(n).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{state_dir}/batch={n}")

    s = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "digest", "ts"])
    return s.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): events by tumbling window; works on a stream and on a table alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")
