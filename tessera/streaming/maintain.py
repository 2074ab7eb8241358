"""Incremental maintenance: what a stream of changes leaves is what a build from scratch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_dir


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def latest(changes: DataFrame, key: str = "path", version: str = "version") -> DataFrame:
    """Of each key the row of the greatest version; a row that says deleted leaves nothing. One grouped maximum, no window over a key's history."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max(F.struct(version, *[c for c in rest if c != version])).alias("m")).select(key, "m.*")
    return last.where("not deleted") if "deleted" in changes.columns else last


class View:
    """A table kept by key: versions of it are folders, and a pointer names the current one.

    A batch of changes is merged into a new version: a full join by key of the batch's latest rows. A batch that was merged before is left out, so a batch can be tried again.
    """

    def __init__(self, spark: SparkSession, folder: str, layout: str, key: str = "path"):
        self.spark, self.folder, self.layout, self.key = spark, folder, layout, key
        self.version = -1

    def read(self) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], self.layout)
        return self.spark.read.schema(self.layout).parquet(f"{self.folder}/v{self.version}")

    def apply(self, changes: DataFrame, batch: int) -> None:
        if batch <= self.version:
            return
        own = self.read()
        last = changes.groupBy(self.key).agg(F.max(F.struct("version", "deleted", *[c for c in own.columns if c != self.key])).alias("m")).select(self.key, "m.*")
        kept = own.join(last.select(self.key), self.key, "left_anti")
        new = last.where("not deleted").select(*own.columns)
        kept.unionByName(new).write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        self.version = batch

    def follow(self, stream: DataFrame) -> None:
        """Merge all that a stream of changes (key, version, deleted, columns) has now."""
        q = stream.writeStream.foreachBatch(lambda df, i: self.apply(df, i)).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()
        q.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value), on a stream or a table; late rows beyond the watermark are left out of a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # event time is an instant
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def streamed_counts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """windowed_counts() of the Parquet files called ``name`` in a folder, read as a stream in micro-batches and written whole at the end."""
    layout = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(layout).option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder)
    at = shared(spark, "stream")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/{batch}")
        keep.last = batch

    keep.last = None
    q = windowed_counts(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    if keep.last is None:
        return windowed_counts(spark.createDataFrame([], layout))
    return spark.read.parquet(f"{at}/out/{keep.last}")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) by session windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def compacted(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Several appended parts as one, the later of equal keys winning."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    order = Window.partitionBy(*key).orderBy(F.desc("__part"))
    return cut(out.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__part"))
