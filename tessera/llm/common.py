"""Helpers shared by the operators: tables, the shared folder, lineage cuts and connected components."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; set here only where it is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/tessera-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a written copy in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Seconds that release() waits for Py4J's queue at most.
QUEUED = 5


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files and checkpoints of finished steps now, instead of when the driver happens to collect its garbage.

    Py4J queues what Python has dropped and tells the JVM up to a second later; a collection before that would find it all still held.
    """
    gc.collect()
    queue = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)  # without one the JVM knows already
    until = time.monotonic() + QUEUED
    while queue and time.monotonic() < until:
        time.sleep(0.02)
    time.sleep(0.02)  # the last one is on its way
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for files that an operator writes; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Recent(dict):
    """A look-up of make(key) that holds what was used of late: between ``most`` and twice as many entries.

    Keys longer than LONG_KEY are made anew each time, so entries bound bytes too.
    """

    LONG_KEY = 64

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(key) > self.LONG_KEY:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: What this Python worker keeps from task to task.
_kept: dict = {}


def kept(make, *key):
    """make(*key), kept by a Python worker from task to task until it makes something else, so it never has two operators' tables."""
    if (make, *key) not in _kept:
        _kept.clear()
        gc.collect()  # tables and what fills them refer to each other
        _kept[make, *key] = make(*key)
    return _kept[make, *key]


#: Rows of a broadcast at most.
BROADCAST = 400_000


def semi(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi", most: int | None = None) -> DataFrame:
    """The rows of df whose ``on`` is in keys: broadcast if the keys are counted and few, else a shuffled join."""
    return df.join(F.broadcast(keys) if keys.count() <= (BROADCAST if most is None else most) else keys, on, how)


def unused(df: DataFrame) -> str:
    """A name that no column of df has."""
    return f"_{'_'.join(df.columns)}"


def words(text: Column) -> Column:
    """The words of a text; of null: an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def components(edges: DataFrame, limit: int = 40) -> DataFrame:
    """Connected components of edges (a, b): a row (node, component) for each node in an edge, with its smallest node.

    Alternates large-star and small-star steps: every step is a grouped minimum and an equi-join, so a hub is
    pre-aggregated before the shuffle and no group is held in memory. Edges with a null end are no edges.
    Loops and repeated edges count once. An empty table gives an empty result.
    """
    cur = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = cut(cur)
    state = None
    for _ in range(limit):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
