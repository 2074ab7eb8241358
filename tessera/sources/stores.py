"""Where graphs come from and where they go: file trees, folded stacks, commit logs, generations and one-folder artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Graph

# Languages by file extension.
LANGUAGES = {"py": "python", "html": "html", "htm": "html", "js": "javascript", "ts": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "sql": "sql", "css": "css", "sh": "bash"}
TABLES = ("nodes", "edges", "evidence", "dataflow", "observed", "files")
#: What a stored table's rows lie by: a filter on the first column reads few row groups, and no key's rows must share a file.
ORDERS = {"nodes": ("kind", "id"), "edges": ("rel", "src", "dst"), "observed": ("src", "dst")}


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, text, lang, size, digest, modified) of the files below a folder; undecodable bytes become replacement characters."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{root}/", "")
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return rows.select(path.alias("path"), F.expr("try_to_binary(base64(content), 'base64')").cast("string").alias("text"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), F.col("modificationTime").alias("modified")).withColumn("lang", F.coalesce(lang[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))], F.lit("other")))


def folded_stacks(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a file of folded stacks."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, seq, path) of a log with a line ``commit <id>`` before each commit's paths, the newest first."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", r"(?m)^commit "), lambda x: F.trim(x) != "")).alias("block"), F.monotonically_increasing_id().alias("f"))
    parts = lines.withColumn("n", -F.monotonically_increasing_id()).withColumn("l", F.split("block", "\n"))
    return parts.select(F.trim(F.col("l")[0]).alias("commit_id"), F.col("n").alias("seq"), F.explode(F.filter(F.transform(F.slice("l", 2, 1_000_000), F.trim), lambda x: x != "")).alias("path"))


def save(graph: Graph, folder: str) -> None:
    """One generation: a Parquet folder a table. Nodes lie by kind and edges by relation and source, so a walk forward reads few row groups."""
    for t in TABLES:
        rows = getattr(graph, t)
        if rows is not None:
            by = [c for c in ORDERS.get(t, ()) if c in rows.columns]
            rows = rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows
            rows.write.mode("errorifexists").parquet(f"{folder}/{t}")


def load(spark: SparkSession, folder: str) -> Graph:
    """A generation; tables that it lacks are absent."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda t: jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}").getFileSystem(context).exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}"))
    return Graph(**{t: spark.read.parquet(f"{folder}/{t}") for t in TABLES if there(t)})


class Generations:
    """Numbered generations below a folder; a pointer names the current one and moves only when a generation is whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def current(self) -> int | None:
        try:
            rows = self.spark.read.text(f"{self.folder}/CURRENT.*").agg(F.max(F.col("value").cast("int"))).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return rows[0]

    def publish(self, graph: Graph) -> int:
        n = (self.current() if self.current() is not None else -1) + 1
        save(graph, f"{self.folder}/gen-{n}")
        self.spark.range(1).select(F.lit(str(n)).alias("value")).coalesce(1).write.text(f"{self.folder}/CURRENT.{n}")
        return n

    def open(self, n: int | None = None) -> Graph:
        n = self.current() if n is None else n
        if n is None:
            raise ValueError("no generation")
        return load(self.spark, f"{self.folder}/gen-{n}")
