"""A graph: its tables, and the derived columns that queries ask for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .plans.spread import spread


def eid(path: Column, name: Column) -> Column:
    """A durable identity: the first 128 bits of a digest of where a thing stands and what it is called."""
    return F.md5(F.concat_ws("\0", path, name))


def grade(confidence: Column) -> Column:
    return F.when(confidence >= 100, "exact").when(confidence >= 85, "constrained").when(confidence > 0, "heuristic").otherwise("structural")


@dataclass(frozen=True)
class Graph:
    """Nodes, edges and side tables as DataFrames; see schema for their columns.

    Derived columns (degrees, scc_size, community) are joined only to the queries that read them.
    """

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame | None = None
    dataflow: DataFrame | None = None
    observed: DataFrame | None = None
    files: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)
    kinds: tuple[str, ...] = (*schema.KINDS, *schema.DOMAIN_KINDS)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def side(self, name: str) -> DataFrame:
        """A side table; an absent one is empty."""
        found = getattr(self, name)
        return found if found is not None else self.spark.createDataFrame([], schema.EMPTY[name])

    def with_tables(self, **tables) -> Graph:
        return replace(self, **tables)

    def properties(self, names) -> DataFrame:
        """Nodes with id and the named properties."""
        names = [n for n in schema.PROPERTIES if n in names and n != "id"]
        out = self.nodes
        if {"in_degree", "out_degree"} & set(names):
            out = with_degrees(out, self.edges)
        for n, key in (("scc_size", "scc_size"), ("community", "community")):
            if n in names and n not in out.columns:
                if key in self.extra:
                    out = out.join(self.extra[key].select("id", n), "id", "left")
                else:
                    out = out.withColumn(n, F.lit(None).cast("long"))
        if "eid" in names and "eid" not in out.columns:
            out = out.withColumn("eid", eid(F.col("path"), F.col("name")))
        return out.select("id", *names)

    def query(self, text, **kw) -> DataFrame:
        """Rows of a graph query, given as text or as its JSON form."""
        from .plans.compile import run

        return run(self, text, **kw)


def degrees(edges: DataFrame, relations=None) -> DataFrame:
    """(id, in_degree, out_degree), over all relations or the given ones: both ends of an edge in one grouped sum."""
    edges = edges if relations is None else edges.where(F.col("rel").isin(*relations))
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return spread(ends, "id").groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def with_degrees(nodes: DataFrame, edges: DataFrame, relations=None) -> DataFrame:
    return nodes.join(degrees(edges, relations), "id", "left").fillna(0, ["in_degree", "out_degree"])
