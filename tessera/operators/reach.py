"""Reachability: breadth-first rings as joins, shared by the verbs that walk the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Graph, grade
from ..plans.lineage import cut


def steps(graph: Graph, direction: str, relations, min_confidence: int) -> DataFrame:
    """(here, there, rel, confidence, outward)"""
    edges = graph.edges
    if relations:
        edges = edges.where(F.col("rel").isin(*relations))
    if min_confidence > 0:
        edges = edges.where(F.col("confidence") >= min_confidence)
    out = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "rel", "confidence", F.lit(True).alias("outward"))
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "rel", "confidence", F.lit(False).alias("outward"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def reach(graph: Graph, seeds: DataFrame, direction: str = "out", relations=("calls",), max_depth: int = 1, min_confidence: int = 0) -> DataFrame:
    """(id, depth, via, rel, confidence, outward): nodes reached from seeds (id), at their least depth.

    Of the steps that reach a node first, that from the smallest node is told, then by relation. max_depth 0 walks until nothing is new.
    A ring is a join and a grouped minimum, which combines before it shuffles; lineage is cut at each ring beyond the second.
    """
    moves = steps(graph, direction, relations, min_confidence)
    if max_depth == 0 or max_depth > 2:
        moves = cut(moves)
    met = seeds.select("id").distinct()
    ring, rings, depth = met, [], 0
    while max_depth == 0 or depth < max_depth:
        depth += 1
        first = F.min(F.struct(F.col("here").alias("via"), "rel", (-F.col("confidence")).alias("less"), "outward")).alias("s")
        new = ring.withColumnRenamed("id", "here").join(moves, "here").groupBy(F.col("there").alias("id")).agg(first).join(met, "id", "left_anti")
        new = new.select("id", F.lit(depth).alias("depth"), "s.via", "s.rel", (-F.col("s.less")).alias("confidence"), "s.outward")
        if max_depth == 0 or max_depth > 2:
            new = cut(new)
            if new.isEmpty():
                break
        rings.append(new)
        ring, met = new.select("id"), met.unionByName(new.select("id"))
    if not rings:
        return new
    out = rings[0]
    for r in rings[1:]:
        out = out.unionByName(r)
    return out.withColumn("grade", grade(F.col("confidence")))


def ring_split(graph: Graph, seeds: DataFrame, depth: int, **how) -> tuple[DataFrame, DataFrame]:
    """Steps up to a depth, and a row (frontier) with the size of the next ring."""
    all_ = reach(graph, seeds, max_depth=depth + 1, **how)
    return all_.where(F.col("depth") <= depth), all_.agg(F.count(F.when(F.col("depth") == depth + 1, 1)).alias("frontier"))


@dataclass(frozen=True)
class Scope:
    """Which nodes a view shows; it hides rows and never changes a walk."""

    within: tuple = ()
    exclude: tuple = ()
    classes: tuple = ()
    kinds: tuple = ()
    exported: bool | None = None
    changed: tuple | None = None

    def admits(self) -> Column:
        under = lambda p: (F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")
        out = F.lit(True)
        for paths, keep in ((self.within, True), (self.exclude, False), (self.changed, True)):
            if paths:
                hit = F.lit(False)
                for p in paths:
                    hit = hit | under(p)
                out = out & (hit if keep else ~hit)
        if self.changed == ():
            out = F.lit(False)
        if self.classes:
            out = out & path_class(F.col("path")).isin(*self.classes)
        if self.kinds:
            out = out & F.col("kind").isin(*self.kinds)
        return out if self.exported is None else out & (F.col("exported") == self.exported)


def path_class(path: Column) -> Column:
    """source, test, vendored or generated, by the components of a path."""
    has = lambda *words: path.rlike(f"(^|/)({'|'.join(words)})(/|$)")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(has("vendor", "third_party", "node_modules"), "vendored").when(has("generated", "gen", "__generated__") | name.rlike(r"\.(pb|gen|generated)\.|_pb2"), "generated").when(has("test", "tests", "spec", "__tests__") | name.rlike(r"(^test_|_test\.|\.test\.|\.spec\.)"), "test").otherwise("source")


def scoped(rows: DataFrame, graph: Graph, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """Rows (id) that the scope shows, and a row (outside_scope) that counts the others."""
    flagged = rows.join(graph.nodes.select("id", scope.admits().alias("__in")), "id", "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
    return flagged.where("__in").drop("__in"), flagged.agg(F.count(F.when(~F.col("__in"), 1)).alias("outside_scope"))


def impact(graph: Graph, changed: DataFrame, relations=schema.REFERENTIAL, max_depth: int = 1, min_confidence: int = 0) -> tuple[DataFrame, DataFrame]:
    """What depends on changed files (path): rows of reach() inwards from all nodes in them, and a row of counts."""
    paths = changed.select("path").distinct()
    seeds = graph.nodes.join(paths, "path", "left_semi").select("id", "path")
    counts = paths.join(seeds.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "left").agg(F.count(F.lit(1)).alias("changed"), F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("seeds"))
    return reach(graph, seeds, "in", relations, max_depth, min_confidence), counts
