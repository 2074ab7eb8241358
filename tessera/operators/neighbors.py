"""Selecting nodes and what stands next to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Graph, grade, with_degrees
from ..functions.text import directory, shared_prefix
from ..plans.spread import spread

#: Relation of each verb, and whether it looks at edges that arrive.
VERBS = {"callers": ("calls", True), "callees": ("calls", False), "refs": ("references", True), "importers": ("imports", True), "implementors": ("implements", True), "typeusers": ("of_type", True), "similar": ("similar_to", False)}


def select(graph: Graph, name: str | None = None, path: str | None = None, kind: str | None = None, id: int | None = None, eid: str | None = None) -> DataFrame:
    """Nodes by id, else by durable id, else by exact name; kind and path suffix narrow them. An empty selector selects nothing."""
    rows = graph.nodes
    if id is not None:
        rows = rows.where(F.col("id") == id)
    elif eid is not None:
        rows = graph.nodes.where(F.lower("eid") == eid.lower()) if "eid" in rows.columns else rows.join(graph.properties({"eid"}).where(F.lower("eid") == eid.lower()), "id", "left_semi")
    elif name is not None:
        rows = rows.where(F.col("name") == name)
    elif path is None and kind is None:
        return rows.limit(0)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind.lower())
    return rows.where(F.col("path").endswith(path)) if path is not None else rows


def node_records(graph: Graph, **selector) -> DataFrame:
    """Selected nodes with their degrees over all relations."""
    return with_degrees(select(graph, **selector), graph.edges)


def by_pattern(graph: Graph, pattern: str) -> DataFrame:
    """Nodes whose name holds a match of the regular expression."""
    return graph.nodes.where(F.col("name").rlike(pattern))


def related(graph: Graph, verb: str, targets: DataFrame) -> DataFrame:
    """(target, id, confidence, grade): neighbours by a verb, each with the best confidence of its edges. targets has id."""
    rel, inbound = VERBS[verb]
    here, there = ("dst", "src") if inbound else ("src", "dst")
    edges = graph.edges.where(F.col("rel") == rel).select(F.col(here).alias("target"), F.col(there).alias("id"), "confidence")
    best = spread(edges, "target").join(targets.select(F.col("id").alias("target")), "target", "left_semi").groupBy("target", "id").agg(F.max("confidence").alias("confidence"))
    return best.withColumn("grade", grade(F.col("confidence")))


def lookup(graph: Graph, verb: str, every: bool = False, **selector) -> dict:
    """The envelope of a verb: no match, candidates if the selector is ambiguous, else hits. Two ids decide which it is."""
    chosen = select(graph, **selector)
    few = chosen.select("id").take(2)
    if not few:
        return {"status": "no-match", "rows": chosen}
    if len(few) > 1 and not every:
        return {"status": "ambiguous", "rows": chosen}
    return {"status": "hits", "rows": related(graph, verb, chosen)}


def call_sites(graph: Graph, hits: DataFrame, rel: str = "calls") -> DataFrame:
    """hits (holder, callee) with the 1-based line and trimmed text of the holder's first evidence of the callee."""
    first = graph.side("evidence").where((F.col("rel") == rel) & F.col("dst").isNotNull()).groupBy(F.col("src").alias("holder"), F.col("dst").alias("callee")).agg(F.min("span_start").alias("at"))
    placed = hits.join(first, ["holder", "callee"], "left").join(graph.nodes.select(F.col("id").alias("holder"), "path"), "holder", "left").join(graph.side("files").select("path", "text"), "path", "left")
    before = F.substr("text", F.lit(1), F.col("at"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return placed.withColumn("line", line.cast("bigint")).withColumn("code", F.trim(F.get(F.split("text", "\n"), F.col("line").cast("int") - 1))).drop("text", "at")


def observed(graph: Graph, targets: DataFrame) -> DataFrame:
    """(target, other, direction, cnt, in_static_graph): calls seen at run time, and whether the graph has them."""
    static = graph.edges.where("rel = 'calls'").select("src", "dst", F.lit(True).alias("known")).distinct()
    seen = graph.side("observed").join(static, ["src", "dst"], "left").withColumn("in_static_graph", F.coalesce("known", F.lit(False)))
    ids = targets.select(F.col("id").alias("target")).distinct()
    out = seen.select(F.col("src").alias("target"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "cnt", "in_static_graph")
    back = seen.select(F.col("dst").alias("target"), F.col("src").alias("other"), F.lit("in").alias("direction"), "cnt", "in_static_graph")
    return out.unionByName(back).join(ids, "target", "left_semi")


def containers(graph: Graph) -> DataFrame:
    """(id, container): what defines each node."""
    return graph.edges.where(F.col("rel").isin(*schema.CONTAINMENT)).select(F.col("dst").alias("id"), F.col("src").alias("container")).distinct()


def by_proximity(rows: DataFrame, anchor_path: str) -> DataFrame:
    """rows (id, path) with their rank: the same file first, then the longest shared directory prefix, ties by id."""
    same = (F.col("path") == anchor_path).cast("int")
    near = shared_prefix(directory(F.col("path")), directory(F.lit(anchor_path)))
    return rows.withColumn("shared", F.when(directory(F.col("path")) == "", 0).otherwise(near).cast("int")).withColumn("same_file", same).withColumn("position", F.row_number().over(Window.orderBy(F.desc("same_file"), F.desc("shared"), "id")))


def page(rows: DataFrame, order: list, limit: int = 100, cursor: str | None = None) -> dict:
    """One page of ordered rows: rows, total, truncated and the next cursor ``o:<offset>``."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    if cursor is not None and not (cursor.startswith("o:") and cursor[2:].isdigit()):
        raise ValueError("not a cursor")
    at, total = int(cursor[2:]) if cursor else 0, rows.count()
    more = at + limit < total
    return {"rows": rows.orderBy(*order).offset(at).limit(limit), "total": total, "truncated": more, "nextCursor": f"o:{at + limit}" if more else None}


def shaped(rows: DataFrame, shape: str = "json") -> DataFrame:
    """Column subsets: lean leaves out signature, span and eid; ids keeps id and eid."""
    drop = {"lean": ("signature", "span_start", "span_end", "eid"), "json": ()}
    return rows.select("id", "eid") if shape == "ids" else rows.drop(*drop[shape])


def toon(rows: DataFrame, title: str = "rows") -> str:
    """A page of rows as one header line and one line a row, with values as JSON."""
    import json

    got = rows.collect()
    lines = [",".join(json.dumps(v, default=str, ensure_ascii=False) for v in r) for r in got]
    return "\n".join([f"{title}[{len(got)}]{{{','.join(rows.columns)}}}:", *[f"  {x}" for x in lines]])
