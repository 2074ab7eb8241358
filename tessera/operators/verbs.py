"""Reports over a whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Graph, degrees, eid, grade
from ..functions.text import directory
from ..plans.spread import spread
from .reach import path_class

#: Kinds that can be dead.
MORTAL = ("function", "method", "class", "struct", "enum", "interface", "constructor")


def dead(graph: Graph, kinds=MORTAL, relations=schema.SEMANTIC, max_error_ratio: float = 0.10, prefix: str | None = None, exported: bool | None = None, exclude_tests: bool = False) -> DataFrame:
    """(id, kind, name, path, status): nodes of these kinds that no semantic edge reaches.

    status is ``dead``, or why a node is not reported as such: ``mentioned`` if evidence names it, ``damaged`` if its file parsed badly.
    """
    rows = graph.nodes.where(F.col("kind").isin(*kinds))
    if prefix is not None:
        rows = rows.where((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/"))
    if exported is not None:
        rows = rows.where(F.col("exported") == exported)
    if exclude_tests:
        rows = rows.where(path_class(F.col("path")) != "test")
    used = graph.edges.where(F.col("rel").isin(*relations)).select(F.col("dst").alias("id"))
    rows = rows.join(used, "id", "left_anti").select("id", "kind", "name", "path")
    named = graph.side("evidence").select("name").distinct().withColumn("mentioned", F.lit(True))
    bad = graph.side("files").where(F.col("error_bytes") > max_error_ratio * F.col("size")).select("path").distinct().withColumn("damaged", F.lit(True))
    status = F.when(F.col("mentioned"), "mentioned").when(F.col("damaged"), "damaged").otherwise("dead")
    return rows.join(named, "name", "left").join(bad, "path", "left").select("id", "kind", "name", "path", status.alias("status"))


def schema_report(graph: Graph) -> DataFrame:
    """(what, name, n): nodes by kind, edges by relation and edges by grade, most first."""
    kinds = graph.nodes.groupBy(F.lit("kind").alias("what"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rels = graph.edges.groupBy(F.lit("relation").alias("what"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    grades = graph.edges.groupBy(F.lit("grade").alias("what"), grade(F.col("confidence")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(rels).unionByName(grades).orderBy("what", F.desc("n"), "name")


def modules(graph: Graph, relations=schema.SEMANTIC) -> DataFrame:
    """(module, files, definitions, imported_by_others, imports_others) for each directory; the last two count edges across modules."""
    placed = graph.nodes.select("id", directory(F.col("path")).alias("module"), "path")
    base = placed.groupBy("module").agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("definitions"))
    edges = graph.edges.where(F.col("rel").isin(*relations)).select("src", "dst")
    a = edges.join(placed.select(F.col("id").alias("src"), F.col("module").alias("ms")), "src").join(placed.select(F.col("id").alias("dst"), F.col("module").alias("md")), "dst").where("ms <> md")
    # each edge across modules is one row here, then two counts that combine before the shuffle
    across = a.groupBy("ms", "md").agg(F.count(F.lit(1)).alias("n"))
    into = across.groupBy(F.col("md").alias("module")).agg(F.sum("n").alias("imported_by_others"))
    out = across.groupBy(F.col("ms").alias("module")).agg(F.sum("n").alias("imports_others"))
    return base.join(into, "module", "left").join(out, "module", "left").fillna(0, ["imported_by_others", "imports_others"])


def hubs(graph: Graph, top: int = 10, relations=schema.REFERENTIAL) -> DataFrame:
    """(id, name, in_degree): the nodes with most usage edges, ties by id."""
    ends = graph.edges.where(F.col("rel").isin(*relations)).select(F.col("dst").alias("id"))
    best = spread(ends, "id").groupBy("id").agg(F.count(F.lit(1)).alias("in_degree")).orderBy(F.desc("in_degree"), "id").limit(top)
    return best.join(graph.nodes.select("id", "name"), "id").select("id", "name", "in_degree").orderBy(F.desc("in_degree"), "id")


def entries(graph: Graph, top: int = 10, kinds=("function", "method"), relations=schema.SEMANTIC) -> DataFrame:
    """(id, name, path): exported definitions in source files that nothing uses, first by id."""
    used = graph.edges.where(F.col("rel").isin(*relations)).select(F.col("dst").alias("id"))
    rows = graph.nodes.where(F.col("exported") & F.col("kind").isin(*kinds) & (path_class(F.col("path")) == "source"))
    return rows.join(used, "id", "left_anti").select("id", "name", "path").orderBy("id").limit(top)


def clusters(graph: Graph, members: DataFrame, top: int = 10) -> DataFrame:
    """(community, members, face, module) of the largest communities: the face has most edges arriving, the module is the commonest directory."""
    known = members.join(graph.nodes.select("id", directory(F.col("path")).alias("module")), "id").join(degrees(graph.edges, ("calls",)).select("id", "in_degree"), "id", "left").fillna(0, ["in_degree"])
    sizes = known.groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.max_by("id", F.struct("in_degree", -F.col("id"))).alias("face"))
    plural = known.groupBy("community", "module").agg(F.count(F.lit(1)).alias("n")).groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("less"), "module")).alias("m"))
    return sizes.join(plural, "community").select("community", "members", "face", F.col("m.module").alias("module")).orderBy(F.desc("members"), "community").limit(top)


def diff_nodes(old: Graph, new: Graph) -> DataFrame:
    """(eid, kind, name, path, change): added, removed and modified nodes, matched by their durable id; files are left out."""

    def side(g: Graph, tag: str) -> DataFrame:
        rows = g.nodes if "eid" in g.nodes.columns else g.nodes.withColumn("eid", eid(F.col("path"), F.col("name")))
        return rows.where("kind <> 'file'").select("eid", *[F.col(c).alias(f"{c}_{tag}") for c in ("kind", "name", "path", "content_hash")])

    both = side(old, "a").join(side(new, "b"), "eid", "full")
    change = F.when(F.col("kind_a").isNull(), "added").when(F.col("kind_b").isNull(), "removed").when(~F.col("content_hash_a").eqNullSafe(F.col("content_hash_b")), "modified")
    return both.select("eid", *[F.coalesce(f"{c}_b", f"{c}_a").alias(c) for c in ("kind", "name", "path")], change.alias("change")).where("change is not null")


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, n): files (path, digest, size) added, removed, changed and unchanged."""
    a, b = (x.select("path", F.struct("digest", "size").alias(n)) for x, n in ((old, "a"), (new, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def diff_relations(old: Graph, new: Graph) -> DataFrame:
    """(rel, before, after, delta)"""
    both = old.edges.select("rel", F.lit(1).alias("before"), F.lit(0).alias("after")).unionByName(new.edges.select("rel", F.lit(0).alias("before"), F.lit(1).alias("after")))
    return both.groupBy("rel").agg(F.sum("before").alias("before"), F.sum("after").alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def coverage(files: DataFrame) -> DataFrame:
    """(path, size, error_nodes, error_bytes, ratio) of damaged files, the worst first."""
    ratio = F.when(F.col("size") > 0, F.col("error_bytes") / F.col("size")).otherwise(0.0)
    return files.where("error_nodes > 0 or error_bytes > 0").select("path", "size", "error_nodes", "error_bytes", ratio.alias("ratio")).orderBy(F.desc("ratio"), "path")


def health(files: DataFrame, policy: str = "warn", max_error_ratio: float = 0.10) -> DataFrame:
    """(files, damaged, error_bytes, over, verdict) under a policy of warn, exclude or fail."""
    over = F.count(F.when(F.col("error_bytes") > max_error_ratio * F.col("size"), 1))
    said = {"warn": "warned", "exclude": "excluded", "fail": "failed"}[policy]
    row = files.agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("error_bytes") > 0, 1)).alias("damaged"), F.coalesce(F.sum("error_bytes"), F.lit(0)).alias("error_bytes"), over.alias("over"))
    return row.withColumn("verdict", F.when(F.col("over") > 0, said).otherwise("ok"))


def flows(graph: Graph, targets: DataFrame) -> DataFrame:
    """Rows of data flow that leave the targets (id), with the names of both ends."""
    names = graph.nodes.select("id", "name")
    rows = graph.side("dataflow").join(targets.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return rows.join(names.select(F.col("id").alias("src"), F.col("name").alias("from_name")), "src", "left").join(names.select(F.col("id").alias("dst"), F.col("name").alias("to_name")), "dst", "left")


def why(graph: Graph, from_id: int, to_id: int | None = None, name: str | None = None) -> DataFrame:
    """Evidence of the edge between two nodes; or, for a name, what was not resolved and the edges that lead to nodes so called."""
    rows = graph.side("evidence").where(F.col("src") == from_id)
    if to_id is not None:
        return rows.where(F.col("dst") == to_id)
    called = graph.nodes.where(F.col("name") == name).select(F.col("id").alias("dst"))
    return rows.where((F.col("name") == name) & F.col("dst").isNull()).unionByName(rows.join(called, "dst", "left_semi").select(*rows.columns))


def snippets(graph: Graph, targets: DataFrame, context: int = 0, max_bytes: int = 64 * 1024) -> DataFrame:
    """(id, first_line, last_line, code, state): the source of a span, widened to whole lines and ``context`` more on each side.

    state is verified if the file's digest is that of its text, stale if not, unverified without one.
    """
    spans = targets.select("id").distinct().join(graph.nodes.select("id", "path", "span_start", "span_end"), "id").join(graph.side("files").select("path", "text", "digest"), "path")
    upto = lambda at: F.length(F.substr("text", F.lit(1), at)) - F.length(F.replace(F.substr("text", F.lit(1), at), F.lit("\n"), F.lit("")))
    first = F.greatest(F.lit(1), upto(F.col("span_start")) + 1 - context)
    last = F.least(F.size(F.split("text", "\n")), upto(F.greatest(F.col("span_start"), F.col("span_end") - 1)) + 1 + context)
    rows = spans.withColumn("first_line", first).withColumn("last_line", last)
    code = F.array_join(F.slice(F.split("text", "\n"), F.col("first_line").cast("int"), (F.col("last_line") - F.col("first_line") + 1).cast("int")), "\n")
    state = F.when(F.col("digest").isNull(), "unverified").when(F.col("digest") == F.sha2("text", 256), "verified").otherwise("stale")
    return rows.select("id", "first_line", "last_line", F.left(code, F.lit(max_bytes)).alias("code"), state.alias("state"))


def top_partners(pairs: DataFrame, score: str, most: int = 8) -> DataFrame:
    """Pairs (a, b, score) that are among the best of either end, ties by the other end."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), score, "a", "b").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), score, "a", "b"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc(score), "y"))
    return ends.withColumn("r", rank).where(F.col("r") <= most).select("a", "b", score).distinct()
