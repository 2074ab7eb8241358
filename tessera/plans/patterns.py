"""Patterns to joins: each segment is an equi-join of the rows so far with the selected edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .ir import Node, Pattern, PlanError, Rel
from .lineage import cut
from .spread import spread


def slot(var: str, prop: str = "id") -> str:
    """The column that holds a property of a bound variable."""
    return f"{var}.{prop}".replace(".", "__")


def selected(edges: DataFrame, rel: Rel) -> DataFrame:
    """Distinct steps (here, there) that a relationship allows: parallel edges are one step."""
    for t in rel.types:
        if t not in schema.RELATIONS:
            raise PlanError(f"unknown relation {t}")
    if rel.grade is not None and rel.grade not in schema.GRADES:
        raise PlanError(f"unknown grade {rel.grade}")
    if rel.types:
        edges = edges.where(F.col("rel").isin(*rel.types))
    if rel.grade:
        edges = edges.where(F.col("confidence") >= schema.GRADES[rel.grade])
    forth = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"))
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"))
    steps = {"out": forth, "in": back, "both": forth.unionByName(back)}[rel.direction]
    return spread(steps, "here", "there").distinct()


def within_hops(steps: DataFrame, seeds: DataFrame, least: int, most: int) -> DataFrame:
    """(here, there) for each seed (id) and node whose shortest distance lies between least and most; a seed never meets itself.

    Each hop is a join, a distinct and an anti-join with what was met before. From the third hop on the lineage is cut.
    """
    if most > 2:
        steps = cut(steps)
    ring = seeds.select(F.col("id").alias("here"), F.col("id").alias("there"))
    met = ring
    rings = []
    for hop in range(1, most + 1):
        ahead = ring.join(steps.select(F.col("here").alias("there"), F.col("there").alias("next")), "there").select("here", F.col("next").alias("there")).where("here <> there").distinct()
        ring = ahead.join(met, ["here", "there"], "left_anti")
        if most > 2:
            ring = cut(ring)
            if ring.isEmpty():
                break
        if hop >= least:
            rings.append(ring)
        met = met.unionByName(ring)
    out = rings[0] if rings else ring.limit(0)
    for r in rings[1:]:
        out = out.unionByName(r)
    return out


def node_filter(graph, node: Node):
    """The condition on nodes that a node pattern states, or None; and the properties it reads."""
    conditions, reads = [], set()
    for k in node.kinds:
        if k not in graph.kinds:
            raise PlanError(f"unknown kind {k}")
    if node.kinds:
        conditions.append(F.col("kind").isin(*node.kinds))
        reads.add("kind")
    for name, value in node.props:
        if name not in ("name", "path", "id", "eid", "exported"):
            raise PlanError(f"a node pattern can't have the property {name}")
        kind = {"id": int, "exported": bool}.get(name, str)
        if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
            raise PlanError(f"{name} takes a value of type {kind.__name__}")
        reads.add(name)
        if name == "path":
            conditions.append(F.col("path").endswith(value))
        elif name == "eid":
            conditions.append(F.lower("eid") == value.lower())
        else:
            conditions.append(F.col(name) == F.lit(value))
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out, reads


def bind(graph, node: Node, var: str, reads: set[str]) -> DataFrame:
    """Nodes that fit the pattern, with their id and the properties read under the variable's columns."""
    condition, more = node_filter(graph, node)
    rows = graph.properties(set(reads) | more | {"id"})
    if condition is not None:
        rows = rows.where(condition)
    return rows.select(*[F.col(p).alias(slot(var, p)) for p in ["id", *sorted(reads - {"id"})]])


def step(graph, rows: DataFrame, here: str, rel: Rel, node: Node, var: str, reads: set[str]) -> DataFrame:
    """rows with one more variable, bound to what the relationship reaches from the column here."""
    steps = selected(graph.edges, rel)
    if rel.hops:
        # a bound last node is no seed: walking starts from the rows' distinct nodes
        seeds = rows.select(F.col(here).alias("id")).distinct()
        steps = within_hops(steps, seeds, *rel.hops)
    steps = spread(steps, "here").withColumnRenamed("there", slot(var))
    out = rows.join(steps, rows[here] == F.col("here")).drop("here")
    condition, more = node_filter(graph, node)
    if condition is None and not reads - {"id"}:
        return out
    return out.join(bind(graph, node, var, reads), slot(var))


def cost(node: Node) -> int:
    """How little an end of a chain selects."""
    given = {k for k, _ in node.props}
    return 0 if given & {"id", "eid"} else 1 if "name" in given else 2 if node.kinds else 3


def flip(p: Pattern) -> Pattern:
    turned = {"out": "in", "in": "out", "both": "both"}
    return Pattern(tuple(reversed(p.nodes)), tuple(Rel(r.types, turned[r.direction], r.hops, r.grade) for r in reversed(p.rels)))


def match(graph, pattern: Pattern, reads: dict[str, set[str]]) -> DataFrame:
    """Rows of a pattern: a column for each property read of each variable; nodes without a name get hidden ones.

    The walk starts from the end that selects more.
    """
    names = [n.var or f"_{i}" for i, n in enumerate(pattern.nodes)]
    if len(set(names)) < len(names):
        raise PlanError("a variable is bound once")
    if cost(pattern.nodes[-1]) < cost(pattern.nodes[0]):
        pattern, names = flip(pattern), names[::-1]
    rows = bind(graph, pattern.nodes[0], names[0], reads.get(names[0], set()))
    for i, rel in enumerate(pattern.rels):
        rows = step(graph, rows, slot(names[i]), rel, pattern.nodes[i + 1], names[i + 1], reads.get(names[i + 1], set()))
    return rows


def matching(graph, pattern: Pattern, bound) -> tuple[str, DataFrame]:
    """The variable that an EXISTS starts from and the distinct ids (id) for which it holds."""
    first = pattern.nodes[0]
    if first.var is None or first.var not in bound or first.kinds or first.props:
        raise PlanError("EXISTS starts from a bound variable, without kinds or properties")
    if any(n.var in bound for n in pattern.nodes[1:] if n.var):
        raise PlanError("EXISTS can't bind a variable again")
    if not pattern.rels:
        raise PlanError("EXISTS takes at least one relationship")
    # walk back from the far end, so only what can match is expanded
    if len(pattern.rels) == 1 and not pattern.rels[0].hops:
        steps = selected(graph.edges, pattern.rels[0])
        condition, more = node_filter(graph, pattern.nodes[1])
        if condition is not None:
            steps = steps.join(graph.properties(more).where(condition).select(F.col("id").alias("there")), "there", "left_semi")
        return first.var, steps.select(F.col("here").alias("id")).distinct()
    rows = match(graph, Pattern((Node("start"), *[Node(None, n.kinds, n.props) for n in pattern.nodes[1:]]), pattern.rels), {})
    return first.var, rows.select(F.col(slot("start")).alias("id")).distinct()
