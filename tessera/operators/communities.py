"""Strongly connected components and communities."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Graph
from ..plans.lineage import cut

#: Edges, of those left after trimming, that one task may hold.
ONE_TASK = 2_000_000


def cycles(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest member of each node's strongly connected component: one depth-first walk with low links, without recursion."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    home: dict[int, int] = {}
    path: list[int] = []
    for root in out:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        path.append(root)
        work = [(root, iter(out[root]))]
        while work:
            n, rest = work[-1]
            for m in rest:
                if m not in order:
                    order[m] = low[m] = len(order)
                    path.append(m)
                    work.append((m, iter(out[m])))
                    break
                if m not in home:
                    low[n] = min(low[n], order[m])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[n])
                if low[n] == order[n]:
                    members = [path.pop()]
                    while members[-1] != n:
                        members.append(path.pop())
                    home |= dict.fromkeys(members, min(members))
    return home


def scc(graph: Graph, relations=("calls",), limit: int = 200, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component, scc_size) of every node; a node outside any cycle is its own component of size 1.

    What trimming leaves goes to one task if its counted edges are few enough to hold; otherwise, rounds of colouring: nodes that nothing arrives at, or that lead nowhere, are trimmed; the least label that reaches a node colours it; from the node that
    owns a colour, what can be reached backwards inside the colour is a component, which leaves. All steps are joins and grouped minima.
    """
    edges = cut(graph.edges.where(F.col("rel").isin(*relations)).select("src", "dst").where("src <> dst").distinct())
    done = []

    def trimmed(e: DataFrame) -> DataFrame:
        before = -1
        while True:
            e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            n = e.count()
            if n in (0, before):
                return e
            before = n

    for _ in range(limit):
        edges = trimmed(edges)
        left = edges.count()
        if not left:
            break
        if left <= one_task:
            walked = edges.groupBy((F.col("src") * 0).alias("all")).applyInPandas(lambda pdf: pd.DataFrame(list(cycles(list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))).items()), columns=["id", "c"]), "id long, c long")
            done.append(cut(walked))
            break
        colour = cut(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            least = edges.join(colour, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = cut(colour.join(least, "id", "left").select("id", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            colour = new.select("id", "c")
            if not moved:
                break
        inside = cut(edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("c")))
        found = ring = cut(colour.where("id = c"))
        while True:
            ring = cut(inside.join(ring.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct().join(found, "id", "left_anti"))
            if ring.isEmpty():
                break
            found = cut(found.unionByName(ring))
        done.append(found)
        gone = found.select("id")
        edges = cut(inside.select("src", "dst").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    else:
        raise RuntimeError("components did not settle")
    nodes = graph.nodes.select("id")
    if not done:
        return nodes.select("id", F.col("id").alias("component"), F.lit(1).cast("long").alias("scc_size"))
    all_ = done[0]
    for d in done[1:]:
        all_ = all_.unionByName(d)
    # a colour's owner is any member: the component goes by its smallest
    all_ = cut(all_)
    all_ = all_.join(all_.groupBy("c").agg(F.min("id").alias("m")), "c").select("id", F.col("m").alias("c"))
    sizes = all_.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(all_.join(sizes, "c"), "id", "left").select("id", F.coalesce("c", "id").alias("component"), F.coalesce("n", F.lit(1)).cast("long").alias("scc_size"))


def louvain(edges: list[tuple[int, int, int]], sweeps: int = 12, levels: int = 8, cap: int = 512) -> dict[int, int]:
    """Communities of weighted undirected edges by local moving and contraction, in integers and in ascending order of ids.

    Of the partitions that the levels give, a node takes the coarsest whose community has at most cap nodes.
    """
    a, b, w = np.array(edges, np.int64).reshape(-1, 3).T
    nodes, chosen = louvain_of(a, b, w, sweeps, levels, cap)
    return dict(zip(nodes.tolist(), chosen.tolist(), strict=True))


def added_up(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) in order, each once, with their weights added up."""
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(w, first) if len(first) else w


def louvain_of(a: np.ndarray, b: np.ndarray, w: np.ndarray, sweeps: int = 12, levels: int = 8, cap: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """louvain() of columns: nodes and their communities. Nodes are numbered by their ids' order, and all that is held of a node or a link stands in arrays."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    size = len(nodes)
    loops = np.zeros(size, np.int64)
    np.add.at(loops, a[a == b], w[a == b])
    other = a != b
    src, dst, weights = added_up(np.concatenate([a[other], b[other]]), np.concatenate([b[other], a[other]]), np.concatenate([w[other], w[other]]))
    del a, b, w, ends, other
    total = int(loops.sum()) * 2 + int(weights.sum())
    home, chosen = np.arange(size), np.arange(size)  # of each original node, the number of a node now
    first_of = np.arange(size)  # the smallest original node of a node now
    for _ in range(levels):
        n = len(first_of)
        start = array("q", np.searchsorted(src, np.arange(n + 1)).tobytes())
        degree = 2 * loops
        np.add.at(degree, src, weights)
        weight, where, mass = array("q", degree.tobytes()), array("q", np.arange(n).tobytes()), array("q", degree.tobytes())
        for _ in range(sweeps):
            moved = False
            for i in range(n):
                own, mine = where[i], weight[i]
                mass[own] -= mine
                to = {own: 0}
                x, y = start[i], start[i + 1]
                for m, v in zip(dst[x:y].tolist(), weights[x:y].tolist(), strict=True):
                    c = where[m]
                    to[c] = to.get(c, 0) + v
                # twice the gain in modularity, in integers: edges into a community against the chance of them
                best = max(sorted(to), key=lambda c: (to[c] * total - mine * mass[c], c == own))
                where[i] = best
                mass[best] += mine
                moved |= best != own
            if not moved:
                break
        joined = np.frombuffer(where, np.int64)
        if (joined == np.arange(n)).all():
            break
        # a community goes by its smallest member, and communities are numbered in that order
        _, first, same = np.unique(joined, return_index=True, return_inverse=True)
        order = np.argsort(first)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        joined = rank[same]
        first_of = first_of[first[order]]
        home = joined[home]
        small = np.bincount(home, minlength=len(first_of))[home] <= cap
        chosen[small] = first_of[home[small]]
        kept = np.zeros(len(first_of), np.int64)
        np.add.at(kept, joined, loops)
        x, y = joined[src], joined[dst]
        np.add.at(kept, x[(x == y) & (src < dst)], weights[(x == y) & (src < dst)])
        loops = kept
        src, dst, weights = added_up(x[x != y], y[x != y], weights[x != y])
    return nodes, nodes[chosen]


def undirected(graph: Graph, relations) -> DataFrame:
    """(a, b, w): parallel and opposite edges added up, without loops and without the edges of hubs.

    A hub has more neighbours than the square root of twice the edges, and more than 32; it stands alone.
    """
    pairs = graph.edges.where(F.col("rel").isin(*relations) & (F.col("src") != F.col("dst"))).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    pairs = cut(pairs)
    bound = max((2 * pairs.count()) ** 0.5, 32)
    busy = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > bound).select("id")
    return pairs.join(busy.withColumnRenamed("id", "a"), "a", "left_anti").join(busy.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "w")


def communities(graph: Graph, relations=("calls",), cap: int = 512) -> DataFrame:
    """(id, community) of every node, by deterministic Louvain.

    Moves depend on those before, so a whole graph is one task here: use it where the call graph fits one executor, and label_propagation() beyond.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, found = louvain_of(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy(), cap=cap)
        return pd.DataFrame({"id": nodes, "community": found})

    found = undirected(graph, relations).groupBy((F.col("a") * 0).alias("all")).applyInPandas(run, "id long, community long")
    return graph.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def label_propagation(graph: Graph, relations=("calls",), rounds: int = 20) -> DataFrame:
    """(id, community): every node takes the label most of its neighbours have, by weight, its own if none is better, then the least.

    Distributed: a round is a join and two grouped sums. Half of the nodes, by a hash, move in a round, so neighbours don't swap labels for ever.
    """
    pairs = undirected(graph, relations)
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    labels = cut(both.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")))
    still = 0
    for k in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id"), F.col("label").alias("to")).agg(F.sum("w").alias("v"))
        best = votes.join(labels, "id").groupBy("id", "label").agg(F.min(F.struct((-F.col("v")).alias("less"), (F.col("to") != F.col("label")).alias("other"), "to")).alias("m"))
        turn = F.pmod(F.xxhash64("id", F.lit(k // 2)), F.lit(2)) == k % 2
        moved = cut(best.select("id", F.when(turn, F.col("m.to")).otherwise(F.col("label")).alias("label"), (turn & F.col("m.other")).alias("moved")))
        labels = moved.select("id", "label")
        still = still + 1 if moved.where("moved").isEmpty() else 0
        if still == 2:
            break
    return graph.nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("community"))
