"""Embedding near-duplicates over hierarchical navigable small-world graphs, one for each shard.

Equal vectors are grouped first. The distinct ones of each length are dealt into shards by a hash, a graph is built over each, and every vector queries every
shard's graph: greedily through the upper layers, with a beam on the lowest. A query whose whole beam is near enough may have more
partners than the beam is wide, so it is compared with all of the shard: no number of partners is a limit. In each shard a sample of queries is
audited against all of the shard's vectors, without themselves, over all partners and for each probe; while recall is short, the beam is doubled. A
shard on which no beam reaches it is compared vector by vector. Pairs are kept after their cosine is computed in double precision, and linked vectors are
united by connected components. A graph is built by one task and stored in the shared folder with its vectors; a task for each graph and slice of the
queries reads both from there, so no graph goes through a shuffle. A shard is bounded in bytes, and pairs are looked at a block at a time, so
a task's memory depends neither on the table nor on how many partners a vector has.

Cosines are those of the vectors as stored, widened to double: equal direction at another length links too. n_links counts what a vector's own
query found.

Defined cases: a vector that is null, of no length, zero, or with a null or non-finite component links with nothing and stands
alone; vectors of other lengths link among themselves only; a null id is kept with a null component and links with nothing; rows that repeat an id count as other vectors
of that id, and are one node; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, remove, scratch
from .tokenfile import filesystem, write_whole

#: Shards at least; neighbours of a node (twice as many on the lowest layer); beam while building; least beam of a query.
SHARDS, DEGREE, BUILD, BEAM = 6, 12, 48, 32
#: Audited queries of a shard, recall to reach, and how far below the least cosine a full beam still asks for the whole shard.
AUDITED, RECALL, SLACK = 256, 0.99, 0.02
#: Queries that walk a graph side by side at most, bytes of their marks of seen nodes, nodes inserted together, vectors of a shard and of a slice of queries, cosines at once.
LOCKSTEP, MARKS, BATCH, PER_SHARD, PER_SLICE, BLOCK = 2048, 32 << 20, 512, 200_000, 16_384, 1 << 20
#: Bytes of a shard's vectors in double precision.
SHARD_BYTES = 48 << 20


#: Cosines in single precision are off by less.
NEAR = 1e-4


class Graph:
    """A navigable small-world graph of unit vectors; many queries walk it in lockstep, so each step is a numpy operation."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, build: int = BUILD, seed: int = 0):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.degree = degree
        n = len(self.x)
        rng = np.random.default_rng(seed)
        tops = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(max(2, degree))).astype(int), 8) if n else np.zeros(0, int)
        if n:
            tops[0] = max(1, tops.max())  # the entry point
        self.layers = [np.full((n, degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(tops.max()) + 1 if n else 1)]
        self.tops = tops
        done = min(1, n)
        while done < n:
            some = np.arange(done, min(n, done + max(1, min(BATCH, done // 4, MARKS // n))))
            self.insert(some, build)
            done = some[-1] + 1

    def insert(self, new: np.ndarray, build: int) -> None:
        """Connect a batch of nodes to the graph of the earlier ones."""
        near = np.zeros((len(new), 1), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            inside = np.flatnonzero(self.tops[new] >= k)
            if not len(inside):
                near = self.beam(self.x[new], near[:, :1], k, 1)[0]
                continue
            near, sims = self.beam(self.x[new], near, k, build)
            # the batch's own nodes don't stand in the graph yet: its members are compared directly
            own = np.where(np.eye(len(new), dtype=bool) | (self.tops[new] < k), -np.inf, self.x[new] @ self.x[new].T)
            found, sims = np.concatenate([near, np.broadcast_to(new, own.shape)], 1), np.concatenate([sims, own], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :build]
            found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
            chosen = []
            for row in inside.tolist():
                ok = (found[row] >= 0) & (sims[row] > -np.inf)
                chosen.append((new[row], self.spread(found[row][ok], sims[row][ok], self.degree)))
                self.layers[k][new[row], : len(chosen[-1][1])] = chosen[-1][1]
            for node, picked in chosen:
                for other in picked:
                    self.link(k, other, node, self.layers[k].shape[1])

    def spread(self, candidates: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
        """Candidates, near first, each nearer to the node than to any picked before; then the nearest of the rest."""
        picked: list[int] = []
        rest: list[int] = []
        cross = self.x[candidates] @ self.x[candidates].T
        at: list[int] = []
        for i in range(len(candidates)):
            if len(picked) >= most:
                break
            if at and cross[i, at].max() > sims[i]:
                rest.append(int(candidates[i]))
            else:
                at.append(i)
                picked.append(int(candidates[i]))
        return picked + rest[: most - len(picked)]

    def link(self, k: int, node: int, other: int, width: int) -> None:
        own = self.layers[k][node]
        if (own == other).any():
            return
        free = np.flatnonzero(own < 0)
        if len(free):
            own[free[0]] = other
            return
        all_ = np.append(own, other)
        sims = self.x[all_] @ self.x[node]
        order = np.argsort(-sims, kind="stable")
        own[:] = -1
        picked = self.spread(all_[order], sims[order], width)
        own[: len(picked)] = picked

    def beam(self, q: np.ndarray, start: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of a layer for each query, near first (-1: none), and their cosines."""
        b, links = len(q), self.layers[k]
        seen = np.zeros((b, len(self.x)), bool)
        rows = np.arange(b)
        ids = np.full((b, width), -1, np.int64)
        sims = np.full((b, width), -np.inf, np.float32)
        first = start[:, : width]
        ok = first >= 0
        r, c = np.nonzero(ok)
        ids[r, c] = first[r, c]
        sims[r, c] = np.einsum("ij,ij->i", q[r], self.x[first[r, c]])
        seen[r, first[r, c]] = True
        opened = np.zeros((b, width), bool)
        active = rows
        while len(active):
            waiting = np.where(opened[active] | (ids[active] < 0), -np.inf, sims[active])
            best = waiting.argmax(1)
            alive = waiting[np.arange(len(active)), best] > -np.inf
            active, best = active[alive], best[alive]
            if not len(active):
                break
            opened[active, best] = True
            near = links[ids[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            nodes = near[r, c]
            seen[active[r], nodes] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", q[active[r]], self.x[nodes])
            all_s = np.concatenate([sims[active], s], 1)
            all_i = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
            all_o = np.concatenate([opened[active], np.zeros(near.shape, bool)], 1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            pick = np.arange(len(active))[:, None]
            sims[active], ids[active], opened[active] = all_s[pick, order], all_i[pick, order], all_o[pick, order]
        order = np.argsort(-sims, axis=1, kind="stable")
        return ids[rows[:, None], order], sims[rows[:, None], order]

    def step(self, width: int) -> int:
        """How many queries go side by side with a beam of this width."""
        n = max(1, len(self.x))
        return max(1, min(LOCKSTEP, MARKS // n, BLOCK // 4 // max(1, min(width, n))))

    def pieces(self, q: np.ndarray, least: float, width: int):
        """(queries, nodes, cosines) of cosine ``least`` or more in single precision, by query, as far as a beam of this width finds them; width 0: all.

        All of a query stands in one piece.
        """
        if not len(self.x) or not len(q):
            return
        if not width:
            yield from self.blocks(q, least)
            return
        for at in range(0, len(q), step := self.step(width)):
            own = q[at : at + step]
            near = np.zeros((len(own), 1), np.int64)
            for k in range(len(self.layers) - 1, 0, -1):
                near = self.beam(own, near[:, :1], k, 1)[0]
            ids, sims = self.beam(own, near, 0, min(width, len(self.x)))
            full = (ids[:, -1] >= 0) & (sims[:, -1] >= least - SLACK)
            r, c = np.nonzero((ids >= 0) & (sims >= least - NEAR) & ~full[:, None])
            known, first = np.unique(r * len(self.x) + ids[r, c], return_index=True)
            yield at + known // len(self.x), known % len(self.x), sims[r, c][first]
            rows = np.flatnonzero(full)
            for r, c, s in self.blocks(own[rows], least):
                yield at + rows[r], c, s

    def blocks(self, q: np.ndarray, least: float):
        """As pieces(), compared with all nodes."""
        step = max(1, BLOCK // max(1, len(self.x)))
        for at in range(0, len(q), step):
            sims = q[at : at + step] @ self.x.T
            r, c = np.nonzero(sims >= least - NEAR)
            yield r + at, c, sims[r, c]

    def within(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of cosine ``least`` or more, as far as a beam of this width and walks from what it meets find them."""
        none = np.zeros(0, np.int64)
        found = [(none, none), *[p[:2] for p in self.pieces(q, least, width)]]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def exact(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of cosine ``least`` or more, from all nodes, block by block."""
        return self.within(q, least, 0)


def search(graph: Graph, probes: np.ndarray, least: float, beam: int = BEAM, recall: float = RECALL) -> tuple[int, float]:
    """A beam's width at which the recall of the nodes ``probes`` is reached, and that recall; width 0 if none reaches it: the shard is to be searched exactly.

    Recall is the lesser of that over all pairs and the mean over probes with partners, each without the probe itself.
    """
    q = graph.x[probes]

    def marks(width: int) -> np.ndarray:
        out = np.zeros((len(probes), len(graph.x)), bool)
        for r, c, _ in graph.pieces(q, least, width):
            out[r, c] = True
        out[np.arange(len(probes)), probes] = False
        return out

    truth, width = marks(0), beam
    any_ = truth.any(1)
    if not any_.any():
        return beam, 1.0
    while True:
        both = marks(width) & truth
        reached = min(both.sum() / truth.sum(), float((both.sum(1)[any_] / truth.sum(1)[any_]).mean()))
        if reached >= recall:
            return width, reached
        width *= 2
        if width > max(beam, len(graph.x) // 8):  # comparing all is no dearer than so wide a beam
            return 0, 1.0


def forest(a: np.ndarray, b: np.ndarray, top: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """As few of the links (a, b) as leave the same nodes connected; top: gets each node's parent, a root's being itself."""
    top = {} if top is None else top

    def find(i: int) -> int:
        while (up := top.setdefault(i, i)) != i:
            top[i] = top[up]
            i = top[i]
        return i

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            top[q] = p
            out.append((x, y))
    return out


def linked(graph: Graph, full: np.ndarray, ids: np.ndarray, counts: np.ndarray, heads: np.ndarray, x: np.ndarray, least: float, width: int):
    """Batches (a, b, n) of the queries x named heads over a shard's vectors ``full`` named ids, counts of each: how many a query links (b null), and links that connect what it links.

    Cosines that single precision leaves open are computed in double. Nodes that a query has united already have one label, so a group costs a link a query.
    """
    label, low, dim = np.arange(len(ids)), x.astype(np.float32), max(1, full.shape[1])
    for q, node, sims in graph.pieces(low, least, width):
        good = (sims >= least + NEAR) & (heads[q] != ids[node])
        open_ = np.flatnonzero((sims < least + NEAR) & (heads[q] != ids[node]))
        for at in range(0, len(open_), step := max(1, BLOCK // dim)):
            some = open_[at : at + step]
            good[some] = np.einsum("ij,ij->i", x[q[some]], full[node[some]]) >= least
        q, node = q[good], node[good]
        if not len(q):
            continue
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        own, of = heads[q[starts]], label[node]
        first = np.minimum.reduceat(of, starts)
        n = np.add.reduceat(counts[node], starts)
        other = np.repeat(first, np.diff(np.append(starts, len(q))))
        apart = other != of
        pairs = np.unique(other[apart] * len(ids) + of[apart])
        tree = np.array(forest(pairs // len(ids), pairs % len(ids), top := {}), np.int64).reshape(-1, 2)
        if len(tree):
            root = np.arange(len(ids))
            for i in top:
                k = i
                while top[k] != k:
                    k = top[k]
                root[i] = k
            label = root[label]
        a, none = np.concatenate([own, own, ids[tree[:, 0]]]), pa.nulls(len(own), pa.int64())
        b = pa.concat_arrays([none, pa.array(np.concatenate([ids[first], ids[tree[:, 1]]]))])
        yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([n, np.zeros(len(a) - len(own), np.int64)]))], names=["a", "b", "n"])


def unit(column: pa.Array) -> np.ndarray:
    """Rows of an array column of doubles as unit vectors."""
    x = np.asarray(column.flatten()).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of great components would overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, shards: int = SHARDS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    key = F.when(F.col("usable"), F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))))
    marked = rows.withColumn("usable", usable).withColumn("key", key)
    good = marked.where("usable")
    distinct = cut(good.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v")))
    # shards of each length of vectors; a row a length
    first, plan = 0, []
    for r in distinct.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        parts = max(min(shards, -(-r["n"] // 32)), -(-r["n"] // max(1, min(PER_SHARD, SHARD_BYTES // (8 * r["dim"])))))
        plan.append((r["dim"], first, parts, -(-r["n"] // PER_SLICE)))
        first += parts
    if not plan:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    lengths = vectors.sparkSession.createDataFrame(plan, "dim int, first int, parts int, slices int")
    dealt = cut(distinct.withColumn("dim", F.size("v")).join(F.broadcast(lengths), "dim").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts"))).cast("int")))

    spark = vectors.sparkSession
    folder = scratch(spark, "graphs")

    def build(batches):
        ids, counts, parts, shard = [], [], [], None
        for b in batches:
            if b.num_rows:
                shard = b.column(0)[0].as_py()
                ids.append(np.array(b.column(1)))
                counts.append(np.array(b.column(2)))
                parts.append(unit(b.column(3)))
        if shard is not None:
            order = np.argsort(np.concatenate(ids), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            full, at = np.empty((len(order), parts[0].shape[1])), 0
            while parts:
                x = parts.pop(0)
                full[place[at : at + len(x)]] = x
                at += len(x)
            ids, counts = np.concatenate(ids)[order].astype("<i8"), np.concatenate(counts)[order].astype("<i8")
            graph = Graph(full)
            probes = np.unique(np.linspace(0, len(full) - 1, min(AUDITED, len(full))).astype(int))
            width, recall = search(graph, probes, least)
            write_whole(f"{folder}/{shard}.ids", [ids])
            write_whole(f"{folder}/{shard}.vectors", [full])
            write_whole(f"{folder}/{shard}.graph", [pickle.dumps((counts, graph.layers, graph.tops))])
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [len(full)], "width": [width], "recall": [recall]}, schema=pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("width", pa.int64()), ("recall", pa.float64())]))

    graphs = dealt.repartitionById(first, F.col("shard")).select("shard", "head", "n", "v").mapInArrow(build, "shard int, n long, width long, recall double")
    made = {r["shard"]: (r["n"], r["width"]) for r in graphs.collect()}  # a row a shard

    def slab(name: str, kind: str, dim: int, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi of a stored array."""
        store, at = filesystem(f"{folder}/{name}")
        with store.open_input_file(at) as f:
            f.seek(8 * dim * lo)
            return np.frombuffer(f.read(8 * dim * (hi - lo)), kind).reshape(-1, dim)

    def run(batches):
        for b in batches:
            for task in b.column(0).to_pylist():
                for dim, start, parts, slices in plan:
                    if task < parts * slices:
                        yield from one(start + task // slices, task % slices, dim, start, parts, slices)
                        break
                    task -= parts * slices

    def one(shard: int, slice_: int, dim: int, start: int, parts: int, slices: int):
        """A shard's graph asked for the slice of all queries of its length."""
        if shard not in made:
            return
        n, width = made[shard]
        ids, full = slab(f"{shard}.ids", "<i8", 1, 0, n)[:, 0], slab(f"{shard}.vectors", "<f8", dim, 0, n)
        store, at = filesystem(f"{folder}/{shard}.graph")
        with store.open_input_stream(at) as f:
            counts, layers, tops = pickle.loads(f.read())
        graph = Graph(np.zeros((0, dim)))
        graph.x, graph.layers, graph.tops = full.astype(np.float32), layers, tops
        total, before = sum(made[k][0] for k in range(start, start + parts) if k in made), 0
        lo, hi = total * slice_ // slices, total * (slice_ + 1) // slices
        for k in range(start, start + parts):
            size = made[k][0] if k in made else 0
            i, j = max(lo - before, 0), min(hi - before, size)
            if i < j:
                yield from linked(graph, full, ids, counts, slab(f"{k}.ids", "<i8", 1, i, j)[:, 0], slab(f"{k}.vectors", "<f8", dim, i, j), least, width)
            before += size

    tasks = sum(parts * slices for _, _, parts, slices in plan)
    found = cut(spark.range(0, tasks, 1, tasks).mapInArrow(run, "a long, b long, n long"))
    remove(spark, folder)
    united = components(found.where("b is not null").select("a", "b").unionByName(good.join(distinct.select("key", "head"), "key").select(F.col("id").alias("a"), F.col("head").alias("b"))))
    links = found.where("b is null").groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("more"))
    counted = distinct.join(links, "head", "left").select("key", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out = marked.select("id", F.when(F.col("usable"), F.col("key")).alias("key")).join(counted, "key", "left").join(united.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
