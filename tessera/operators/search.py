"""Hybrid ranked search: channels of ranked ids, fused by reciprocal rank."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences, tokens
from ..plans.lineage import cut, shared_dir
from ..plans.spread import spread

# Of BM25, of fusion, of the lexical embedding.
K1, B, SATURATED, RRF_K, POOL = 1.2, 0.75, 255, 60, 50
DIMENSIONS, FNV_START, FNV_PRIME, GOLDEN = 256, 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B97F4A7C15
CHANNELS = ("name", "vector", "graph", "bm25", "dense", "body")
#: Queries that are compared at once: a block of them is what a task holds beside its batch.
BLOCK = 4096
#: Pairs that a task holds at once, 16 bytes each and twice as much again while they are added up.
KEPT_PAIRS = 4_000_000


def query_tokens(query: str) -> list[str]:
    """The tokens of a query, by the rule of functions.text.tokens()."""
    humps = re.sub(r"(?<=[^\W_A-Z])(?=[A-Z])", " ", query)
    return [t.lower() for t in re.findall(r"[^\W_]+", humps)]


@dataclass(frozen=True)
class Filter:
    """What may be found; it holds before ranking, while document frequencies stay those of the collection."""

    prefix: str | None = None
    suffix: str | None = None
    kinds: tuple = ()
    exported_only: bool = False
    exclude_tests: bool = False

    def admits(self) -> Column:
        from .reach import path_class

        out = F.lit(True)
        if self.prefix:
            out = out & ((F.col("path") == self.prefix) | F.col("path").startswith(self.prefix.rstrip("/") + "/"))
        if self.suffix:
            out = out & F.col("path").endswith(self.suffix)
        if self.kinds:
            out = out & F.col("kind").isin(*self.kinds)
        if self.exported_only:
            out = out & F.col("exported")
        return out & (path_class(F.col("path")) != "test") if self.exclude_tests else out


def ranked(rows: DataFrame, order: list, pool: int) -> DataFrame:
    """(id, rank) of the first ``pool`` rows, from 0: a top-k of every task, then of all."""
    return rows.orderBy(*order).limit(pool).select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


# -- channels ------------------------------------------------------------------------------------------------------
def name_tiers(nodes: DataFrame, query: str) -> DataFrame:
    """(id, tier, size): 0 the exact name, 1 the same tokens, 2 all tokens of the query among the name's; size in bytes."""
    want = F.array(*map(F.lit, query_tokens(query))).cast("array<string>")
    own = tokens(F.col("name"))
    tier = F.when(F.col("name") == query, 0).when(own == want, 1).when((F.size(want) > 0) & (F.size(F.array_except(want, own)) == 0), 2)
    return nodes.select("id", tier.alias("tier"), F.octet_length("name").alias("size")).where("tier is not null")


def postings(docs: DataFrame) -> DataFrame:
    """(id, token, tf, dl) from (id, text): counts and lengths saturate."""
    own = docs.select("id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    each = own.select("id", F.least(F.size("t"), F.lit(SATURATED)).alias("dl"), F.explode("t").alias("token"))
    return each.groupBy("id", "token", "dl").agg(F.least(F.count(F.lit(1)), F.lit(SATURATED)).alias("tf"))


def bm25(docs: DataFrame, query: str, admitted: DataFrame | None = None) -> DataFrame:
    """(id, score): with two or more distinct query tokens, a document must hold two of them.

    One pass reads the texts and keeps of each its length and the query's tokens in it; all else counts on what is kept.
    """
    want = sorted(set(query_tokens(query)))
    own = docs.select("id", tokens(F.col("text")).alias("t"))
    # a filter on what tokens() gives would be pushed below it and have every text cut twice
    sized = cut(own.select("id", F.least(F.size("t"), F.lit(SATURATED)).alias("dl"), F.filter("t", lambda x: x.isin(*want)).alias("hit") if want else F.array().cast("array<string>").alias("hit"))).where("dl > 0")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    tf = sized.where(F.size("hit") > 0).select("id", "dl", F.explode("hit").alias("token")).groupBy("id", "dl", "token").agg(F.least(F.count(F.lit(1)), F.lit(SATURATED)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # a row a query token
    s = tf.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if admitted is not None:
        s = s.join(admitted.select("id"), "id", "left_semi")
    return s.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= min(2, len(want))).select("id", "score")


def lexical_vectors(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, vec) from (id, tokens): signed feature hashing of the tokens, of length 1."""

    def run(batches):
        known: dict[str, tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            h = FNV_START
            for byte in token.encode():
                h = (h ^ byte) * FNV_PRIME & (1 << 64) - 1
            h2 = h * GOLDEN & (1 << 64) - 1
            h2 = (h2 << 31 | h2 >> 33) & (1 << 64) - 1
            return h2 % dimensions, 1.0 if h2 >> 32 & 1 else -1.0

        for b in batches:
            out = np.zeros((b.num_rows, dimensions), np.float32)
            for i, ts in enumerate(b.column(1).to_pylist()):
                for t in ts or ():
                    if t not in known:
                        if len(known) > 500_000:
                            known.clear()
                        known[t] = place(t)
                    at, sign = known[t]
                    out[i, at] += sign
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norm, out=out, where=norm > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float32()))], names=["id", "vec"])

    return texts.select("id", "tokens").mapInArrow(run, "id long, vec array<float>")


def node_tokens(nodes: DataFrame) -> DataFrame:
    """(id, tokens) of what stands for a node: its name twice, its signature and the last part of its path; imports are left out."""
    base = F.regexp_extract("path", "([^/]*)$", 1)
    whole = F.concat_ws(" ", "name", "name", "signature", base)
    return nodes.where("kind <> 'import'").select("id", tokens(whole).alias("tokens"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """(query, id, dist, rank): the k nearest vectors (id, vec) of every query (query, vec) by squared distance to nine places, ties by id.

    All are compared with all, block by block: a block of about BLOCK queries is sent to the tasks, each streams its vectors past it and keeps k a
    query, and the best of all tasks are written to the shared folder before the next block is sent. So no more than one block is held anywhere,
    and neither plan nor workers grow with the queries; the work is queries times vectors.
    """
    spark = vectors.sparkSession
    asked = cut(queries.select("query", "vec").where("vec is not null"))
    blocks = max(1, -(-asked.count() // BLOCK))
    placed = cut(asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))))
    own = cut(vectors.select("id", "vec").where("vec is not null")) if blocks > 1 else vectors.select("id", "vec").where("vec is not null")
    # each task gives k rows a query: few tasks, however many files there are
    own = own.coalesce(2 * spark.sparkContext.defaultParallelism)
    folder = f"{shared_dir(spark).rstrip('/')}/nearest-{uuid.uuid4().hex}"
    for block in range(blocks):
        held = placed.where(F.col("block") == block).select("query", "vec").toArrow()  # about BLOCK rows
        sent = spark.sparkContext.broadcast((held.column("query").to_numpy(), matrix(held.column("vec").combine_chunks())))
        best = own.mapInArrow(lambda batches, sent=sent: nearest_of(batches, *sent.value, k, exclude_self), "query bigint, id bigint, dist double")
        order = Window.partitionBy("query").orderBy("dist", "id")
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).write.mode("append").parquet(folder)
        sent.destroy()
    return spark.read.schema("query bigint, id bigint, dist double, rank int").parquet(folder)


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), len(flat) // max(len(lists), 1))


def nearest_of(batches, ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool):
    """(query, id, dist) of the k nearest of the batches (id, vec), for queries ids with vectors q.

    Distances by products of matrices only sort out what is farther than the k-th so far; those that may count are computed from differences.
    """
    norms = (q * q).sum(1)[:, None]
    worst = np.full(len(q), np.inf)
    at, found, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            c = whole.slice(start, 1024)
            own, x = c.column(0).to_numpy(), matrix(c.column(1))
            if not len(own) or not len(q):
                continue
            square = (x * x).sum(1)[None, :]
            d = square - 2 * (q @ x.T)
            d += norms
            # what rounding may hide: of the products, and of the ninth place
            slack = 1e-12 * (norms + square.max()) + 2e-9
            if exclude_self:
                d[ids[:, None] == own[None, :]] = np.inf
            if len(own) > k:
                limit = np.minimum(worst, np.partition(d, k - 1, axis=1)[:, k - 1])[:, None] + slack
            else:
                limit = worst[:, None] + slack
            r, i = np.nonzero((d <= limit) & np.isfinite(d))
            exact = np.concatenate([np.zeros(0), *[np.round(((q[r[j : j + 65536]] - x[i[j : j + 65536]]) ** 2).sum(1), 9) for j in range(0, len(r), 65536)]])
            at, found, dist = np.concatenate([at, r]), np.concatenate([found, own[i]]), np.concatenate([dist, exact])
            order = np.lexsort((found, dist, at))
            at, found, dist = at[order], found[order], dist[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            stay = place < k
            last = place == k - 1
            worst[at[last]] = dist[last]
            at, found, dist = at[stay], found[stay], dist[stay]
    yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(found, pa.int64()), pa.array(dist, pa.float64())], names=["query", "id", "dist"])


def sign_bits(vectors: DataFrame) -> DataFrame:
    """(id, bits): the signs of a vector's components as 64-bit words."""
    word = lambda v, w: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(v, F.lit(64 * w) + i) > 0, F.expr("1L")).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))
    return vectors.select("id", F.array(*[word(F.col("vec"), w) for w in range(4)]).alias("bits"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def body_words(files: DataFrame, words: list[str]) -> DataFrame:
    """(id, n) of texts (id, text) that hold every token of three bytes or more, by how often."""
    words = [w for w in words if len(w.encode()) >= 3]
    if not words:
        return files.select("id", F.lit(0).cast("bigint").alias("n")).limit(0)
    low = files.select("id", F.lower("text").alias("text"))
    for w in words:
        low = low.where(F.col("text").contains(w))
    return low.select("id", sum((occurrences(F.col("text"), F.lit(w)) for w in words[1:]), occurrences(F.col("text"), F.lit(words[0]))).alias("n"))


# -- fusion --------------------------------------------------------------------------------------------------------
def rrf(lists: dict[str, DataFrame], k: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score, ranks map) of ranked lists (id, rank from 0): the sum of weight / (60 + rank), ties by id."""
    out = None
    for channel, rows in lists.items():
        part = rows.select("id", F.lit(channel).alias("channel"), "rank", F.lit(float((weights or {}).get(channel, 1.0))).alias("w"))
        out = part if out is None else out.unionByName(part)
    fused = out.groupBy("id").agg(F.sum(F.col("w") / (RRF_K + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks"))
    return fused.orderBy(F.desc("score"), "id").limit(k) if k else fused


def mass(law: str, rank: Column, similarity: Column | None = None, degree: Column | None = None, pool: int = POOL) -> Column:
    """Variants of what a dense rank is worth: flat; less by quantile; none beyond a cut-off, below a similarity, or without edges; more for hubs."""
    base = 1.0 / (RRF_K + rank)
    if law == "flat":
        return base
    if law == "quantile":
        return base * (1 - rank / pool)
    if law == "cutoff":
        return F.when(rank < pool / 4, base).otherwise(0.0)
    if law == "gap":
        return F.when(similarity >= 0.5, base).otherwise(0.0)
    if law in ("degree", "hub"):
        return base * (F.log(1 + degree) if law == "hub" else F.when(degree > 0, 1.0).otherwise(0.0))
    raise ValueError(f"unknown law {law}")


@dataclass(frozen=True)
class Searcher:
    """Search over nodes with what the channels need: referential degrees (id, in_degree), texts (id, text) of bodies, dense vectors (id, vec)."""

    nodes: DataFrame
    degrees: DataFrame
    bodies: DataFrame | None = None
    vectors: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def documents(self) -> DataFrame:
        return self.nodes.select("id", F.concat_ws(" ", "name", "signature").alias("text"))

    def lists(self, query: str, pool: int, only: Filter | None = None, dense: list[float] | None = None) -> dict[str, DataFrame]:
        """The ranked list of each channel, of at most ``pool`` ids."""
        nodes = self.nodes.where((only or Filter()).admits())
        tiers = name_tiers(nodes, query).orderBy("tier", "size", "id").limit(pool)
        out = {"name": ranked(tiers, [F.asc("tier"), F.asc("size"), F.asc("id")], pool)}
        lex = self.extra.get("lexical")
        if lex is not None:
            want = query_tokens(query)
            q = lexical_vectors(self.nodes.sparkSession.createDataFrame([(0, want)], "id long, tokens array<string>")).select(F.col("id").alias("query"), "vec")
            near = nearest(lex.join(nodes.select("id"), "id", "left_semi"), q, pool, exclude_self=False)
            out["vector"] = near.select("id", (F.col("rank") - 1).alias("rank"))
        hubs = tiers.join(self.degrees.select("id", "in_degree"), "id", "left").fillna(0, ["in_degree"])
        out["graph"] = ranked(hubs, [F.desc("in_degree"), F.asc("id")], pool)
        scored = bm25(self.documents(), query, nodes).withColumn("score", F.round("score", 9))
        out["bm25"] = ranked(scored, [F.desc("score"), F.asc("id")], pool)
        if dense is not None and self.vectors is not None:
            q = self.nodes.sparkSession.createDataFrame([(0, [float(x) for x in dense])], "query long, vec array<double>")
            reached = self.vectors.join(self.degrees.where("in_degree >= 1"), "id", "left_semi").join(nodes.select("id"), "id", "left_semi")
            out["dense"] = nearest(reached, q, pool, exclude_self=False).select("id", (F.col("rank") - 1).alias("rank"))
        if self.bodies is not None and out["name"].isEmpty() and out["bm25"].isEmpty():
            found = body_words(self.bodies.join(nodes.select("id"), "id", "left_semi"), query_tokens(query))
            out["body"] = ranked(found, [F.desc("n"), F.asc("id")], pool)
        return out

    def search(self, query: str, k: int = 10, only: Filter | None = None) -> DataFrame:
        """(id, score, ranks): hits of a query, or of a conjunction of quoted phrases."""
        phrases = conjunction(query)
        if phrases:
            return self.search_all(phrases, k, only)
        return rrf(self.lists(query, max(4 * k, POOL), only), k)

    def search_all(self, phrases: list[str], k: int = 10, only: Filter | None = None) -> DataFrame:
        """(id, score, total): nodes that every phrase finds and whose name, signature or file shares a token with it; by the least score, then their sum."""
        pool, out = self.nodes.count(), None
        whole = self.nodes.select("id", tokens(F.concat_ws(" ", "name", "signature", F.regexp_extract("path", "([^/]*)$", 1))).alias("t"))
        for n, phrase in enumerate(phrases):
            want = query_tokens(phrase)
            support = whole.where(F.arrays_overlap("t", F.array(*map(F.lit, want)).cast("array<string>"))).select("id") if want else whole.limit(0).select("id")
            part = rrf(self.lists(phrase, pool, only)).join(support, "id", "left_semi").select("id", F.col("score").alias(f"s{n}"))
            out = part if out is None else out.join(part, "id")
        scores = [F.col(f"s{n}") for n in range(len(phrases))]
        total = sum(scores[1:], scores[0])
        return out.select("id", F.least(*scores).alias("score"), total.alias("total")).orderBy(F.desc("score"), F.desc("total"), "id").limit(k)


def conjunction(query: str) -> list[str]:
    """The phrases of ``"a" AND "b"``; none if the query isn't of exactly this form."""
    if not re.fullmatch(r'\s*"[^"]+"(\s+AND\s+"[^"]+")+\s*', query):
        return []
    found = re.findall(r'"([^"]+)"', query)
    if len(found) > 64:
        raise ValueError("at most 64 phrases")
    return found


def rerank(hits: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """Hits (id, rank from 0) in the order of their cosine to the query; the first keeps its place, hits without a vector stay behind."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.try_divide(dot(F.col("vec"), q), F.sqrt(dot(F.col("vec"), F.col("vec"))) * F.sqrt(dot(q, q)))
    near = hits.join(vectors.select("id", "vec"), "id", "left").withColumn("cosine", cosine).withColumn("pinned", F.col("rank") == 0)
    order = Window.orderBy(F.desc("pinned"), F.desc_nulls_last("cosine"), "rank")
    return near.select("id", "rank", "cosine", (F.row_number().over(order) - 1).alias("new_rank"))


# -- quality -------------------------------------------------------------------------------------------------------
def metrics(results: DataFrame, grades: DataFrame) -> DataFrame:
    """(query, ndcg, rr, recall) of results (query, id, rank from 0) under grades (query, id, grade): NDCG@10, first of grade 2 or more, recall@5."""
    met = results.where("rank < 10").join(grades, ["query", "id"])
    gain = (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 2)
    got = met.groupBy("query").agg(F.sum(gain).alias("dcg"), F.count(F.when((F.col("rank") < 5) & (F.col("grade") >= 2), 1)).alias("top"))
    first = results.join(grades.where("grade >= 2"), ["query", "id"]).groupBy("query").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("query").orderBy(F.desc("grade"), "id")
    ideal = grades.withColumn("r", F.row_number().over(order) - 1).groupBy("query").agg(F.sum(F.when(F.col("r") < 10, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 2))).alias("best"), F.count(F.when(F.col("grade") >= 2, 1)).alias("good"))
    out = ideal.join(got, "query", "left").join(first, "query", "left")
    return out.select("query", F.round(F.coalesce(F.try_divide("dcg", "best"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.try_divide("top", "good"), F.lit(0.0)), 6).alias("recall"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(wins, losses, ties, gain, verdict) of per-query scores (query, rr): b is better if wins exceed losses by 1.96 standard deviations of a fair coin."""
    both = a.select("query", F.col("rr").alias("x")).join(b.select("query", F.col("rr").alias("y")), "query")
    row = both.agg(F.count(F.when(F.expr("y > x"), 1)).alias("wins"), F.count(F.when(F.expr("y < x"), 1)).alias("losses"), F.count(F.when(F.expr("y = x"), 1)).alias("ties"), F.round(F.avg(F.expr("y - x")), 9).alias("gain"))
    return row.withColumn("verdict", F.expr("case when wins - losses > 1.96 * sqrt(wins + losses) then 'better' when losses - wins > 1.96 * sqrt(wins + losses) then 'worse' else 'same' end"))


def self_probes(nodes: DataFrame, n: int = 512, seed: int = 17) -> DataFrame:
    """(query, id, grade): a seeded choice of nodes, each to be found by its own name."""
    named = nodes.where(F.size(tokens(F.col("name"))) >= 2)
    return named.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select(F.col("name").alias("query"), "id", F.lit(3).alias("grade"))


# -- learned vectors -----------------------------------------------------------------------------------------------
def known_words(docs: DataFrame, least: int) -> list[str]:
    """The tokens of (tokens) that are seen ``least`` times or more, in order. The driver holds them, and each task that numbers tokens."""

    def run(batches):
        seen: Counter = Counter()
        for whole in batches:
            for c in whole.column(0).flatten().value_counts():
                seen[c["values"].as_py()] += c["counts"].as_py()
            if len(seen) > KEPT_PAIRS // 8:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["w", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["w", "n"])

    counts = docs.select("tokens").mapInArrow(run, "w string, n bigint").where("w is not null").groupBy("w").agg(F.sum("n").alias("n"))
    return sorted(counts.where(F.col("n") >= least).select("w").toArrow().column(0).to_pylist())


def coded_pairs(docs: DataFrame, words, window: int) -> DataFrame:
    """(key, n) of unordered pairs of known words at most ``window`` apart: the smaller number in the key's upper 32 bits. words: broadcast list.

    A task adds up its pairs, KEPT_PAIRS of them at once, and what the tasks found is added up after that.
    """

    def run(batches):
        number = {w: i for i, w in enumerate(words.value)}
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def merged():
            k, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]))
            return k[first], np.add.reduceat(n, first) if len(first) else n

        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                lists = whole.column(0).slice(start, 1024)
                flat = lists.flatten().dictionary_encode()
                own = np.array([number.get(w, -1) for w in flat.dictionary.to_pylist()] + [-1], np.int64)
                code = own[flat.indices.fill_null(-1).to_numpy(zero_copy_only=False)]  # the last is that of nulls
                text = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                made = []
                for d in range(1, window + 1):
                    a, b = code[:-d], code[d:]
                    stay = (text[:-d] == text[d:]) & (a >= 0) & (b >= 0)
                    a, b = a[stay], b[stay]
                    made.append(np.minimum(a, b) << 32 | np.maximum(a, b))
                k, n = np.unique(np.concatenate(made), return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > KEPT_PAIRS:
                    k, n = merged()
                    keys[:], counts[:], held = [k], [n], len(k)
                    if held > KEPT_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])
                        keys[:], counts[:], held = [k[:0]], [n[:0]], 0
        k, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])

    return cut(spread(docs.select("tokens").mapInArrow(run, "key bigint, n bigint"), "key").groupBy("key").agg(F.sum("n").alias("n")))


def both_ways(coded: DataFrame, words, value, name: str) -> DataFrame:
    """(a, b, name) of coded pairs in both orders; value(a, b, n) gives the columns of numbers, NaN for rows that are left out."""

    def run(batches):
        known = pa.array(words.value, pa.string())
        for whole in batches:
            key, n = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            x, y, turned = key >> 32, key & 0xFFFFFFFF, key >> 32 != key & 0xFFFFFFFF
            n = np.where(turned, n, 2 * n)  # a word beside itself stands in both orders
            a, b = np.concatenate([x, y[turned]]), np.concatenate([y, x[turned]])
            v = value(a, b, np.concatenate([n, n[turned]]))
            stay = np.flatnonzero(~np.isnan(v))
            yield pa.RecordBatch.from_arrays([known.take(pa.array(a[stay])), known.take(pa.array(b[stay])), pa.array(v[stay])], names=["a", "b", name])

    kind = "double" if name == "ppmi" else "bigint"
    return coded.mapInArrow(run, f"a string, b string, {name} {kind}")


def cooccurrences(docs: DataFrame, window: int = 2, least: int = 5) -> DataFrame:
    """(a, b, n): ordered pairs of tokens at most ``window`` apart in (id, tokens), of tokens seen ``least`` times or more."""
    words = docs.sparkSession.sparkContext.broadcast(known_words(docs, least))
    return both_ways(coded_pairs(docs, words, window), words, lambda a, b, n: n, "n")


def word_ppmi(docs: DataFrame, window: int = 2, least: int = 5, alpha: float = 0.75) -> DataFrame:
    """ppmi() of cooccurrences(): pairs stay numbers until they are written. The driver and each task hold the words and their counts."""
    words = docs.sparkSession.sparkContext.broadcast(known_words(docs, least))
    coded = coded_pairs(docs, words, window)
    ends = coded.select("n", F.explode(F.array(F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND(0xFFFFFFFF))).alias("i")).groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    na = np.zeros(len(words.value), np.float64)
    na[ends.column("i").to_numpy()] = ends.column("n").to_numpy()
    share, context = na / max(na.sum(), 1), na**alpha / max((na[na > 0] ** alpha).sum(), 1)
    sent = docs.sparkSession.sparkContext.broadcast((share, context, na.sum()))

    def value(a, b, n):
        share, context, all_ = sent.value
        v = np.log((n / all_) / (share[a] * context[b]))
        return np.where(v > 0, v, np.nan)

    return both_ways(coded, words, value, "ppmi").select("a", "b", F.round("ppmi", 6).alias("ppmi")).where("ppmi > 0")


def ppmi(pairs: DataFrame, alpha: float = 0.75) -> DataFrame:
    """(a, b, ppmi): positive pointwise mutual information, with context counts raised to alpha."""
    pairs = cut(pairs)  # four sums are taken of it
    rows = pairs.groupBy("a").agg(F.sum("n").alias("na"))
    cols = pairs.groupBy("b").agg(F.pow(F.sum("n").cast("double"), F.lit(alpha)).alias("nb"))
    total = pairs.agg(F.sum("n").alias("n_all"))
    context = cols.agg(F.sum("nb").alias("nb_all"))
    all_ = pairs.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(context))  # one row each
    value = F.log((F.col("n") / F.col("n_all")) / ((F.col("na") / F.col("n_all")) * (F.col("nb") / F.col("nb_all"))))
    return all_.select("a", "b", F.round(value, 6).alias("ppmi")).where("ppmi > 0")


def word_vectors(weights: DataFrame, dimensions: int = 64) -> DataFrame:
    """(token, vec) by a truncated SVD of the PPMI matrix, whose rows are distributed."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    names = weights.select("a").distinct().orderBy("a").withColumn("i", F.row_number().over(Window.orderBy("a")) - 1)
    names = cut(names)
    size = names.count()
    placed = weights.join(names, "a").join(names.select(F.col("a").alias("b"), F.col("i").alias("j")), "b").groupBy("i").agg(F.collect_list(F.struct("j", "ppmi")).alias("row"))
    rows = placed.rdd.map(lambda r: IndexedRow(r["i"], Vectors.sparse(size, sorted((x["j"], x["ppmi"]) for x in r["row"]))))
    svd = IndexedRowMatrix(rows, size, size).computeSVD(min(dimensions, size - 1), computeU=True)
    scale = np.sqrt(np.array(svd.s.toArray()))
    out = svd.U.rows.map(lambda r: (int(r.index), [float(x) for x in r.vector.toArray() * scale])).toDF("i long, vec array<double>")
    return out.join(names, "i").select(F.col("a").alias("token"), "vec")


def retrofit(vectors: DataFrame, edges: DataFrame, sweeps: int = 10) -> DataFrame:
    """(id, vec): vectors pulled towards their neighbours' (edges a, b): each is the mean of its own and of theirs' mean, swept until the objective stops falling."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    start = cut(vectors.select("id", F.transform("vec", lambda x: x.cast("double")).alias("q")))
    now, last = start.withColumn("x", F.col("q")), None
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    for _ in range(sweeps):
        sums = both.join(now.select(F.col("id").alias("b"), F.posexplode("x").alias("k", "v")), "b").groupBy("a", "k").agg(F.avg("v").alias("m"))
        mean = sums.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("ms")).select(F.col("a").alias("id"), F.transform("ms", lambda p: p["m"]).alias("m"))
        new = cut(now.join(mean, "id", "left").select("id", "q", F.when(F.col("m").isNull(), F.col("q")).otherwise(F.zip_with("q", "m", lambda x, y: (x + y) / 2)).alias("x")))
        far = new.agg(F.sum(square(F.col("x"), F.col("q")))).first()[0] or 0.0
        deg = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
        ends = both.join(deg, "a").join(new.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(new.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
        cost = far + (ends.agg(F.sum(square(F.col("xa"), F.col("xb")) / F.col("d"))).first()[0] or 0.0)
        if last is not None and cost >= last:
            break
        now, last = new, cost
    return now.select("id", F.col("x").alias("vec"))
