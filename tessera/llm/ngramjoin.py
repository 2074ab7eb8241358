"""Exact Jaccard self-join of documents' word n-grams, with token-combination prefixes.

A document's set holds the hashes (56 bits) of its distinct runs of ``size`` words; similarity is that of these sets. All sets share one
order: tokens of a frequent class last, then by how rare their words are, then by hash. With d = n - ceil(t * n), two sets of Jaccard
similarity t or more share a token among their first d + 1, and b + 1 tokens among their first d + b + 1. If the first shared token is rare,
single keys of the rare tokens among the first d + 1 meet. Otherwise no rare token is shared, so b + 1 frequent ones are; dealt
into b buckets by their hash, two of them fall into one. So frequent tokens are indexed by pairs that lie in one bucket, about
four times b of them, with b near d: the number of keys grows as the set. A frequent token alone brings nothing.

Each set also carries a parity bitmap: its bits differ from another's in at most as many places as the sets do, so a pair of bitmaps that differ in
more places than similar sets can is no candidate. The tokens of a prefix that no other prefix holds bound the partner's size.

Steps, none of which holds a group in one task's memory or returns all pairs of a group of copies: equal sets are grouped by
a digest and one row goes on for each; of keys that the same documents hold one goes on; each key's documents are verified against the key's least changed document, and linked ones united; then
pairs of a key that lie in different components and pass bitmap and size bounds are candidates, and verified. Pairs inside a component need no
test, so the components are exact.

Which tokens are frequent affects the work alone, never the result: the words and tokens taken for frequent are the most frequent
WORDS and LISTED, counted over all documents; any others stand in the rare class.

Defined cases: a null text or one without words has an empty set and links with nothing; a text of fewer words than ``size`` is one
token; rows with a null id have their set counted, link with nothing and have a null component; rows that repeat an id are one node, whose
links are those of all its texts; texts are read whole; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, components, cut, kept, release, semi, unused

#: A token in the first tokens of more than so many sets is of the frequent class; words and tokens listed at most.
FREQUENT, WORDS, LISTED = 50, 1 << 16, 1 << 20
#: Bits of a token's hash, below six of its rank by rarity; the bit above marks the frequent class.
BITS, LATE = 56, 1 << 62
#: Entries of a lookup cache, bits of a parity bitmap, and a node's smallest keys that are looked at to make a pair once.
CACHE, PARITY, LOWS = 200_000, 512, 64
MAPS = [f"m{k}" for k in range(PARITY // 64)]
M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


def split(text: str | None) -> list[bytes]:
    """Words, with A-Z in lower case: bytes' lower() and split() know ASCII letters and white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Shingler:
    """Sorted token sets; the six upper bits of a token hold the rarity of its words, rare first."""

    def __init__(self, size: int, levels: dict[int, int]):
        self.size, self.levels = size, levels
        self.known = Recent(self.word, CACHE)

    def word(self, w: bytes) -> bytes:
        h = xxhash.xxh64_intdigest(w)
        return (self.levels.get(h, 0) << 58 | h >> 6).to_bytes(8, "little")

    def tokens(self, text: str | None) -> np.ndarray:
        found = split(text)
        h = np.frombuffer(b"".join(map(self.known.__getitem__, found)), "<u8")
        if not len(h):
            return np.zeros(0, np.int64)
        k = min(self.size, len(h))
        n = len(h) - k + 1
        level, mixed = np.zeros(n, np.uint64), np.full(n, k, np.uint64)
        for i in range(k):
            part = h[i : i + n]
            level += part >> np.uint64(58)
            mixed = (mixed ^ part) * M[0]
            mixed ^= mixed >> np.uint64(32)
            mixed *= M[1]
            mixed ^= mixed >> np.uint64(29)
        mixed *= M[2]
        rank = np.minimum(level * np.uint64(3) // np.uint64(self.size), np.uint64(63))
        return np.unique(rank << np.uint64(BITS) | mixed >> np.uint64(64 - BITS)).view(np.int64)


def shingler(size: int, levels: tuple) -> Shingler:
    """Held by a Python worker from task to task."""
    return kept(made, size, levels)


def made(size: int, levels: tuple) -> Shingler:
    return Shingler(size, dict(levels))


def least(n: int, num: int, den: int) -> int:
    """The overlap that a set of n needs with any partner."""
    return -(-num * n // den)


def buckets(n: int, num: int, den: int) -> int:
    """Buckets of frequent tokens for pairs whose larger set has n tokens: a power of two, near the tokens in which n may differ."""
    return 1 << max(0, (n - least(n, num, den)).bit_length() - 1)


def word_levels(docs: DataFrame, text_col: str) -> tuple:
    """(word's hash, level) of the most frequent words; the level grows with the logarithm of the count, from 1 to 20."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(split(t))
                if len(seen) > 2 * CACHE:  # only the most frequent are asked for; what is left out here just counts as rarer
                    seen = Counter(dict(seen.most_common(CACHE)))
        top = seen.most_common(WORDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh64_intdigest(w) for w, _ in top], np.uint64).view(np.int64)), pa.array([n for _, n in top], pa.int64())], names=["w", "n"])

    counted = docs.select(text_col).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "w").limit(WORDS).toArrow()
    if not top.num_rows:
        return ()
    words, counts = top.column("w").to_numpy().view(np.uint64).tolist(), top.column("n").to_pylist()
    most = counts[0].bit_length()
    return tuple((w, max(1, 20 - 20 * (most - n.bit_length()) // max(20, most))) for w, n in zip(words, counts, strict=True))


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of PARITY hash values whether an odd number of tokens has it, as 64-bit integers."""
    return np.packbits((np.bincount(tokens & (PARITY - 1), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def sets(docs: DataFrame, id_col: str, text_col: str, size: int, held) -> DataFrame:
    """(digest, tokens binary)"""

    def run(batches):
        own = shingler(size, held.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                t = [own.tokens(x) for x in b.slice(at, 256).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(x) for x in t], pa.binary()), pa.array([x.tobytes() for x in t], pa.binary())], names=["digest", "tokens"])

    return docs.select(text_col).mapInArrow(run, "digest binary, tokens binary")


def digests(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int, held) -> DataFrame:
    """(id, n, digest, first, MAPS): the set's size, digest and bitmap, and half as many tokens again as its prefix without a frequent class holds."""

    def run(batches):
        own = shingler(size, held.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                t = [own.tokens(x) for x in c.column(1).to_pylist()]
                first = [x[: 3 * (len(x) - least(len(x), num, den) + 2) // 2] for x in t]
                maps = np.stack([parity(x) for x in t])
                yield pa.RecordBatch.from_arrays([c.column(0).cast(pa.int64()), pa.array([len(x) for x in t], pa.int64()), pa.array([digest_of(x) for x in t], pa.binary()), pa.array(first, pa.list_(pa.int64())), *map(pa.array, np.ascontiguousarray(maps.T))], names=["id", "n", "digest", "first", *MAPS])

    return docs.select(id_col, text_col).mapInArrow(run, "id long, n long, digest binary, first array<long>, " + ", ".join(f"{m} long" for m in MAPS))


ENTRIES = "node long, rare long, last long, keys array<long>"


def entry(n: int, start: np.ndarray, late: np.ndarray, num: int, den: int) -> tuple | None:
    """(rare tokens of the prefix, last token of the prefix, keys) from the first tokens of a set of n; None if that takes more of them.

    A pair of frequent tokens has a negative key.
    """
    d = n - least(n, num, den)
    at = np.searchsorted(late, start)
    is_late = late[np.minimum(at, len(late) - 1)] == start if len(late) else np.zeros(len(start), bool)
    rare = start[~is_late][: d + 1]
    if len(rare) > d:
        return len(rare), int(rare[-1]), rare
    if len(start) < n:
        return None
    often, keys = start[is_late], [rare]
    for b in {buckets(n, num, den), buckets(n * den // num, num, den)}:  # that of the larger set counts: this one's or a partner's
        part = often[: d + b + 1 - len(rare)]
        h = part.view(np.uint64) * M[1]
        where = ((h ^ (h >> np.uint64(31))) & np.uint64(b - 1)).astype(np.int64)
        for place in np.flatnonzero(np.bincount(where, minlength=b) > 1):
            own = part[where == place].view(np.uint64)
            one, two = np.triu_indices(len(own), 1)
            pairs = ((own[one] * M[0] ^ own[two]) * M[1] + np.uint64(b)) * M[2]
            keys.append((pairs >> np.uint64(1) | np.uint64(1 << 63)).view(np.int64))
    return len(rare), int(often[d - len(rare)]) | LATE, np.concatenate(keys)


def entry_batch(nodes: list[int], found: list[tuple | None]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *[pa.array([f and f[k] for f in found], kind) if k < 2 else pa.array([None if f is None else f[k] for f in found], kind) for k, kind in enumerate(kinds)]], names=["node", "rare", "last", "keys"])


def index_of_first(firsts: DataFrame, num: int, den: int, late) -> DataFrame:
    """Index entries from (node, n, first); a node whose first tokens don't suffice comes back without keys."""

    def run(batches):
        listed = late.value
        for b in batches:
            nodes, sizes, first = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            flat, ends = first.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(first.value_lengths().to_numpy(zero_copy_only=False))])
            yield entry_batch(nodes, [entry(n, flat[i:j], listed, num, den) for n, i, j in zip(sizes, ends[:-1], ends[1:], strict=True)])

    return firsts.select("node", "n", "first").mapInArrow(run, ENTRIES)


def index_of_sets(whole: DataFrame, num: int, den: int, late) -> DataFrame:
    """Index entries from (node, tokens)."""

    def run(batches):
        listed = late.value
        for b in batches:
            t = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(1)]
            yield entry_batch(b.column(0).to_pylist(), [entry(len(x), x, listed, num, den) for x in t])

    return whole.select("node", "tokens").mapInArrow(run, ENTRIES)


def whole_sets(docs: DataFrame, nodes: DataFrame, heads: DataFrame, id_col: str, text_col: str, size: int, held) -> DataFrame:
    """(node, tokens) of the nodes (node), from the texts of the rows that have their ids."""
    wanted = cut(heads.join(nodes, "node", "left_semi"))
    own = sets(semi(docs, wanted.select(F.col("id").alias(id_col)).distinct(), id_col), id_col, text_col, size, held)
    return cut(own.join(wanted.select("digest", "node"), "digest").groupBy("node").agg(F.first("tokens").alias("tokens")))


def verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int, held) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets are similar, as pairs of ids."""
    pairs = cut(pairs)
    own = whole_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), heads, id_col, text_col, size, held)
    release(docs.sparkSession)
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):  # views of the batch: no pair's sets are copied
                x, y = np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<i8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    for side in "ab":
        found = found.join(heads.select(F.col("node").alias(side), F.col("id").alias(f"{side}_id")), side)
    return cut(found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def one_key(posted: DataFrame) -> DataFrame:
    """(key, lead, rares) from (key, node, rare): of the keys that the same two or more nodes hold the smallest one, their least changed node, and how many of them are rare tokens.

    Near copies share many keys, and each of these would make the same pairs again. Sets of nodes are compared by count, lead and two hashes.
    """
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in range(2)]
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rare", "node")).alias("lead"), *marks).where("c > 1")
    return shared.groupBy("c", F.col("lead.node").alias("lead"), "h0", "h1").agg(F.min("key").alias("key"), F.count_if(F.col("key") >= 0).alias("rares")).select("key", "lead", "rares")


def side(name: str, of: DataFrame) -> DataFrame:
    return of.select(*[F.col(c).alias(name if c == "node" else c if c == "key" else f"{name}_{c}") for c in of.columns])


def crossing(held: DataFrame, about: DataFrame, may) -> DataFrame:
    """Pairs (a, b) of nodes of other homes that share a key of held (key, node, home) and pass ``may`` over the columns of about.

    A pair that shares many keys is made at the smallest one alone, if that is among the first LOWS of both: any smaller one would be, too. Else it is made at each.
    """
    lows = held.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LOWS).alias("lows"))
    open_ = cut(held.join(about, "node").join(lows, "node"))
    once = F.expr("key = coalesce(array_min(array_intersect(a_lows, b_lows)), key)")
    return side("a", open_).join(side("b", open_), "key").where("a < b and a_home <> b_home").where(may).where(once).select("a", "b")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row: sets of num / den similarity or more link; more than a half."""
    if not den < 2 * num <= 2 * den:
        raise ValueError("the similarity must be above 0.5 and at most 1")
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    known = docs.where(F.col(id_col).isNotNull())
    held = broadcast(word_levels(docs, text_col))  # WORDS at most
    base = cut(digests(docs, id_col, text_col, size, num, den, held).withColumn("row", F.monotonically_increasing_id()))
    # equal sets: one row, the node, stands for all
    heads = base.where("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("row", "id")).alias("x"))
    heads = cut(heads.select("digest", F.col("x.row").alias("node"), F.col("x.id").alias("id")))
    # a set that may not differ at all is linked by its digest already
    differ = f"{den} * n - {num} * n >= {den} or (n * {den}) div {num} > n"
    firsts = cut(base.withColumnRenamed("row", "node").join(heads.select("node"), "node", "left_semi").where(differ).select("node", "n", "first"))
    base = cut(base.drop("first"))  # here and below a copy without the arrays takes the place of the one with them, which goes at the next release
    release(spark)
    counts = firsts.select(F.explode("first").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > FREQUENT)
    late = broadcast(np.sort(counts.orderBy(F.desc("c"), "token").limit(LISTED).toArrow().column("token").to_numpy()))
    release(spark)
    entries = cut(index_of_first(firsts, num, den, late))
    del firsts, counts
    if not (long := cut(entries.where("keys is null").select("node"))).isEmpty():
        # where frequent tokens fill the beginning, the whole text is read again
        again = index_of_sets(whole_sets(known, long, heads, id_col, text_col, size, held), num, den, late)
        release(spark)
        entries = cut(entries.where("keys is not null").unionByName(again))
        del again
    release(spark)
    posted = entries.select("node", "rare", F.explode("keys").alias("key"))
    shared = cut(posted.join(posted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "key"))  # most keys stand alone and go by few bytes
    entries = cut(entries.drop("keys"))
    del posted
    release(spark)
    live = cut(shared.join(one_key(shared), "key").select("key", "node", "lead", "rares"))
    del shared
    # of a pair, the set whose prefix ends first holds none of its own rare tokens in common with the other: that bounds the other's size
    met = live.groupBy("node").agg(F.sum("rares").alias("met"))
    about = base.withColumnRenamed("row", "node").select("node", "n", *MAPS).join(entries.select("node", "rare", "last"), "node").join(met, "node", "left")
    about = cut(about.withColumn("most", F.expr(f"((n - rare + coalesce(met, 0)) * {num + den}) div {num} - n")).select("node", "n", "last", "most", *MAPS))
    near = " + ".join(f"bit_count(a_{m} ^ b_{m})" for m in MAPS)
    may = F.expr(f"""{den} * least(a_n, b_n) >= {num} * greatest(a_n, b_n) and if(a_last <= b_last, b_n <= a_most, true) and if(b_last <= a_last, a_n <= b_most, true)
        and ({near}) * {num + den} <= (a_n + b_n) * {den - num}""")

    release(spark)
    how = (heads, id_col, text_col, size, num, den, held)
    stars = live.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    hopeful = stars.join(side("a", about), "a").join(side("b", about), "b").where(may).select("a", "b")
    links = verified(hopeful, known, *how)
    release(spark)
    united = components(links)
    release(spark)
    homes = heads.select("node", "id").join(united.withColumnRenamed("node", "id"), "id", "left").select("node", F.coalesce("component", "id").alias("home"))
    homed = live.drop("lead", "rares").join(homes, "node")
    mixed = homed.groupBy("key").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo < hi").select("key")
    crossed = crossing(cut(homed.join(mixed, "key", "left_semi")), about, may).distinct()
    del homed, mixed, stars, hopeful
    more = verified(crossed, known, *how)
    release(spark)
    members = base.where("n > 0 and id is not null").join(heads.select("digest", F.col("id").alias("head")), "digest").select(F.col("id").alias("a"), F.col("head").alias("b"))
    found = components(links.unionByName(more).unionByName(members))
    return base.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of docs for each component: of the smallest id, and of that id's rows the one with the smallest text.

    Rows with a null id count as rows of an id made of their text's hash, behind all other ids.
    """
    made = unused(docs)
    marked = docs.withColumn(made, F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)))
    gone = join(marked.select(F.col(made), F.col(text_col).alias(made + "t")), made, made + "t", **how).where(F.col("component_id") < F.col(made)).select(made).distinct()
    left = semi(marked, cut(gone), made, "left_anti")
    repeated = cut(marked.groupBy(made).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(made))
    once = semi(left, repeated, made, "left_anti").select(*docs.columns)
    first = semi(left, repeated, made).groupBy(made).agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col), F.lit(""))).alias("x"))
    return once.unionByName(first.select("x.*"))


def sql(source: str = "documents", size: int = 3, num: int = 90, den: int = 100) -> str:
    """DuckDB SQL of join() for small tables; rows that repeat an id are linked."""
    return f"""with recursive d as (select *, row_number() over () as rid from (select doc_id, text from {source})),
w as (select rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as l from d),
s as (select distinct rid, unnest(case when len(l) = 0 then [] when len(l) < {size} then [l] else list_transform(range(1, len(l) - {size} + 2), lambda i: list_slice(l, i, i + {size} - 1)) end) as g from w),
z as (select rid, count(*) as n from s group by rid),
o as (select a.rid as a, b.rid as b, count(*) as c from s a join s b on a.g = b.g and a.rid < b.rid group by all),
e as (select distinct p.doc_id as a, q.doc_id as b from o join z x on x.rid = a join z y on y.rid = b join d p on p.rid = a join d q on q.rid = b
  where {den} * c >= {num} * (x.n + y.n - c) and p.doc_id <> q.doc_id),
sides as (select a, b from e union select b, a from e),
r as (select distinct doc_id as node, doc_id as seen from d where doc_id is not null union select r.node, sides.b from r join sides on sides.a = r.seen),
c as (select node, min(seen) as component_id from r group by node)
select doc_id, coalesce(n, 0) as n_shingles, component_id from d left join z using (rid) left join c on node = doc_id"""
