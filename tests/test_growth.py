"""Work and memory grow as the input where a key, a text or a set of queries is large, and results stay those of a plain version."""

import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tessera.catalog import Graph, degrees
from tessera.operators import communities, derive, neighbors, search, textsearch, verbs
from tessera.plans import spread


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def most_rows(spark, make):
    """The result's rows, and the most rows that an operator of its plan made."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = make()
        got = rows(df)
        most, left = 0, [df._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            found = node.metrics().get("numOutputRows")
            most = max(most, found.get().value() if found.isDefined() else 0)
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
        return got, most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


REFS = "ref_id bigint, from_id bigint, from_path string, name string, form string, qualifier string, receiver_type string, receiver_origin string"
SYMBOLS = "id bigint, name string, path string, owner string, exported boolean"


def plain_resolve(refs, symbols, private):
    """(ref_id, tier, n, least) of the first tier with a candidate, every reference met with every symbol."""
    folder = lambda p: p[: p.rfind("/") + 1]
    tiers = {}
    for ref_id, _, from_path, name, form, qualifier, receiver, _ in refs:
        for cand, own, path, owner, exported in symbols:
            if name is None or own != name:
                continue
            same = path is not None and path == from_path
            seen = bool(exported)
            if private and path is not None and from_path is not None:
                seen = seen or (from_path.startswith(folder(path)) if private == "subtree" else folder(path) == folder(from_path))
            if form == "static" and qualifier is not None:
                tier = 2 if owner == qualifier and (same or seen) else None
            elif form == "method" and receiver is not None:
                tier = 3 if owner == receiver and (same or seen) else None
            else:
                tier = 4 if same else 5 if seen else None
            if tier:
                tiers.setdefault(ref_id, {}).setdefault(tier, set()).add(cand)
    return {r: (len(t[min(t)]), min(t[min(t)])) for r, t in tiers.items()}


@pytest.mark.parametrize("private", [None, "directory", "subtree"])
@pytest.mark.parametrize("again", [False, True])
def test_resolve_is_the_plain_ladder(spark, private, again):
    """Ids that repeat, nulls everywhere, and references that share an id."""
    rng = random.Random(f"{private}{again}")
    paths, some = ["a/x", "a/y", "a/b/x", "a/b/c/z", "x", "d/x", None], lambda *xs: rng.choice(xs)
    symbols = [(rng.randrange(12), some("f", "g", None), rng.choice(paths), some("A", "B", None), some(True, False, False, None)) for _ in range(40)]
    refs = [(k // 3 if again else k, k, rng.choice(paths), some("f", "g", "h", None), some("bare", "static", "method", None), some("A", "B", None), some("A", "B", None), some("declared", None)) for k in range(150)]
    got = derive.resolve(spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, SYMBOLS), private=private)
    want = plain_resolve(refs, symbols, private)
    found = got.collect()
    assert len(found) == len(refs)
    for r in found:
        n, least = want.get(r["ref_id"], (0, None))
        form = {x[1]: x[4] for x in refs}[r["src"]]
        assert r["candidates"] == n and r["dst"] == (least if n == 1 or (n > 1 and form == "bare") else None)


def test_resolve_makes_no_pairs(spark):
    """3,000 references to a name that 3,000 symbols have."""
    refs = spark.range(3000).selectExpr("id as ref_id", "id as from_id", "'p/x' as from_path", "'f' as name", "'bare' as form", "cast(null as string) as qualifier", "cast(null as string) as receiver_type", "cast(null as string) as receiver_origin")
    symbols = spark.range(3000).selectExpr("id", "'f' as name", "'m/x' as path", "'A' as owner", "true as exported")
    got, most = most_rows(spark, lambda: derive.resolve(refs, symbols).select("dst", "candidates").distinct())
    assert got == [(0, 3000)] and most <= 12_000


def test_bind_imports_makes_no_pairs(spark):
    """1,000 imports of a name that 1,000 symbols of a file have, and of one that has one."""
    files = spark.createDataFrame([("m/1.py",)], "path string")
    symbols = spark.range(1000).selectExpr("id", "case when id < 999 then 'f' else 'g' end as name", "'m/1.py' as path")
    imports = spark.range(1000).selectExpr("id as ref_id", "concat('m/x', id) as from_path", "'1' as name", "case when id < 998 then 'f' else 'g' end as symbol", "cast(null as string) as alias")
    got, most = most_rows(spark, lambda: derive.bind_imports(imports, symbols, files))
    assert got == [("m/x998", "g", 999), ("m/x999", "g", 999)] and most <= 15_000


def timed(make):
    """The rows of make() and the seconds of its second run."""
    make().collect()
    began = time.time()
    return make().collect(), time.time() - began


def test_sketches_are_linear_in_a_text(spark):
    """A text of 60,000 tokens: its shingles are cut once, not from a copy of all tokens each. An id that two rows share has its shingles once."""
    long = spark.sql("select 1L as id, transform(sequence(1, 60000), i -> concat('w', i)) as tokens")
    got, seconds = timed(lambda: derive.sketches(long))
    assert [(r["id"], r["shingles"], len(r["sketch"])) for r in got] == [(1, 59998, 64)] and seconds < 10
    two = spark.sql("select id % 2 as id, transform(sequence(1, 40 + 10 * (cast(id as int) div 2)), i -> concat('w', i)) as tokens from range(4)")
    assert sorted((r["id"], r["shingles"]) for r in derive.sketches(two).collect()) == [(0, 48), (1, 48)]


def test_trigrams_of_few(spark):
    """An index of some trigrams is that part of the whole index, rows of one id together."""
    texts = ["the right of", "rigrigh", "éà right", "ri", "", None, "ght" * 50]
    files = spark.createDataFrame([(k % 6, t) for k, t in enumerate(texts)], "file_id bigint, text string")
    few = textsearch.asked("right|the")
    assert few == {int.from_bytes(x, "big") for x in (b"rig", b"igh", b"ght", b"the")} and textsearch.asked("r.") is None
    want = {}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        for i in range(len(raw) - 2):
            key = k % 6, int.from_bytes(raw[i : i + 3], "big")
            want[key] = want.get(key, 0) | (1 << raw[i + 3] % 8 if i + 3 < len(raw) else 0)
    assert rows(textsearch.trigrams(files)) == sorted(((*k, m) for k, m in want.items()), key=repr)
    assert rows(textsearch.trigrams(files, few)) == sorted(((*k, m) for k, m in want.items() if k[1] in few), key=repr)


def test_bm25_reads_a_text_once(spark):
    """What is planned after the texts were cut into tokens holds no regular expression."""
    docs = spark.createDataFrame([(k, "the and " * (k % 5) + f"w{k}") for k in range(50)], "id bigint, text string")
    df = search.bm25(docs, "the and")
    assert not re.search("regexp_replace", df._jdf.queryExecution().toString()) and df.count() == 40


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    """Groupings of edges have partitions by the bytes that are read, however few the session has, and the same rows."""
    edges = spark.range(20_000).selectExpr("id % 3000 as src", "id % 1100 as dst", "case when id % 2 = 0 then 'calls' else 'imports' end as rel", "90 as confidence")
    edges.repartition(2).write.parquet(f"{tmp_path}/e")
    nodes = spark.range(3000).selectExpr("id", "'function' as kind", "concat('f', id) as name", "'p' as path", "cast(null as string) as signature", "true as exported")
    g = Graph(nodes, spark.read.parquet(f"{tmp_path}/e"))
    asked = {
        "degrees": lambda: degrees(g.edges),
        "importers": lambda: neighbors.related(g, "importers", g.nodes),
        "steps": lambda: g.query("MATCH (x)-[:calls|imports]->(p) RETURN p.id AS p, count(*) AS n"),
        "hubs": lambda: verbs.hubs(g, 25),
    }
    before = {k: rows(f()) for k, f in asked.items()}
    size = spread.stored_bytes(g.edges)
    assert spread.stored_bytes(nodes) == 0 or spread.spread(nodes, "id").rdd.getNumPartitions() <= 4
    monkeypatch.setattr(spread, "PART", -(-size // 23))
    for k, f in asked.items():
        df = f()
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString() and rows(df) == before[k], k
    assert spread.spread(g.edges, "src").rdd.getNumPartitions() == 23
    assert sum(r[1] for r in before["degrees"]) == 20_000 and before["hubs"][0][2] >= 18


def test_nearest_holds_one_block(spark, monkeypatch):
    """Several blocks give what one gives and what all pairs give, with far more ties than k; the plan doesn't grow with the blocks."""
    rng = random.Random(3)
    some = [[float(rng.randrange(3)) for _ in range(4)] for _ in range(30)]
    vecs = {k: some[k % 30] if k % 4 else [1.0, 1.0, 1.0, 1.0] for k in range(300)}
    v = spark.createDataFrame(list(vecs.items()), "id bigint, vec array<float>")
    queries = v.where("id % 3 = 0").selectExpr("id as query", "vec")
    want = []
    for a in range(0, 300, 3):
        near = sorted((sum((x - y) ** 2 for x, y in zip(vecs[a], vecs[b], strict=True)), b) for b in vecs if b != a)[:5]
        want += [(a, b, d, r + 1) for r, (d, b) in enumerate(near)]
    one = search.nearest(v, queries, 5)
    monkeypatch.setattr(search, "BLOCK", 16)
    many = search.nearest(v, queries, 5)
    assert rows(one) == rows(many) == sorted(want, key=repr)
    assert many._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_louvain_holds_arrays():
    """A ring of tens and its chords: the same communities as from tuples, in under 250 bytes of an edge beside the columns."""
    k = np.arange(20_000)
    a, b = np.concatenate([k, k[:-10]]), np.concatenate([k // 10 * 10 + (k + 1) % 10, k[10:]])
    w = np.ones(len(a), np.int64)
    tracemalloc.start()
    nodes, found = communities.louvain_of(a, b, w)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 250 * len(a)
    assert communities.louvain(list(zip(a.tolist(), b.tolist(), w.tolist(), strict=True))) == dict(zip(nodes.tolist(), found.tolist(), strict=True))
    assert communities.louvain([]) == {} and communities.louvain([(7, 7, 2), (3, 9, 1)]) == {3: 3, 7: 7, 9: 3}


def test_ppmi_of_coded_pairs(spark, monkeypatch):
    """Pairs that are kept as numbers give what ppmi() gives of the pairs in words, also when a task keeps few at once; texts are not exploded."""
    rng = random.Random(5)
    texts = [(k, [rng.choice("abcdefgh") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(40))]) for k in range(60)] + [(60, None), (61, []), (62, ["a", None, "b"])]
    docs = spark.createDataFrame(texts, "id bigint, tokens array<string>")
    seen, pairs = Counter(w for _, t in texts for w in t or () if w), Counter()
    for _, t in texts:
        for i in range(len(t or ())):
            for j in (i + 1, i + 2):
                if j < len(t) and t[i] and t[j] and min(seen[t[i]], seen[t[j]]) >= 5:
                    pairs.update([(t[i], t[j]), (t[j], t[i])])
    got = search.cooccurrences(docs)
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == dict(pairs)
    want = rows(search.ppmi(got))
    monkeypatch.setattr(search, "KEPT_PAIRS", 40)
    assert rows(search.word_ppmi(docs)) == want
    assert "Generate" not in got._jdf.queryExecution().toString()
