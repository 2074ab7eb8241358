import tracemalloc

import numpy as np

from tessera.llm import hnsw


def clusters(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n // 3, n):
        if rng.random() < 0.6:
            x[i] = x[rng.integers(0, i)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 0.3])
    x[n - n // 6 :] = x[0] + rng.normal(size=(n // 6, dim)) * 0.12  # one large group
    return x.astype(np.float32)


def brute(rows, least=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = sorted(ok)
    m = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    link = (m @ m.T) >= least
    np.fill_diagonal(link, False)
    comp = list(range(len(ids)))
    for s in range(len(ids)):
        if comp[s] == s:
            stack = [s]
            while stack:
                a = stack.pop()
                for b in np.flatnonzero(link[a]).tolist():
                    if comp[b] > s:
                        comp[b] = s
                        stack.append(b)
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (int(link[k].sum()), ids[comp[k]]) for k, i in enumerate(ids)}


def test_graph_recall():
    x = clusters(3000, 1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    width, recall = hnsw.search(g, np.arange(0, len(x), 20), 0.9)
    assert width and recall >= hnsw.RECALL
    q, node = g.within(x, 0.9, width)
    truth = (x @ x.T) >= 0.9
    found = np.zeros_like(truth)
    found[q, node] = True
    assert (found & truth).sum() >= 0.99 * truth.sum()


def test_audit_binds():
    """A graph without edges reaches no recall: the shard is to be searched exactly."""
    x = clusters(300, 3)
    g = hnsw.Graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    for layer in g.layers:
        layer[:] = -1
    assert hnsw.search(g, np.arange(0, 300, 5), 0.9) == (0, 1.0)
    q, node = g.exact(g.x, 0.9)
    assert len(q) == ((g.x @ g.x.T) >= 0.9 - hnsw.NEAR).sum()


def test_lengths_and_slices(spark, monkeypatch):
    """Vectors of any length link among their own, whatever the slices."""
    monkeypatch.setattr(hnsw, "PER_SLICE", 50)
    x, y = clusters(300, 5, 8), clusters(150, 6, 5)
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *y])] + [(900, [1.0] * 3), (901, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(df).collect()}
    for z, base in ((x, 0), (y, 300)):
        z = z.astype(float) / np.linalg.norm(z.astype(float), axis=1, keepdims=True)
        want = ((z @ z.T) >= 0.9).sum(1) - 1
        assert sum(got[base + i] for i in range(len(z))) >= 0.99 * want.sum() and all(got[base + i] <= n for i, n in enumerate(want))
    assert got[900] == got[901] == 1


def test_against_brute_force(spark):
    x = clusters(900, 2)
    rows = [(i * 2, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0, None] * 8), (5005, [float("inf")] * 16), (5006, [1.0] * 3), (5007, x[0].tolist()), (5008, (x[0] * 2).tolist())]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, n int")
    got = hnsw.near_duplicates(df).collect()
    want = brute(rows)
    assert len(got) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(w[0] for w in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
    assert np.mean([r["component_id"] == want[r["vec_id"]][1] for r in got]) > 0.99
    assert all(tuple(r)[1:3] == want[r["vec_id"]] for r in got if 5000 <= r["vec_id"] <= 5006)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, hnsw.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_memory_of_a_large_group(spark, monkeypatch):
    """Neither the audit nor the answers to queries hold all pairs of a group, and shards are bounded in bytes."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=64) + rng.normal(size=(12_000, 64)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x[:0])
    g.x = x.astype(np.float32)
    g.layers, g.tops = [np.full((len(x), 24), -1, np.int32)], np.zeros(len(x), int)
    ids, ones = np.arange(len(x)), np.ones(len(x), np.int64)
    tracemalloc.start()
    try:
        hnsw.search(g, np.arange(0, len(x), 12), 0.9)
        assert tracemalloc.get_traced_memory()[1] < 150e6
        tracemalloc.reset_peak()
        got = [b.to_pydict() for b in hnsw.linked(g, x, ids, ones, ids[:500], x[:500], 0.9, 0)]
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
    n = {a: n for b in got for a, c, n in zip(b["a"], b["b"], b["n"], strict=True) if c is None}
    want = (x[:500] @ x.T >= 0.9).sum(1) - 1
    assert [n.get(i, 0) for i in range(500)] == want.tolist()
    assert sum(len(b["a"]) for b in got) < 2 * 500 + len(x)  # a link a query and a tree, not all pairs
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 8 * 16 * 40)
    rows = [(i, v.tolist()) for i, v in enumerate(clusters(600, 4))]
    want = brute(rows)
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(w[0] for w in want.values()) and all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
