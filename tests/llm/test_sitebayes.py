import random

import numpy as np

from tessera.llm import sitebayes


def corpus(seed=0, n=600):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        host = rng.choice(["good.org", "good.org", "bad.com", None, f"rare{i}"])
        bad = rng.random() < {"good.org": 0.05, "bad.com": 0.7}.get(host, 0.2)
        words = [rng.choice("abcdefgh") * rng.randrange(2, 8) + str(rng.randrange(99)) for _ in range(rng.randrange(30, 80))]
        docs.append((i, " ".join(w.upper() + "!!" if bad and i % 2 else w + "###" if bad else w for w in words), host, rng.choice(["x", "y", None]), 0.5))
        if rng.random() < 0.5:
            labels.append((i, None if rng.random() < 0.05 else int(not bad)))
    return docs, labels, {i: "!!" not in d[1] and "###" not in d[1] for i, d in enumerate(docs)}


def test_held_out(spark):
    docs, labels, truth = corpus()
    more = [(9000, None, "good.org", "x", 0.0), (9001, "", None, None, 0.0), (None, "some words of no id at all here", "bad.com", "x", 0.0), (9002, "word " * 30000, "good.org", "x", 0.0)]
    df = spark.createDataFrame(docs + more, "doc_id long, text string, source string, lang string, quality double")
    got = {r["doc_id"]: r for r in sitebayes.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(docs) + len(more)
    out = set(truth) - {i for i, _ in labels}
    assert np.mean([got[i]["kept"] == truth[i] for i in out]) > 0.97
    assert not got[9000]["kept"] and got[9001]["quality"] == 0 and got[9001]["host"] is None
    rare = [r["host_rate"] for r in got.values() if r["host"] and r["host"].startswith("rare")]
    low, high = (next(r["host_rate"] for r in got.values() if r["host"] == h) for h in ("bad.com", "good.org"))
    assert low < min(rare) and max(rare) < high  # sparse sites stay near the global rate


def test_against_numpy(spark):
    docs, labels, _ = corpus(1, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, quality double")
    got = sitebayes.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas().set_index("doc_id")
    rows = {r["id"]: r for r in sitebayes.features(df, "doc_id", "text", sitebayes.F.col("source"), sitebayes.F.col("lang")).collect()}
    x = {i: np.array([r[f"f_{k}"] for k in sitebayes.FEATURES]) for i, r in rows.items()}
    use = [(i, y) for i, y in labels if y is not None]
    w, b, share = sitebayes.learn(np.array([x[i] for i, _ in use]), np.array([y for _, y in use], float))
    prior = np.log(share / (1 - share))
    ev = {i: float(np.clip(x[i] @ w + b - prior, -12, 12)) for i in x}
    p = {i: 1 / (1 + np.exp(-(e + prior))) for i, e in ev.items()}
    group = lambda key: {k: [i for i in x if key(i) == k] for k in {key(i) for i in x}}
    host, path = (lambda i: docs[i][2]), (lambda i: (docs[i][2], docs[i][3]))
    rate = (sum(p.values()) + 1) / (len(p) + 2)

    def weight(groups, top):
        g = [(len(v), sum(p[i] for i in v), top(k)) for k, v in groups.items() if len(v) >= 2]
        n = sum(a for a, *_ in g)
        beyond = (sum(a * (s / a - t) ** 2 for a, s, t in g) - sum(t * (1 - t) for *_, t in g)) / n
        return min(sitebayes.MOST, max(sitebayes.LEAST, sum(a * t * (1 - t) for a, _, t in g) / n / beyond - 1)) if beyond > 0 else sitebayes.MOST

    hosts, paths = group(host), group(path)
    k = weight(hosts, lambda _: rate)
    host_rate = {h: (sum(p[i] for i in v) + k * rate) / (len(v) + k) for h, v in hosts.items()}
    k = weight(paths, lambda q: host_rate[q[0]])
    for i in x:
        v = paths[path(i)]
        r = np.clip((sum(p[j] for j in v) - p[i] + k * host_rate[host(i)]) / (len(v) - 1 + k), 1e-4, 1 - 1e-4)
        q = 1 / (1 + np.exp(-(ev[i] + np.log(r / (1 - r)))))
        assert abs(q - got.loc[i, "quality"]) < 1e-4, i


def test_repeated_labels(spark, monkeypatch):
    """Labels and documents that are repeated teach once, and sites that are not broadcast give the same."""
    docs, labels, _ = corpus(3, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, quality double")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    once = {r["doc_id"]: r["evidence"] for r in sitebayes.classify(df, given).collect()}
    monkeypatch.setattr(sitebayes.common, "BROADCAST", 0)
    again = sitebayes.classify(df.union(df.where("doc_id < 9")), given.union(given).union(given)).collect()
    assert len(again) == len(docs) + 9 and all(abs(once[r["doc_id"]] - r["evidence"]) < 1e-5 for r in again)


def test_no_labels(spark):
    docs, labels, _ = corpus(2, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, quality double")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert sitebayes.classify(df, empty).where("evidence <> 0").count() == 0
    assert sitebayes.classify(df.limit(0), empty).count() == 0
