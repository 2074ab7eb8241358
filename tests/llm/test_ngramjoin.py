import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tessera.llm import common, ngramjoin
from tessera.llm.common import components


def brute(rows, size, num, den):
    """Rows of one id are one node; its number of shingles is here that of its last row."""
    sets, same = {}, {}
    for at, (i, t) in enumerate(rows):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        same[at] = i
        sets[at] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    top = {i: i for i in same.values()}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(same[i]), find(same[j])))
                top[b] = a
    return {i: (len(sets[at]), find(i)) for at, i in same.items()}


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + [f"r{k}" for k in range(4000)]
    text = lambda m: [rng.choice(words[:60]) if rng.random() < 0.6 else rng.choice(words) for _ in range(m)]
    passage, rows = text(40), []
    for i in range(n):
        kind = rng.random()
        if kind < 0.45 or not rows:
            w = text(rng.randrange(1, 160))
            if rng.random() < 0.5:
                w[3:3] = passage
        else:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
        t = " ".join(w)
        rows.append((i * 3 + 1, t.upper() if rng.random() < 0.1 else t))
    return rows


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("frequent", [2, 50])
def test_against_brute_force(spark, monkeypatch, size, num, frequent):
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    rows = corpus(size + frequent) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE  two"), (5005, "One three"), (5006, "é É"), (5007, "é É"), (5008, "x " * 9000), (5009, "x y " * 6000 + "z")]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, key string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(df, size=size, num=num).collect()}
    assert got == brute(rows, size, num, 100)
    kept = {r["doc_id"] for r in ngramjoin.one_of_each(df, size=size, num=num).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_pairs_of_frequent_tokens(spark):
    """More near copies than FREQUENT, whose sets hold too few rare tokens to fill a prefix."""
    often = np.arange(5, 25)
    rare, last, keys = ngramjoin.entry(21, np.append(often, 99), often, 90, 100)
    assert rare == 1 and last == ngramjoin.LATE | 6 and keys[0] == 99 and len(keys) > 1 and (keys[1:] < 0).all()
    assert ngramjoin.entry(21, np.arange(5, 10), often, 90, 100) is None
    assert ngramjoin.entry(21, np.arange(50, 60), often, 90, 100)[2].tolist() == [50, 51, 52]
    words = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([*words[: i % 60], f"c{i}", *words[i % 60 + 1 :]])) for i in range(60, 180)] + [(900, " ".join(f"q{k}" for k in range(60)))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 90, 100) and len({c for _, c in got.values()}) < 60


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (55, 100)])
def test_keys_of_similar_sets_meet(num, den):
    """Sets of frequent tokens only, as far apart as they may be, share a key; the number of keys grows as the set."""
    rng = np.random.default_rng(num)
    for n in [*range(2, 40), 150, 700]:
        for m in {n, n * den // num, (n + n * den // num) // 2}:
            late = np.sort(rng.choice(1 << 40, 2 * (n + m), replace=False))
            need = -(-num * (n + m) // (num + den))
            if need > n or (n == m == need):
                continue
            both, rest = np.split(rng.permutation(late), [need])
            x, y = np.sort(np.append(both, rest[: n - need])), np.sort(np.append(both, rest[n - need : n - need + m - need]))
            a, b = ngramjoin.entry(n, x, late, num, den)[2], ngramjoin.entry(m, y, late, num, den)[2]
            assert np.isin(a, b).any(), (n, m)
    late = np.sort(rng.choice(1 << 40, 40000, replace=False))
    assert len(ngramjoin.entry(20000, late[:20000], late, num, den)[2]) < 4 * 20000


def test_parity_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(1, 300))) for _ in range(2))
        differ = np.unpackbits((ngramjoin.parity(x) ^ ngramjoin.parity(y)).view(np.uint8)).sum()
        assert differ <= len(np.setxor1d(x, y))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngramjoin.join(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 0, None)], key=str)
    assert ngramjoin.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 400_000])
def test_repeated_ids(spark, monkeypatch, broadcast):
    """Each text of an id links; the SQL says the same; one row of each group stays."""
    monkeypatch.setattr(common, "BROADCAST", broadcast)
    monkeypatch.setattr(ngramjoin, "FREQUENT", 2)
    words = [f"w{k}" for k in range(100)]
    one, two = " ".join(words), " ".join(reversed(words))
    rows = [(1, one), (1, two), (1, two), (2, one + " end"), (3, "start " + two), (9, two), (12, two + " z"), (20, "some other text of a few words"), (None, one), (None, "no id here at all"), (None, "no id here at all")]
    rows += [(100 + k, " ".join([*words[:k], "x", *words[k + 1 :]])) for k in range(0, 100, 3)] + [(300, "x " + one), (300, "alone in the world"), (301, "alone in the world")]
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, extra string")
    got = sorted(map(tuple, ngramjoin.join(df).collect()), key=str)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert got == sorted(con.sql(ngramjoin.sql()).fetchall(), key=str)
    want = brute([r for r in rows if r[0] is not None], 3, 90, 100)
    assert {i: c for i, _, c in got if i is not None} == {i: c for i, (_, c) in want.items()} and want[3][1] == want[12][1] == want[301][1] == 1
    kept = sorted(map(tuple, ngramjoin.one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, one, "kept"), (20, rows[7][1], "kept"), (None, "no id here at all", "kept")], key=str)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 200)] + [(None, 3)]
    top = {}

    def find(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for i in top}


def test_pairs_are_made_once(spark):
    """Keys that the same nodes hold go on as one, and a pair of many keys is one row of the join."""
    rows = [(k, node, node % 3) for k in range(-20, 30) for node in range(6)] + [(100, 1, 1), (100, 2, 2), (101, 7, 1)]
    got = {r["key"]: (r["lead"], r["rares"]) for r in ngramjoin.one_key(spark.createDataFrame(rows, "key long, node long, rare long")).collect()}
    assert got == {-20: (0, 30), 100: (1, 1)}
    # nodes 0 to 3 share 40 keys; 8 and 9 share only one that is behind the first ones of both
    n = ngramjoin.LOWS + 5
    held = [(k, node, node) for k in range(40) for node in range(4)] + [(1000 * node + k, node, node) for k in range(n) for node in (8, 9)] + [(99_999, node, node) for node in (8, 9)]
    about = spark.createDataFrame([(node, node) for node in range(10)], "node long, n long")
    made = sorted(map(tuple, ngramjoin.crossing(spark.createDataFrame(held, "key long, node long, home long"), about, F.col("a_n") < F.col("b_n")).collect()))
    assert made == [(a, b) for a in range(4) for b in range(a + 1, 4)] + [(8, 9)]


def rdd_of(df):
    """A weak reference to what the JVM holds of a cut; its files go with it."""
    return df.sparkSession.sparkContext._jvm.java.lang.ref.WeakReference(df._jdf.queryExecution().logical().rdd())


def test_release_finds_what_was_just_dropped(spark):
    df = common.cut(spark.range(100))
    ref = rdd_of(df)
    assert ref.get() is not None
    del df
    common.release(spark)
    assert ref.get() is None


def test_arrays_go_once_read(spark, monkeypatch):
    """No cut with first tokens or keys is left on disk when pairs are verified."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", 2)
    held, left, verified = [], [], ngramjoin.verified

    def cut(df):
        out = common.cut(df)
        if {"first", "keys"} & set(df.columns):
            held.append(rdd_of(out))
        return out

    def seen(*how):
        left.append(sum(r.get() is not None for r in held))
        return verified(*how)

    monkeypatch.setattr(ngramjoin, "cut", cut)
    monkeypatch.setattr(ngramjoin, "verified", seen)
    rows = corpus(4, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 90, 100) and held and left == [0, 0]
