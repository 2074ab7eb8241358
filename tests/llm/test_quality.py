import random
import re

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.llm import quality


def brute(t):
    t = t or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    seen, cover = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + k for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


TEXTS = [None, "", "   ", "one two", "a b c d e a b c d e", "a a a a a a a a", "x\n\n x\nx\nx\n x\n", "# $ %% é ñ 🙂 |", "a b c d e f a b c d e f g h a b c d e", "w " * 4000, "THIS IS LOUD!! " * 8, " ".join(f"word{i}" for i in range(5000)), "ab\x0bcd\x0cef\rgh\x1cij"]


def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, *TEXTS[4:6]])] + [(None, "null key row", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string"), rows


def test_measures(spark):
    df, rows = frame(spark)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.measures(df).collect()}
    assert got == {k: brute(t) for k, t, _ in rows}


def test_against_sql(spark):
    df, rows = frame(spark)
    own = quality.judge(df).select("doc_id", "n_words", "n_repeat_words", "base_failed", "quality", "kept").toPandas().sort_values("doc_id").reset_index(drop=True)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "x"])  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    sql = con.sql(quality.sql(keep="doc_id, n_words, n_repeat_words, base_failed, quality, kept")).df().sort_values("doc_id").reset_index(drop=True)
    for c in own.columns:
        assert ((own[c].astype(float) - sql[c].astype(float)).abs().fillna(0) < 1e-9).all(), c
    assert quality.judge(df.limit(0)).count() == 0


def planted(seed=0, n=40000):
    """Votes drawn from known shares and rates, with the class of each row."""
    rng = np.random.default_rng(seed)
    share = dict(zip(quality.CLASSES, (0.8, 0.1, 0.06, 0.04), strict=True))
    rate = {}
    for r in quality.RULES:
        for c in quality.CLASSES:
            sees = r in quality.FAULTS.get(c, ())
            bad, none = (rng.uniform(0.5, 0.75), rng.uniform(0.15, 0.2)) if sees else (rng.uniform(0.01, 0.06), rng.uniform(0.02, 0.05))
            rate[r, c] = (1 - bad - none, bad, none)
    of = rng.choice(len(share), n, p=list(share.values()))
    votes = np.array([[rng.choice(quality.VOTES, p=rate[r, quality.CLASSES[c]]) for r in quality.RULES] for c in of])
    return share, rate, of, votes


def test_rates_are_recovered(spark):
    """Estimated from votes alone; the verdict is not that all rules pass, nor that of the start."""
    share, rate, of, votes = planted()
    df = pd.DataFrame(votes, columns=[f"v_{r}" for r in quality.RULES])
    counted = df.groupby(list(df.columns)).size().reset_index(name="n")
    patterns = spark.createDataFrame(counted)
    found = quality.estimate(patterns, 30, 0.01)
    assert all(abs(found["share"][c] - x) < 0.02 for c, x in share.items())
    assert all(abs(found["rate"][r, v, "good"] - x) < 0.02 for (r, c), xs in rate.items() if c == "good" for v, x in zip(quality.VOTES, xs, strict=True))
    assert all(abs(found["rate"][r, -1, c] - xs[1]) < 0.15 for (r, c), xs in rate.items())

    def kept(params):
        log = {c: np.log(params["share"][c]) + sum(np.log(np.select([df[f"v_{r}"] == v for v in quality.VOTES], [params["rate"][r, v, c] for v in quality.VOTES])) for r in quality.RULES) for c in quality.CLASSES}
        return 1 / sum(np.exp(log[c] - log["good"]) for c in quality.CLASSES) >= 0.5

    good, strict = kept(found), (votes != -1).all(1)
    assert (good & ~strict).sum() > 1000 and (~good & strict).any() and (good != kept(quality.start())).any()
    assert (good == (of == 0)).mean() > (strict == (of == 0)).mean() + 0.05


def test_verdicts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abdefgilmnorstuv") for _ in range(rng.randrange(2, 9)))
    good = [(i, " ".join(word() for _ in range(rng.randrange(30, 90)))) for i in range(200)]
    odd = [(i, " ".join(word() if k % 4 else f"{rng.randrange(10, 999)}" for k in range(60))) for i in range(200, 206)]  # many digits, which one rule dislikes
    junk = [(i, " ".join(word() + "###" for _ in range(40))) for i in range(300, 320)]
    loud = [(i, " ".join(word().upper() + "!!" for _ in range(40))) for i in range(400, 410)]
    same = [(i, " ".join([word() + " " + word()] * 30)) for i in range(500, 510)]
    df = spark.createDataFrame([*good, *odd, *junk, *loud, *same], "doc_id long, text string")
    kept = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(r["kept"] == (i < 300) for i, r in kept.items())
    assert all(kept[i]["v_letters"] == -1 for i, _ in odd)
    clash = df.withColumns({"_row_mark": F.lit(1), "quality": F.lit("x"), "kept": F.lit(False)})
    assert sorted(map(tuple, quality.passing(clash).collect())) == sorted((i, t, 1, "x", False) for i, t in [*good, *odd])
