"""Quality classification by hierarchical empirical Bayes.

A logistic classifier over a document's measures gives its evidence; the site that it comes from gives a prior. Site posteriors are beta-binomial: a host's rate of good
documents is shrunk towards the global one and a path's towards its host's, with strengths estimated from how much the rates
of sites differ beyond chance, so a sparse site keeps close to its parent. The posterior odds of a document
are its classifier odds, freed of the training prior, times the prior odds of its path, from which the document's own part is taken out.

The classifier learns from at most about LABELLED labelled rows, drawn by a hash of the id; everything else is grouped sums over
all documents, combined before each shuffle, and a prior of a row a path.

Defined cases: null or empty texts have no evidence, a quality of 0 and aren't kept; null hosts and paths are sites of their own;
null labels teach nothing; a repeated label counts once, by majority, and a repeated id teaches with one row; without labels of both classes the evidence is 0; texts are read whole; repeated rows are separate documents;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut
from .quality import measures

#: Labelled rows learned from, in expectation; least and greatest weight of a parent's rate, in documents; least and greatest log odds.
LABELLED, LEAST, MOST, CLIP = 20_000, 2.0, 10_000.0, 12.0
FEATURES = {
    "symbols": "least(2, n_symbols / n_words)",
    "some_symbols": "cast(10 * n_symbols > n_words as double)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "exclaims": "least(2, n_exclaims / n_words)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / n_words",
    "many_repeats": "cast(100 * n_repeat_words > 15 * n_words as double)",
    "length": "ln(1 + n_words) / 10",
    "word_length": "least(2, word_chars / n_words / 10)",
}


def features(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(id, host, path, n_words, FEATURES) of every row."""
    from pyspark.sql.functions import col

    held = docs.select(F.struct(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).alias("row"), F.col(text_col).alias("text"))
    seen = measures(held, "row", "text")
    return seen.select("row.*", "n_words", *[F.when(col("n_words") > 0, F.expr(f"cast({x} as double)")).otherwise(0.0).alias(f"f_{k}") for k, x in FEATURES.items()])


def learn(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float, float]:
    """Weights and intercept of a logistic regression by Newton's method, and the share of good rows."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return np.zeros(x.shape[1]), 0.0, 0.5
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1]), share


def strength(sites: DataFrame, rate: str) -> float:
    """The weight of a parent's rate by the method of moments, from sites (n, good) and their parents' rate.

    With s the variance of site rates beyond that of chance, a beta prior has the weight rate * (1 - rate) / s - 1.
    """
    r = sites.where("n >= 2").agg(F.sum(F.expr(f"n * pow(good / n - {rate}, 2)")).alias("between"), F.sum(F.expr(f"{rate} * (1 - {rate})")).alias("chance"), F.sum(F.expr(f"n * {rate} * (1 - {rate})")).alias("unit"), F.sum("n").alias("n")).first()
    if not r["n"]:
        return MOST
    beyond = (r["between"] - r["chance"]) / r["n"]
    return float(min(MOST, max(LEAST, r["unit"] / r["n"] / beyond - 1))) if beyond > 0 else MOST


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """(id, host, path, evidence, host_rate, path_rate, quality, kept) for every row.

    host and path default to ``source`` and, below it, ``lang``.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    # equality of keys, nulls among them, is that of these strings
    seen = cut(features(docs, id_col, text_col, F.coalesce(F.concat(F.lit("="), host), F.lit("")), F.coalesce(F.concat(F.lit("="), path), F.lit(""))))
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    given = given.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    total = given.count()
    drawn = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1.0, LABELLED / max(1, total)) * (1 << 20))
    names = [f"f_{k}" for k in FEATURES]
    taught = seen.where("n_words > 0").join(drawn, "id").groupBy("id").agg(F.min(F.struct(*names, "y")).alias("x"))  # a row an id, however often it is repeated
    rows = np.array([tuple(r) for r in taught.select("x.*").collect()], float).reshape(-1, len(names) + 1)
    w, b, share = learn(rows[:, :-1], rows[:, -1])
    logit = " + ".join([f"({float(b)!r}D)", f"({float(-np.log(share / (1 - share)))!r}D)", *[f"({float(x)!r}D) * {n}" for x, n in zip(w, names, strict=True)]])
    scored = seen.withColumn("evidence", F.when(F.col("n_words") > 0, F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.expr(logit)))).otherwise(-CLIP)).drop(*names)
    scored = scored.withColumn("p", F.expr(f"1 / (1 + exp(-(evidence + {float(np.log(share / (1 - share)))!r}D)))"))
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    world = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(1 - 1e-4, max(1e-4, (world["good"] + 1) / (world["n"] + 2))) if world["n"] else 0.5
    by_host = strength(hosts.withColumn("top", F.lit(rate)), "top")
    hosts = hosts.withColumn("host_rate", (F.col("good") + by_host * rate) / (F.col("n") + by_host)).drop("n", "good")
    paths = cut(paths.join(hosts, "host"))
    by_path = strength(paths, "host_rate")
    # few keys hold very many rows: broadcast the sites if they are counted and few; else skewed partitions of the join are split
    out = scored.join(F.broadcast(paths) if paths.count() <= common.BROADCAST else paths, ["host", "path"])
    own = F.expr(f"(good - p + {by_path!r}D * host_rate) / (n - 1 + {by_path!r}D)")
    out = out.withColumn("path_rate", F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), own)))
    out = out.withColumn("quality", F.when(F.col("n_words") > 0, F.expr("1 / (1 + exp(-(evidence + ln(path_rate / (1 - path_rate)))))")).otherwise(0.0))
    strip = lambda c: F.when(F.col(c) != "", F.substring(c, 2, 1 << 30)).alias(c)
    return out.select(F.col("id").alias(id_col), strip("host"), strip("path"), *[F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "path_rate", "quality")], (F.col("quality") >= least).alias("kept"))
