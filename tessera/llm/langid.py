"""Language identification with bit-sliced Bloom filters of character n-grams.

A table holds a machine word for each of SLOTS slots, with one bit for each language (a further table for every 64 languages). The words at an
n-gram's slots, ANDed, are the set of all languages whose filter contains it: one look-up answers for all languages.
Popcounts of these bits over a text's n-grams, one for each language, are corrected for the share of false positives that the
filter's fill predicts, and the language with the greatest corrected count wins (ties: by code point).

A language's filter takes the n-grams that its labelled texts show at least MIN_COUNT times and at least 1 / RATIO as often, in proportion, as
the language that shows it most. All labelled rows are counted, whole; a task merges its counts before they are shuffled, and hands them on when
it holds HELD of them. Prediction reads the text only.

Defined cases: null text, or text without a letter: ``und``, score 0; no labelled rows at all: ``und``; null labels or
ids teach nothing; texts of any length are read whole; repeated rows get the same answer; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, semi, unused

#: Slots of the filter: its size is 8 MB for every 64 languages; and counts of n-grams that a task holds before it hands them on.
SLOTS, HELD = 1 << 20, 1 << 20
SIZES, MIN_COUNT, RATIO = (3, 4), 3, 4
#: Of the usual support of its predicted language, a recognised text has so much; parts that a support is counted in.
ENOUGH, GRAIN = 0.5, 1 << 16
#: Odd constants of the n-gram hash, one for each place, and of its mixing.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
MIX = np.uint64(0xFF51AFD7ED558CCD)
GAP = max(SIZES)
#: Code points of a text that are looked at together.
CHUNK = 1 << 18


def letters() -> np.ndarray:
    """For each code point whether it is a letter; held by a Python worker from task to task."""
    return kept(letter_table)


def letter_table() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x30000)] + [False] * (0x110000 - 0x30000))


def groups(texts: list[str | None], letter: np.ndarray):
    """All texts in groups of about CHUNK code points: (owners, starts, flat, inside) of each.

    flat holds lower-cased code points, anything but letters as 0, of parts of texts, each with a gap before the text and behind it; owners
    and starts tell a part's text and place. A long text has parts that overlap, and inside tells of each place whether windows from there count.
    """
    held, size = [], 0

    def group():
        flat = np.frombuffer("".join([x for _, x in held]).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(x) for _, x in held])
        inside = np.ones(len(flat), bool)
        inside[(ends[:, None] - np.arange(1, GAP)).ravel()] = False
        return np.array([i for i, _ in held]), np.concatenate([[0], ends[:-1]]), np.where(letter[flat], flat, 0), inside

    for i, t in enumerate(texts):
        raw = "\0" * GAP + (t or "").lower() + "\0" * GAP
        for at in range(0, len(raw) - GAP + 1, CHUNK):
            held.append((i, raw[at : at + CHUNK + GAP - 1]))
            size += len(held[-1][1])
            if size >= CHUNK:
                yield group()
                held, size = [], 0
    if held:
        yield group()


def grams(flat: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of so many code points, and which of them hold a letter in the middle; one for each start, short at the end."""
    n = max(0, len(flat) - size + 1)
    wide = flat.astype(np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += (wide[k : k + n] + np.uint64(1)) * PLACES[k]
    h ^= h >> np.uint64(29)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h, flat[1 : 1 + n] > 0


def slots(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(n - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(n - 1)).astype(np.int64)


NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def tally(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of two tallies: sorted values and how often each was seen."""
    at = np.searchsorted(a, b)
    known = a[np.minimum(at, len(a) - 1)] == b if len(a) else np.zeros(len(b), bool)
    n[at[known]] += m[known]
    return np.insert(a, at[~known], b[~known]), np.insert(n, at[~known], m[~known])


class Model:
    """languages in code point order; tables[i] has bit j of each slot for language 64 * i + j."""

    def __init__(self, languages: list[str], tables: list[np.ndarray]):
        self.languages, self.tables = languages, tables
        self.false = np.array([float(((tables[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** 2 for i in range(len(languages))])

    def predict(self, texts: list[str | None], letter: np.ndarray) -> list[tuple[str, float]]:
        return [x[:2] for x in self.judged(texts, letter)]

    def judged(self, texts: list[str | None], letter: np.ndarray) -> list[tuple[str, float, float]]:
        """(language, score, support): support is the language's corrected count as a share of the text's n-grams."""
        if not texts:
            return []
        counts, total, some = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for owners, starts, flat, inside in groups(texts, letter):
            np.logical_or.at(some, owners, np.add.reduceat(flat > 0, starts) > 0)
            for size in SIZES:
                h, real = grams(flat, size)
                real &= inside[: len(h)]
                at = np.minimum(starts, max(len(h) - 1, 0))
                np.add.at(total, owners, np.add.reduceat(real, at, dtype=np.int64))
                one, two = slots(h, len(self.tables[0]) if self.tables else 1)
                for i, table in enumerate(self.tables):
                    mask = np.where(real, table[one] & table[two], np.uint64(0))
                    for j in range(min(64, len(self.languages) - 64 * i)):
                        np.add.at(counts[64 * i + j], owners, np.add.reduceat((mask >> np.uint64(j)) & np.uint64(1), at).astype(float))
        if not self.languages:
            return [("und", 0.0, 0.0)] * len(texts)
        right = np.maximum(0, (counts - total * self.false[:, None]) / (1 - self.false[:, None]))
        best = right.argmax(0)
        top, sums = right[best, np.arange(len(texts))], right.sum(0)
        support = np.minimum(1.0, top / np.maximum(total, 1))
        return [(self.languages[b], float(min(1.0, x / s)) if s > 0 else 0.0, u) if has else ("und", 0.0, 0.0) for b, x, s, u, has in zip(best.tolist(), top.tolist(), sums.tolist(), support.tolist(), some.tolist(), strict=True)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int | None = None, n_slots: int = SLOTS) -> Model:
    """Learn from all of docs' labelled rows; where per_language is given, from so many of a language in expectation, chosen by a hash of the id.

    The driver gets a row for each label and for each slot that is set.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and id is not null and text is not null")
    seen = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(seen)
    if not languages:
        return Model([], [])
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    if per_language is not None:
        share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / seen[k])))])
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    labelled = usable.select(number[F.col("lang")].alias("lang"), "text")

    def count(batches):
        letter, held = letters(), {}

        def emptied():
            for (i, size), (found, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i)), pa.array(np.full(len(found), size)), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "size", "gram", "n"])
            held.clear()

        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                langs, texts = np.array(c.column(0).to_pylist()), c.column(1).to_pylist()
                for i in np.unique(langs).tolist():
                    for _, _, flat, inside in groups([t for t, k in zip(texts, langs, strict=True) if k == i], letter):
                        for size in SIZES:
                            h, real = grams(flat, size)
                            held[i, size] = tally(*held.get((i, size), NONE), *np.unique(h[real & inside[: len(h)]], return_counts=True))
                        if sum(len(x) for x, _ in held.values()) >= HELD:
                            yield from emptied()
        yield from emptied()

    counts = labelled.mapInArrow(count, "lang long, size long, gram long, n long").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    totals = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("chars"))  # a row a language
    by_gram = rates.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("in"))  # a language each at most
    chosen = by_gram.select("gram", F.explode(F.filter("in", lambda x: x["rate"] * RATIO >= F.col("most"))).alias("x")).select("gram", (F.col("x.lang") / 64).cast("long").alias("table"), F.expr("shiftleft(1L, cast(x.lang % 64 as int))").alias("bit"))
    places = F.array(F.col("gram").bitwiseAND(n_slots - 1), F.shiftrightunsigned("gram", 32).bitwiseAND(n_slots - 1))
    rows = chosen.select("table", "bit", F.explode(places).alias("slot")).groupBy("table", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    tables = [np.zeros(n_slots, np.uint64) for _ in range(-(-len(languages) // 64))]
    which, slot, mask = (rows.column(c).to_numpy() for c in ("table", "slot", "mask"))
    for i, t in enumerate(tables):
        t[slot[which == i]] = mask[which == i].view(np.uint64)
    return Model(languages, tables)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, lang_pred, score, support) for every row; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables))  # 8 * SLOTS bytes for every 64 languages

    def run(batches):
        letter, own = letters(), Model(*held.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                c = b.slice(at, 64)
                found = own.judged(c.column(0).to_pylist(), letter)
                yield pa.RecordBatch.from_arrays([*c.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], names=["id", "lang_pred", "score", "support"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    taken = docs.select(F.col(text_col).alias("text"), F.col(key).alias("id"))
    schema = StructType().add("id", taken.schema["id"].dataType).add("lang_pred", StringType()).add("score", DoubleType()).add("support", DoubleType())
    return taken.mapInArrow(run, schema).withColumnRenamed("id", key)


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, in whose text a language is recognised.

    A text needs support above 0 and at least ENOUGH times the median of all labelled rows of the same predicted language; supports are
    compared to GRAIN parts, so a language's supports are counted in as many rows and the median is that of the counts. Languages of one
    vocabulary may support a text alike: no margin to the second one is asked for. If nothing was learned (no labels, or no n-gram seen
    MIN_COUNT times), every text with a letter stays.
    """
    model = fit(docs, id_col, text_col, lang_col)
    if not any(t.any() for t in model.tables):
        return docs.where(F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)))
    # rows are told apart by a hash of id and text: Python gets no other column, and texts are shuffled only if very many rows go
    made = unused(docs)
    marked = docs.withColumn(made, F.xxhash64(F.col(id_col), F.col(text_col)))
    taken = marked.select(F.struct(made, (F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).alias("labelled")).alias("row"), text_col)
    judged = predict(taken, model, "row", text_col).select("row.*", "lang_pred", F.floor(F.col("support") * GRAIN).alias("part"), (F.col("support") > 0).alias("some"))
    judged = cut(judged)
    tallied = judged.where("labelled and lang_pred <> 'und'").groupBy("lang_pred", "part").agg(F.count(F.lit(1)).alias("n"))  # GRAIN + 1 rows a language at most
    usual = tallied.groupBy("lang_pred").agg(F.percentile("part", 0.5, F.col("n")).alias("m")).collect()  # a row a language
    least = F.create_map(*[x for r in usual for x in (F.lit(r["lang_pred"]), F.lit(ENOUGH * r["m"]))]) if usual else F.create_map(F.lit(""), F.lit(0.0))
    enough = F.col("some") & (F.col("part") >= F.coalesce(least[F.col("lang_pred")], F.lit(0.0)))
    gone = cut(judged.where(~enough).select(made).distinct())
    return semi(marked, gone, made, "left_anti").select(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out of learning: crc32 of its id as text, modulo 3, is 1 (a null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score), learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(F.col(id_col), held_out(id_col).alias("held_out"), "lang_pred", "score")
