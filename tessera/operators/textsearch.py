"""Text search by regular expression, behind a trigram index."""

from __future__ import annotations

import re
import re._parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a matching line that are shown.
SHOWN = 200


# -- trigrams ------------------------------------------------------------------------------------------------------
def trigrams(files: DataFrame, only: set[int] | None = None) -> DataFrame:
    """(file_id, tri, mask) of texts (file_id, text): distinct runs of three bytes, with a bit for each residue modulo 8 of a byte that follows.

    With ``only`` the index holds those trigrams and no others, of every text.
    """

    def run(batches):
        wanted = None
        if only is not None:
            wanted = np.zeros(1 << 24, bool)
            wanted[list(only)] = True
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                rows = whole.slice(start, 256)
                at, tris, masks = [], [], []
                for i, raw in enumerate(rows.column(1).cast(pa.binary()).to_pylist()):
                    if raw is None or len(raw) < 3:
                        continue
                    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
                    tri = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
                    bit = np.append(np.uint32(1) << b[3:] % 8, np.uint32(0))  # nothing follows the last
                    if wanted is not None:
                        here = np.flatnonzero(wanted[tri])
                        tri, bit = tri[here], bit[here]
                    both = np.unique(tri << 8 | bit)  # 24 and 8 bits
                    held, first = np.unique(both >> 8, return_index=True)
                    if len(held):
                        at.append(np.full(len(held), i))
                        tris.append(held.astype(np.int32))
                        masks.append(np.bitwise_or.reduceat(both & 255, first).astype(np.int32))
                if at:
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(tris)), pa.array(np.concatenate(masks))], names=["file_id", "tri", "mask"])

    kind = T.StructType([T.StructField("file_id", files.schema["file_id"].dataType), T.StructField("tri", T.IntegerType()), T.StructField("mask", T.IntegerType())])
    # rows may share a file_id
    return files.select("file_id", "text").mapInArrow(run, kind).groupBy("file_id", "tri").agg(F.bit_or("mask").alias("mask"))


def asked(pattern: str) -> set[int] | None:
    """The trigrams that candidates() looks for; None if the index can't tell."""
    every = [plan(literals) for literals in branches(pattern)]
    return None if None in every else {t for terms in every for t in terms}


def plan(literals: list[str]) -> dict[int, int] | None:
    """Trigram -> mask that a text must have to hold all literals; None if none is long enough to say anything."""
    out: dict[int, int] = {}
    for lit in literals:
        raw = lit.encode()
        for i in range(len(raw) - 2):
            tri = int.from_bytes(raw[i : i + 3], "big")
            out[tri] = out.get(tri, 0) | (1 << raw[i + 3] % 8 if i + 3 < len(raw) else 0)
    return out or None


def branches(pattern: str) -> list[list[str]]:
    """For each alternative of a regular expression the literals that any match must hold."""

    def required(tokens) -> list[list[str]]:
        done: list[list[str]] = [[]]
        run = ""

        def close():
            nonlocal run
            if run:
                for d in done:
                    d.append(run)
            run = ""

        for op, arg in tokens:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            close()
            inner = None
            if name == "SUBPATTERN" and not arg[1] and not arg[2]:
                inner = required(arg[3])
            elif name == "BRANCH":
                inner = [b for alt in arg[1] for b in required(alt)]
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                inner = required(arg[2])
            if inner is not None and len(done) * len(inner) <= 64:
                done = [a + b for a in done for b in inner]
        close()
        return done

    return required(sre.parse(pattern))


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """(file_id) of files that may match, as a grouped intersection of postings; None if the index can't tell."""
    out = None
    for literals in branches(pattern):
        terms = plan(literals)
        if terms is None:
            return None
        want = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv])
        hits = index.where(F.col("tri").isin(*terms)).where(F.col("mask").bitwiseAND(want[F.col("tri")]) == want[F.col("tri")])
        part = hits.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("file_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


# -- lines -----------------------------------------------------------------------------------------------------------
def lines(files: DataFrame) -> DataFrame:
    """(path, lang, line, start, text) for every line; start is its first character's offset, line counts from 1."""
    each = files.select("path", "lang", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("start", F.coalesce(before, F.lit(0))).select("path", "lang", (F.col("i") + 1).alias("line"), "start", "text")


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (path, at, ...) with the id, name and kind of the innermost of the spans (path, start, end, id, name, kind) that holds them, or nulls."""
    held = points.select("path", "at").distinct().join(spans, "path").where((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")))
    inner = held.groupBy("path", "at").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "id", "name", "kind")).alias("s"))
    return points.join(inner, ["path", "at"], "left").select(*points.columns, "s.id", "s.name", "s.kind")


def text_search(files: DataFrame, pattern: str, case_insensitive: bool = False, lang: str | None = None, prefix: str | None = None, spans: DataFrame | None = None, symbol: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """(path, line, column, text[, id, name, kind]): the first match of each line; columns count bytes from 1.

    Required literals filter whole texts before they are split; index holds trigrams() by path as file_id. A symbol confines the search to its definitions.
    """
    re.compile(pattern)
    if lang is not None:
        files = files.where(F.col("lang") == lang)
    if prefix is not None:
        files = files.where((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/"))
    alternatives = branches(pattern)
    if all(alternatives) and len(alternatives) <= 16:
        low = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
        hit = F.lit(False)
        for literals in alternatives:
            own = F.lit(True)
            for x in literals:
                own = own & low(F.col("text")).contains(low(F.lit(x)))
            hit = hit | own
        files = files.where(hit)
    if index is not None and not case_insensitive:
        few = candidates(index, pattern)
        if few is not None:
            files = files.join(few.withColumnRenamed("file_id", "path"), "path", "left_semi")
    full = f"(?i){pattern}" if case_insensitive else pattern
    if spans is None:
        hits = files.select("path", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("line", F.col("i") + 1)
    else:
        hits = lines(files)
    at = F.regexp_instr("text", F.lit(full))
    hits = hits.where(F.col("text").rlike(full)).withColumn("before", F.substr("text", F.lit(1), at - 1))
    hits = hits.withColumn("column", F.octet_length("before") + 1)
    shown = F.left(F.col("text"), F.lit(SHOWN))
    if spans is None:
        return hits.select("path", "line", "column", shown.alias("text"))
    placed = enclosing(hits.select("path", "line", "column", shown.alias("text"), (F.col("start") + F.length("before")).alias("at")), spans).drop("at")
    return placed.where(F.col("name") == symbol) if symbol is not None else placed


def mentions(files: DataFrame, name: str, attributed: DataFrame) -> DataFrame:
    """(path, n): whole-word occurrences of a name in files (path, text) that aren't among the attributed (path)."""
    word = rf"(?<![\p{{L}}\p{{N}}_]){re.escape(name)}(?![\p{{L}}\p{{N}}_])"
    own = files.where(F.col("text").contains(name)).join(attributed.select("path").distinct(), "path", "left_anti")
    return own.select("path", F.regexp_count("text", F.lit(word)).cast("bigint").alias("n")).where("n > 0")
