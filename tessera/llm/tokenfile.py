"""Token-ID files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank by descending frequency over the whole corpus (ties by id), so the frequent ones take one
byte. Four ranks share a control byte with two bits each for the length of 1 to 4 bytes; the bytes themselves, low
byte first, follow in a stream of their own. Decoding looks control bytes up in a 256 x 4 table of lengths and gathers
the bytes with numpy.

Layout of a shard, little-endian: 8 bytes MAGIC; then blocks of a header (documents, control bytes, data bytes; three
int64), the documents' keys (int64), a byte each that is 1 where the key is null, their id counts (int64), control bytes,
data bytes. Each document's streams begin on a byte of their own. ``ranks.bin`` holds the ids by rank (uint32).

Documents stand in ascending key order over all shards, null keys first, equal keys by a hash of their ids. Null texts count as
empty and still get the end id; repeated rows are kept; further columns are ignored; an empty table gives no shard and
no row. Texts may be of any length.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TAIL, bytes_to_chars
from .common import Recent, cut, kept, remove, scratch

MAGIC = b"TSRVB001"
#: Bytes of a block at most, except for a longer document's own, and entries of a lookup cache.
BLOCK, CACHE = 8 << 20, 500_000
#: Lengths of the four ranks of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
#: Ids that are decoded together, except for a longer document's own.
TOGETHER = 1 << 16
#: Latin letters that have one letter in lower case.
LETTERS = re.escape("".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130"))
MARKS = re.escape(TAIL)
LATIN = re.compile(f"[{LETTERS}]+")
#: What stands between spaces or line ends; and that if it has other characters than letters and marks, else each run of either.
UNITS = re.compile("[^ \n]+")
PARTS = re.compile(f"[{LETTERS}{MARKS}]*+[^{LETTERS}{MARKS} \n][^ \n]*|[{LETTERS}]+|[{MARKS}]+")
#: What most texts are without: other characters, and marks in front of anything but a space or a line's end.
OTHER, INNER = re.compile(f"[^{LETTERS}{MARKS} \n]"), re.compile(f"[{MARKS}][^ \n]")


# -- the code --------------------------------------------------------------------------------------------------
def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2**32."""
    wide = 2 if len(ranks) and ranks.max() <= 0xFFFF else 4
    r = np.ascontiguousarray(ranks, f"<u{wide}")
    has = np.ones((len(r), wide), bool)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    for k in range(1, wide):
        np.greater_equal(r, 1 << 8 * k, out=has[:, k])
        codes[: len(r)] += has[:, k]
    four = codes.view("<u4")
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8)
    return control.tobytes(), r.view(np.uint8)[has.ravel()].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks behind control and data bytes."""
    return gathered(LENGTHS[control].ravel()[:n], data)


def gathered(size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ranks of so many bytes each."""
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        has = np.flatnonzero(size > k)
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def documents(counts: np.ndarray, control: np.ndarray, data: np.ndarray):
    """The ranks of each document of a block, in views of those that are decoded together."""
    ends, places = np.cumsum(counts), np.cumsum(-(-counts // 4))
    i = c = d = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - counts[i] + TOGETHER, "right")))
        size = LENGTHS[control[c : places[j - 1]]].ravel()
        # a document's last control byte may stand for fewer than four ranks
        n = counts[i:j]
        spare = -n % 4
        gaps = np.repeat(np.cumsum(n + spare) - spare, spare) + np.arange(spare.sum()) - np.repeat(np.cumsum(spare) - spare, spare)
        real = np.ones(len(size), bool)
        real[gaps] = False
        size = size[real]
        total = int(size.sum(dtype=np.int64))
        ranks = gathered(size, data[d : d + total])
        yield from np.split(ranks, np.cumsum(n)[:-1])
        i, c, d = j, int(places[j - 1]), d + total


# -- files -----------------------------------------------------------------------------------------------------
def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_whole(path: str, chunks) -> int:
    """Write a file under another name first, so a reader or a second attempt never sees a part of it."""
    import uuid

    store, at = filesystem(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    n = 0
    with store.open_output_stream(own := f"{at}.{uuid.uuid4().hex}") as f:
        for c in chunks:
            f.write(c)
            n += len(c)
    store.move(own, at)
    return n


def read_blocks(f):
    """Keys, nulls, counts, control and data of each block of an open shard."""
    assert f.read(8) == MAGIC, "not a token file"
    while head := f.read(24):
        n, c, d = np.frombuffer(head, "<i8").tolist()
        keys, nulls, counts = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), "u1"), np.frombuffer(f.read(8 * n), "<i8")
        yield keys, nulls, counts, np.frombuffer(f.read(c), "u1"), np.frombuffer(f.read(d), "u1")


# -- the operator ------------------------------------------------------------------------------------------------
class Encoder:
    """The ids, as little-endian uint32, of texts under a tokenizer that drops white space and merges nothing across it.

    What stands between spaces or line ends is encoded alone and looked up when it recurs. The tokenizer folds case and splits letters from marks
    (which is probed first), so what consists of Latin letters and marks alone is looked up by its runs of either, and
    letters go to the merges, in lower case, as the characters that stand for their bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.known = Recent(self.part, CACHE)
        self.model = self.tok.model
        self.chars = bytes_to_chars()
        # the tokenizer splits, folds and maps bytes as the short way assumes
        self.plain = all(self.library(x) == self.merged(x) for x in ("thing", "éñß", "œuvre")) and self.library("Ab, É c!?.d") == b"".join(map(self.library, ("ab", ",", "é", "c", "!?.", "d"))) and all(self.library("x" + y + "z") == b"".join(map(self.library, ("x", y, "z"))) for y in (*TAIL, TAIL))

    def library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, word: str) -> bytes:
        """The ids of a word of lower-case letters, which the tokenizer neither changes nor splits: the library's merges alone."""
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.chars))]).tobytes()

    def part(self, part: str) -> bytes:
        if self.plain and LATIN.fullmatch(part):
            return self.merged(part) if (low := part.lower()) == part else self.known[low]
        return self.library(part)

    def parts(self, text: str) -> list[str]:
        """What of a text is encoded alone; findall() takes several times as long as split()."""
        if not self.plain or OTHER.search(text) or INNER.search(text):
            return (PARTS if self.plain else UNITS).findall(text)
        for mark in TAIL:
            if mark in text:
                text = text.replace(mark, f" {mark}")
        return text.replace("\n", " ").split(" ")

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.known.__getitem__, self.parts(text or "")))


def encoder(path: str) -> Encoder:
    """Held by a Python worker from task to task."""
    return kept(Encoder, path)


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(key, ids, seen, times): ids, the end id among them, as little-endian integers of 16 bits where all ids fit, else of 32.

    The last row of each task has no ids but those seen in it, as 32 bits, and how often, as 64.
    """
    wide, vocabulary = width(tokenizer_path, end_id), ids_below(tokenizer_path, end_id)
    names = ["key", "ids", "seen", "times"]

    def run(batches):
        own, end, total = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), np.zeros(vocabulary, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                ids = []
                for t in c.column(1):
                    x = np.frombuffer(own.encode(t.as_py()) + end, "<u4")
                    total += np.bincount(x, minlength=vocabulary) if len(x) > vocabulary else 0
                    ids.append(x.astype(wide).tobytes())
                small = b"".join([x for x in ids if len(x) <= vocabulary * np.dtype(wide).itemsize])
                total += np.bincount(np.frombuffer(small, wide), minlength=vocabulary)
                none = pa.nulls(len(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([c.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), none, none], names=names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([total[at].astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, "key long, ids binary, seen binary, times binary")


def ids_below(tokenizer_path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(*Tokenizer.from_file(tokenizer_path).get_vocab().values(), end_id) + 1


def width(tokenizer_path: str, end_id: int) -> str:
    return "<u2" if ids_below(tokenizer_path, end_id) <= 1 << 16 else "<u4"


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs' ids below folder; a row (shard, path, n_docs, n_ids, n_bytes) for each file, from a written copy."""
    spark, vocabulary, kind = docs.sparkSession, ids_below(tokenizer_path, end_id), width(tokenizer_path, end_id)
    encoded = f"{folder}/encoded"
    tokenise(docs, tokenizer_path, end_id, id_col, text_col).write.option("compression", "zstd").parquet(encoded)
    both = spark.read.schema("key long, ids binary, seen binary, times binary").parquet(encoded)
    ids = both.where("seen is null").select("key", "ids")

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for seen, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total[np.frombuffer(seen, "<u4")] += np.frombuffer(times, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    # one row for each id of the vocabulary at most
    counted = both.where("seen is not null").select("seen", "times").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r["id"] for r in sorted(counted, key=lambda r: (-r["n"], r["id"]))], "<u4")
    write_whole(f"{folder}/ranks.bin", [by_rank.tobytes()])
    rank = np.zeros(vocabulary, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    total = sum(r["n"] for r in counted)

    def code(ids: pa.Buffer) -> tuple[int, bytes, bytes]:
        x = np.frombuffer(ids, kind)
        return len(x), *pack(rank[x])

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 64_000_000))
    # bounds are drawn from a sample of keys and ties, for which all rows are read once more: so ids are coded behind the shuffle, once
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    placed = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def store(batches):
        shard = TaskContext.get().partitionId()
        tally = [0, 0]

        def blocks():
            held, size = [], 0
            yield MAGIC

            def block():
                keys = np.array([k or 0 for k, *_ in held], "<i8")
                control, data = b"".join([x[2] for x in held]), b"".join([x[3] for x in held])
                yield np.array([len(held), len(control), len(data)], "<i8").tobytes()
                yield keys.tobytes() + bytes(k is None for k, *_ in held) + np.array([x[1] for x in held], "<i8").tobytes()
                yield control
                yield data

            for b in more():
                for key, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    held.append(row := (key, *code(ids.as_buffer())))
                    size += len(row[2]) + len(row[3])
                    tally[0] += 1
                    tally[1] += row[1]
                    if size >= BLOCK:
                        yield from block()
                        held, size = [], 0
            if held:
                yield from block()

        first = next((b for b in batches if b.num_rows), None)

        def more():
            yield first
            yield from batches

        if first is not None:
            n = write_whole(path := f"{folder}/shard-{shard:06d}.tvb", blocks())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [tally[0]], "n_ids": [tally[1]], "n_bytes": [n]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    made = cut(placed.drop("tie").mapInArrow(store, "shard long, path string, n_docs long, n_ids long, n_bytes long"))
    remove(spark, encoded)
    return made


def scan(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read shards back: (doc_id, start, n_tokens, ids_crc32[, ids]) with start counting all ids of earlier documents."""
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a file
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = filesystem(path)
                with store.open_input_stream(f"{at.rsplit('/', 1)[0]}/ranks.bin") as f:
                    by_rank = np.frombuffer(f.read(), "<u4")
                with store.open_input_stream(at) as f:
                    for keys, nulls, counts, control, data in read_blocks(f):
                        out: list[list] = [[] for _ in names]
                        for key, null, rows in zip(keys.tolist(), nulls.tolist(), documents(counts, control, data), strict=True):
                            ids = by_rank[rows]
                            for col, x in zip(out, (None if null else key, start, len(ids), zlib.crc32(ids), ids), strict=False):
                                col.append(x)
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    files = placed.select("path", "base", "shard").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").select("path", "base")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def roundtrip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write docs to token files in the shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    return scan(write(docs, folder or scratch(spark, "tokens"), tokenizer_path, end_id))
