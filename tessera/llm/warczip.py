"""WARC records in ZIP packages: a writer with payload revisits, and a reader that takes records out by range.

A package is a ZIP file with stored members: ``archive/data.warc.gz``, each record a gzip member of its own, and
``indexes/index.jsonl`` with a line (page, offset, length) for each record. The reader parses the end record, the ZIP64 records and the central
directory, locates the stored members, reads the indexes and then only the ranges they name; nothing is extracted. It takes any members below
``archive/`` and ``indexes/``: lines of JSON or CDXJ, packed or not, several archives told apart by ``filename``; an archive that no index names
is read record by record.

Of records with equal payloads of REVISIT bytes or more, that with the largest id is a response and the others revisit it,
without their payload; smaller ones are responses.

Defined cases: a null html counts as empty; a null url has no target line; rows that share the largest id are all responses; rows
with a null id are written and read back with a null id, and of equal payloads without any id all are responses; texts of any length are
written whole; further columns are ignored; an empty table gives no package and no row.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, scratch
from .tokenfile import filesystem

#: Bytes from which an equal payload is a revisit, and of records after which a package is closed.
REVISIT, PACKAGE = 1000, 256 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# -- records ---------------------------------------------------------------------------------------------------
def record(page, url, payload: bytes, digest: str, refers) -> bytes:
    """One WARC record; refers: the page that it revisits."""
    revisit = refers is not None
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    head.append(f"WARC-Record-ID: <urn:page:{page}>" if page is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The named fields of a record, its block under ``block`` and the payload under ``payload``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields | {"block": block, "payload": block.partition(b"\r\n\r\n")[2]}


# -- packages --------------------------------------------------------------------------------------------------
class Package:
    """A ZIP file that is written front to back under another name and takes its own when it is whole."""

    def __init__(self, path: str):
        self.store, self.at = filesystem(path)
        self.store.create_dir(self.at.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.at}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.own)
        self.zip = zipfile.ZipFile(self, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.index = 0, []

    def write(self, x) -> int:  # for the ZIP writer
        self.out.write(x)
        return len(x)

    def flush(self) -> None:
        pass

    def add(self, page, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"page": page, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.out.close()
        self.store.move(self.own, self.at)


class Directory:
    """Members of a ZIP file from its central directory; read(offset, size) gives bytes of the file."""

    END, FAR_AT, FAR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - 0xFFFF)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(self.END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(self.END, 0, at)  # the mark may stand in the comment
        if at < 0:
            raise ValueError("not a ZIP file")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        if end >= 20 and (locator := read(end - 20, 20))[:4] == self.FAR_AT:
            far = read(far_at := struct.unpack_from("<Q", locator, 8)[0], 56)
            if far[:4] != self.FAR:  # something stands before the archive
                far = read(far_at := end - 76, 56)
            if far[:4] != self.FAR:
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", far, 32)
            end = far_at
        self.shift = end - length - start  # bytes before the archive
        self.members = self.entries(read(start + self.shift, length), count)

    def entries(self, raw: bytes, count: int) -> dict[str, tuple[int, int, int, int, int]]:
        """name: (flags, method, stored size, size, place of the local header)."""
        out, at = {}, 0
        for _ in range(count):
            if raw[at : at + 4] != self.ENTRY:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
            place = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # 64-bit values of those fields that are full, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    place = next(wide) if place == 0xFFFFFFFF else place
                extra = extra[4 + n :]
            out[name] = (flags, method, packed, size, place)
            at += 46 + n_name + n_extra + n_note
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Place and size of a stored member's bytes."""
        flags, method, packed, _, place = self.members[name]
        if method or flags & 1:
            raise ValueError(f"{name} is compressed or encrypted; only stored members can be read by range")
        head = self.read(place + self.shift, 30)
        if head[:4] != self.LOCAL:
            raise ValueError("no local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return place + self.shift + 30 + n_name + n_extra, packed


def index_lines(raw: bytes, name: str):
    """The JSON object of each line of an index: lines of JSON, or of CDXJ, where it stands behind a key and a time; packed if the name ends in .gz."""
    if name.endswith(".gz"):
        raw = gzip.decompress(raw)
    for line in raw.decode("utf-8").splitlines():
        if (at := line.find("{")) >= 0:
            yield json.loads(line[at:])


def unpacked(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw


def walk(read, place: int, size: int, step: int = 1 << 20):
    """The raw records of an archive member without an index, one gzip member or plain record after another."""
    left, at, end = b"", place, place + size

    def more() -> bytes:
        nonlocal at
        got = read(at, min(step, end - at))
        at += len(got)
        return got

    while left or at < end:
        left = left or more()
        if left[:1] == b"\x1f":
            part, out = zlib.decompressobj(31), []
            while not part.eof:
                if not (left := left or more()):
                    raise ValueError("an archive ends within a record")
                out.append(part.decompress(left))
                left = part.unused_data
            yield b"".join(out)
            continue
        while (cut := left.find(b"\r\n\r\n")) < 0 and (got := more()):
            left += got
        found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", left[:cut])
        if cut < 0 or not found:
            if left.strip():
                raise ValueError("an archive ends within a record")
            return
        whole = cut + 4 + int(found[1]) + 4
        while len(left) < whole and (got := more()):
            left += got
        yield left[:whole]
        left = left[whole:]


def records(path: str):
    """(page, record) for each record that a package's indexes name; of archives that none names, all records in their order.

    page is the index's, else that of the record's own id.
    """
    store, at = filesystem(path)
    with store.open_input_file(at) as f:
        read = lambda offset, size: f.read_at(size, offset)
        zip_ = Directory(read, f.size())
        archives = [m for m in zip_.members if m.startswith("archive/") and m != "archive/"]
        base, named = {m: zip_.locate(m) for m in archives}, set()

        def page_of(x: dict, r: dict):
            return x["page"] if "page" in x else number(r.get("warc-record-id"))

        for index in (m for m in zip_.members if m.startswith("indexes/") and m != "indexes/"):
            for x in index_lines(read(*zip_.locate(index)), index):
                if "offset" not in x:
                    continue
                archive = f"archive/{x['filename'].rpartition('/')[2]}" if x.get("filename") else archives[0]
                named.add(archive)
                r = parse(unpacked(read(base[archive][0] + int(x["offset"]), int(x["length"]))))
                yield page_of(x, r), r
        for archive in archives:
            if archive not in named:
                for raw in walk(read, *base[archive]):
                    r = parse(raw)
                    yield page_of({}, r), r


def number(urn: str | None):
    """The page of a name that record() gave, else None."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


# -- the operator ------------------------------------------------------------------------------------------------
def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write packages below folder; a row (path, n_records) for each, from a written copy."""
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("n"))
    again = rows.where(F.col("n") >= REVISIT).groupBy("digest").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("same")).where("same > 1").drop("same")
    again = cut(again)
    if again.count() <= common.BROADCAST:
        joined = rows.join(F.broadcast(again), "digest", "left")
    else:  # pages too small to repeat are dealt out by their own ids
        key = F.when(F.col("n") >= REVISIT, F.col("digest")).otherwise(F.concat_ws("-", F.lit(""), "page", "digest"))
        joined = rows.withColumn("key", key).join(again.withColumnRenamed("digest", "key"), "key", "left")
    typed = joined.select("page", "url", "html", "digest", F.when((F.col("n") >= REVISIT) & ~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def run(batches):
        part, package, made = TaskContext.get().partitionId(), None, []

        def close():
            package.close()
            made.append((f"{folder}/part-{part:06d}-{len(made):04d}.wacz", len(package.index)))

        for b in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if package is None:
                    package = Package(f"{folder}/part-{part:06d}-{len(made):04d}.wacz")
                package.add(page, record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers))
                if package.size >= PACKAGE:
                    close()
                    package = None
        if package is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "n_records"])

    return cut(typed.mapInArrow(run, "path string, n_records long"))


def scan(packages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the packages at ``path``.

    A response's digest and length are computed from the payload that was read, and must be those of its header.
    """

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for page, r in records(path):
                    digest, n = r["warc-payload-digest"].removeprefix("sha1:"), int(r["x-payload-length"])
                    if r["warc-type"] == "response" and (hashlib.sha1(r["payload"]).hexdigest(), len(r["payload"])) != (digest, n):
                        raise ValueError(f"{path}: the payload of page {page} isn't what its header says")
                    rows.append((page, n, digest, r["warc-type"], number(r.get("warc-refers-to"))))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("path").repartition(n, "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def roundtrip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to packages in the shared folder and read them back."""
    return scan(write(pages, folder or scratch(pages.sparkSession, "warc")))


def sql() -> str:
    return f"""with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
f as (select d, max(page_id) as first from p where n >= {REVISIT} group by d having count(*) > 1)
select page_id, n as payload_bytes, p.d as payload_digest, case when n >= {REVISIT} and page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
case when n >= {REVISIT} and page_id is distinct from first then first end as refers_to from p left join f on p.d = f.d"""
