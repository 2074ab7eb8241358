import gzip
import hashlib
import io
import json
import zipfile

import pytest

from tessera.llm import common, warczip


def brute(rows):
    out, first = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            first[b] = max(first.get(b, i), i)
    count = {}
    for _, _, h in rows:
        count[h or ""] = count.get(h or "", 0) + 1
    for i, _, h in rows:
        b = (h or "").encode()
        refers = first.get(b) if len(b) >= 1000 and count[h or ""] > 1 and i != first.get(b) else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [0, 400_000])
def test_roundtrip(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST", broadcast)
    big, rows = "é" * 600, []
    for i in range(60):
        rows.append((i, f"http://h/{i}\n", [big, "small", f"page {i} " * 300, None, "", "x\r\n\r\ny" * 200][i % 6]))
    rows += [(None, None, big), (None, None, "n" * 1001), (None, None, "n" * 1001), (59, "u", "x\r\n\r\ny" * 200), (100, "long", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    packages = warczip.write(df, f"{tmp_path}/w")
    assert sorted(map(tuple, warczip.scan(packages).collect()), key=str) == brute(rows)
    for r in packages.collect():  # another reader agrees that they are sound ZIP files
        with zipfile.ZipFile(r["path"]) as z:
            assert z.testzip() is None and sorted(z.namelist()) == [warczip.DATA, warczip.INDEX]
    assert warczip.roundtrip(df.limit(0)).count() == 0


def test_rotation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warczip, "PACKAGE", 2000)
    rows = [(i, "u", f"{i} " * 700) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    packages = warczip.write(df, f"{tmp_path}/w")
    assert packages.count() > 1 and sorted(map(tuple, warczip.scan(packages).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("far", [False, True])
@pytest.mark.parametrize("before", [b"", b"#! starts\n"])
def test_directory(monkeypatch, far, before):
    if far:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    raw = io.BytesIO()
    raw.write(before)
    with zipfile.ZipFile(raw, "a") as z:
        z.comment = b"a comment with PK\x05\x06 inside"
        for i in range(5):
            z.writestr(f"é{i}", b"data" * i * 10)
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    data = raw.getvalue()
    d = warczip.Directory(lambda at, n: data[at : at + n], len(data))
    for i in range(5):
        at, n = d.locate(f"é{i}")
        assert data[at : at + n] == b"data" * i * 10
    with pytest.raises(ValueError, match="compressed"):
        d.locate("packed")
    with pytest.raises(ValueError, match="not a ZIP"):
        warczip.Directory(lambda at, n: b"nothing"[at : at + n], 7)


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("index", ["none", "jsonl", "cdxj", "cdxj.gz"])
def test_other_packages(tmp_path, packed, index, monkeypatch):
    """Several archives and other indexes, or none."""
    path, lines, want = tmp_path / "x.wacz", [], []
    with zipfile.ZipFile(path, "w") as z:
        for k in range(2):
            body = b""
            for i in range(k * 10, k * 10 + 4):
                raw = warczip.record(i, "http://u/", f"payload {i}".encode() * 99, "d", None)
                raw = gzip.compress(raw) if packed else raw
                x = {"filename": f"part{k}.warc", "offset": len(body), "length": str(len(raw))}
                lines.append(json.dumps(x | {"page": i}) if index == "jsonl" else f"u,http)/ 2000 {json.dumps(x)}")
                body += raw
                want.append((i, f"payload {i}".encode() * 99))
            z.writestr(f"archive/part{k}.warc", body)
        text = "\n".join(["!meta", *lines]).encode()
        if index != "none":
            z.writestr(f"indexes/index.{index}", gzip.compress(text) if index.endswith("gz") else text)
        z.writestr("pages/pages.jsonl", "{}")
    assert [(page, r["payload"]) for page, r in warczip.records(str(path))] == want
    raw = b"".join(warczip.record(i, None, b"x" * i * 50, "d", None) for i in range(9))
    for step in (7, 100, 10**6):
        assert [len(warczip.parse(r)["payload"]) for r in warczip.walk(lambda at, n: raw[at : at + n], 0, len(raw), step)] == [i * 50 for i in range(9)]
