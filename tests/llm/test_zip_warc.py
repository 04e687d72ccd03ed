import gzip
import hashlib
import io
import os
import re
import zipfile

import pyarrow as pa
import pytest

from aerotally.llm import zip_warc as zw


def brute(pages, least=1000):
    out = []
    for p, u, h in pages:
        body = (h or "").encode()
        same = [q for q, _, x in pages if (x or "").encode() == body and q is not None]
        n = sum((x or "").encode() == body for _, _, x in pages)
        again = len(body) >= least and n > 1 and same and (p is None or p < max(same))
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", max(same) if again else None, None if u is None else re.sub("[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), u), b"" if again else body))
    return sorted(out, key=str)


PAGES = [(1, "http://a/é?x=1 2\r\nX: y", "<p>" + "é" * 600), (5, "http://b/%41", "<p>" + "é" * 600), (3, None, "<p>" + "é" * 600), (2, "u", None), (7, "u", ""), (8, "v", "short"), (9, "v", "short"), (None, "n", "z" * 1000), (10, "n", "z" * 1000), (10, "n", "z" * 1000), (None, "q", "k" * 2000), (None, "q", "k" * 2000), (11, "w", "\r\n\r\n" * 300), (12, "L", "long " * 200000), (13, "x", "y" * 999), (14, "x", "y" * 999)]


def test_round_trip_matches_brute_force(spark):
    df = spark.createDataFrame([(*p, "t", b"c") for p in PAGES], "page_id long, url string, html string, record_type string, payload binary").repartition(3)
    manifest = zw.write_archives(zw.plan_records(df), archive_bytes=600)
    assert manifest.count() > 3
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url, bytes(r.payload)) for r in zw.read_archives(manifest).collect()]
    assert sorted(got, key=str) == brute(PAGES)


@pytest.mark.parametrize("hot", [4, 10**9])
def test_round_trip_where_digests_are_not_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(zw, "MOST_BROADCAST", 1)
    monkeypatch.setattr(zw, "HOT_SHARE", hot)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = zw.read_archives(zw.write_archives(zw.plan_records(df))).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url, bytes(r.payload)) for r in got), key=str) == brute(PAGES)


def foreign(kind, block, extra="", version="WARC/1.0"):
    head = f"{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:0-{kind}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


FOREIGN = [
    foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields\r\n"),
    foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request\r\n"),
    foreign("response", b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\nbody of it", "Content-Type: application/http; msgtype=response\r\nWARC-Target-URI: http://a/b?c=%41\r\nWARC-Payload-Digest: md5:00\r\n"),
    foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 9\r\n\r\n3\r\nabc\r\n0\r\n\r\n", f"Content-Type: application/http\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(b'abc').hexdigest()}\r\n"),
    foreign("revisit", b"", "WARC-Refers-To: <urn:uuid:1>\r\n"),
    foreign("resource", b"\x00\x01", "Content-Type: image/x\r\nWARC-Target-URI: http://a/i\r\n  folded\r\n"),
]


@pytest.mark.parametrize("index", ["none", "indexes/index.cdxj", "indexes/index.cdx.gz"])
def test_archives_of_other_writers(spark, tmp_path, index):
    packed = [gzip.compress(r) for r in FOREIGN]
    lines, at = [b'!meta {"format": "cdxj"}'], 0
    for p in packed:
        lines.append(b'a,com)/ 2020 {"url": "x", "filename": "rec.warc.gz", "offset": "%d", "length": "%d"}' % (at, len(p)))
        at += len(p)
    path = str(tmp_path / "a.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/rec.warc.gz", b"".join(packed))
        if index != "none":
            z.writestr(index, gzip.compress(b"\n".join(lines)) if index.endswith("gz") else b"\n".join(lines))
    manifest = spark.createDataFrame([(f"file://{path}", os.path.getsize(path))], "archive string, size long")
    got = {(r.record_type, r.payload_bytes): r for r in zw.read_archives(manifest).collect()}
    assert sorted(k for k, _ in got) == ["request", "resource", "response", "response", "revisit", "warcinfo"]
    r = got["response", 10]
    assert (r.url, bytes(r.payload), r.payload_digest, r.page_id) == ("http://a/b?c=%41", b"body of it", hashlib.sha1(b"body of it").hexdigest(), None)
    assert got["revisit", None].payload_digest is None and got["resource", 2].url == "http://a/i folded" and got["request", 0].record_id == "<urn:uuid:0-request>"
    assert any(k == "response" and r.payload_digest == hashlib.sha1(b"abc").hexdigest() for (k, _), r in got.items())


def test_html_of_megabytes(spark):
    big = "<p>" + "grün " * 1_500_000
    df = spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", "x")], "page_id long, url string, html string")
    got = {r.page_id: r for r in zw.read_archives(zw.write_archives(zw.plan_records(df))).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and bytes(got[2].payload) == big.encode() and got[1].payload_bytes == len(big.encode())


def test_archives_are_plain_zip_files(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    (row,) = zw.write_archives(zw.plan_records(df)).collect()
    with zipfile.ZipFile(row.archive.removeprefix("file:")) as z:
        assert z.testzip() is None and zw.DATA in z.namelist() and len(z.read(zw.INDEX).splitlines()) == len(PAGES) == row.n_records


def test_zip64_directory_and_comment(monkeypatch):
    raw = io.BytesIO()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(6):
            z.writestr(f"archive/é{i}.txt", bytes([65 + i]) * (60 + i))
        z.comment = b"note PK\x05\x06 in it, with more than twenty-two bytes after the mark"
    data = raw.getvalue()
    assert b"PK\x06\x06" in data
    f = pa.BufferReader(data)
    members = zw.read_directory(f, len(data))
    assert [m.name for m in members] == [f"archive/é{i}.txt" for i in range(6)]
    for i, m in enumerate(members):
        at = zw.data_offset(f, m)
        assert data[at : at + m.size] == bytes([65 + i]) * (60 + i)


def test_without_index_the_data_is_walked():
    raw = io.BytesIO()
    records = [zw.pack_record(i, f"u{i}", b"x" * i * 50000, "response", hashlib.sha1(b"x" * i * 50000).hexdigest(), i * 50000, None) for i in range(5)]
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr(zw.DATA, b"".join(records))
    data = raw.getvalue()
    found = list(zw.archive_index(pa.BufferReader(data), len(data)))
    assert [data[a : a + n] for a, n in found] == records


def test_damage_raises():
    with pytest.raises(ValueError):
        zw.read_directory(pa.BufferReader(b"PK no zip here"), 14)
    good = zw.pack_record(1, "u", b"abc", "response", hashlib.sha1(b"abd").hexdigest(), 3, None)
    with pytest.raises(ValueError):
        zw.unpack_record(good)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zw.DATA, b"x" * 999)
    with pytest.raises(ValueError):
        list(zw.archive_index(pa.BufferReader(raw.getvalue()), len(raw.getvalue())))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert zw.read_archives(zw.write_archives(zw.plan_records(df))).count() == 0


def test_stores_are_opened_by_their_arrow_names(tmp_path):
    assert zw.arrow_uri("s3a://b/x.wacz") == "s3://b/x.wacz" and zw.arrow_uri("wasbs://c@a/x") == "abfss://c@a/x"
    assert zw.arrow_uri("hdfs://n:1/x") == "hdfs://n:1/x" and zw.arrow_uri("/a/b") == "/a/b" and zw.arrow_uri("file:/a") == "file:/a"
    assert zw._file_system(f"file://{tmp_path}")[1] == str(tmp_path)
    with pytest.raises(ValueError, match="dbfs"):
        zw._file_system("dbfs:/x")
