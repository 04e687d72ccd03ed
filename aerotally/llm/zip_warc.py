"""WARC records in ZIP-packaged archives, written and range-read without extraction.

An archive is a ZIP file whose members are stored, not deflated:
``archive/data.warc.gz`` (one gzip member per record, so a record can be read by
its range) and ``indexes/index.cdxj`` (a line per record with its range). The
reader finds the end record and its ZIP64 twin, parses the central directory,
locates the stored members by their local headers, reads the index and then
only the ranges of the records it wants; nothing is unpacked to disk.

Records with equal payloads of at least ``min_payload`` bytes are written once:
the one with the largest page_id is the response, the others are revisits of it.
Writers stream, so a task holds one batch of records and the index of one
archive. An archive's name is unique to the task attempt, and only the manifest
that Spark commits names it, so an attempt that is lost leaves no record twice.
Files are opened by URI (pyarrow's file systems: local or mounted, S3, GCS,
HDFS), below ``spark.checkpoint.dir`` unless a folder is given.

The reader takes archives of other writers too: any record type, with or without
payload digests, indexes as CDX or CDXJ lines, plain or gzipped, and archives
without an index, whose data is walked.

Defined results: a null html is an empty payload; payloads of any length are
written whole; a null page_id keeps its record, and is a revisit only where an
equal payload has a page_id; a null url leaves the record without a target; a
url's spaces, controls and characters beyond ASCII are percent-encoded and read
back so; repeated rows each get a record (those that repeat the largest page_id
are all responses); an empty table gives an empty result; extra columns are
ignored. A record that isn't of this writer has a null page_id; its digest is the
header's SHA-1, or computed where it has a payload, or null.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from gzip import decompress as gunzip
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from aerotally.plans.storage import fresh_dir, materialise

MIN_PAYLOAD, ARCHIVE_BYTES, RANGE_BYTES, TASK_BYTES = 1000, 256 << 20, 4 << 20, 64 << 20
#: Digests of repeated payloads that are broadcast (60 bytes each); more are joined by a shuffle, but for hot ones.
MOST_BROADCAST, HOT_SHARE = 200_000, 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "%/:?#[]@!$&'()*+,;=~|<>{}^`\"\\"
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


# --- records


def pack_record(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, size: int, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record as a gzip member. ``digest`` is the payload's hex SHA-1, ``size`` its length."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + pack.flush()


def _headers(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, fields by lower-case name, and what follows the empty line."""
    head, _, rest = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:  # a folded line
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            fields[last] = value.strip()
    return first, fields, rest


def _sha1(value: str | None) -> str | None:
    """The hex form of a labelled digest, if it is a SHA-1."""
    name, _, code = (value or "").partition(":")
    if name.lower() != "sha1":
        return None
    return code.lower() if len(code) == 40 else base64.b32decode(code.upper()).hex()


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if value and value.startswith("<urn:page:") and number.lstrip("-").isdigit() else None


def unpack_record(member: bytes) -> dict:
    """record_id, page_id, url, record_type, refers_to, payload, payload_bytes and payload_digest of a record; a damaged one raises."""
    raw = zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member
    version, fields, rest = _headers(raw)
    if not version.startswith("WARC/") or "content-length" not in fields:
        raise ValueError("not a WARC record")
    block, end = rest[: (n := int(fields["content-length"]))], rest[n:]
    if len(block) != n or end.strip(b"\r\n"):
        raise ValueError("not a whole WARC record")
    kind, stated = fields.get("warc-type", ""), _sha1(fields.get("warc-payload-digest"))
    payload, size = block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        _, http, payload = _headers(block)
        size = int(x) if (x := http.get("content-length", "")).isdigit() else None
        as_sent = "transfer-encoding" in http  # the digest may be of the decoded payload
    else:
        as_sent = False
    if kind == "revisit":
        digest = stated
    else:
        if kind == "response" and size is not None and not as_sent and len(payload) != size:
            raise ValueError(f"payload of {fields.get('warc-record-id')} isn't as long as its header says")
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if stated and not as_sent and stated != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't match its digest")
        digest = stated or digest
    return {
        "record_id": fields.get("warc-record-id"), "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")), "payload": payload, "payload_bytes": size, "payload_digest": digest,
    }


# --- the ZIP container


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def read_directory(f: pa.NativeFile, size: int) -> list[Member]:
    """The members of a ZIP file from its central directory, by range reads only."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        data = f.read(n)
        if len(data) != n:
            raise ValueError("the file ends too early")
        return data

    start = max(0, size - 22 - 0xFFFF)
    tail = at(start, size - start)
    where = tail.rfind(_EOCD)
    while where >= 0 and (where + 22 > len(tail) or where + 22 + struct.unpack_from("<H", tail, where + 20)[0] != len(tail)):
        where = tail.rfind(_EOCD, 0, where)
    if where < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, where + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (length, offset):
        locator = at(start + where - 20, 20)
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        record = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    directory = at(offset, length)
    members, here = [], 0
    for _ in range(count):
        if directory[here : here + 4] != _CENTRAL:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, here + 8)
        packed, whole, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, here + 20)
        header = struct.unpack_from("<I", directory, here + 42)[0]
        name = directory[here + 46 : here + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, end = here + 46 + name_n, here + 46 + name_n + extra_n
        while extra + 4 <= end:
            kind, n = struct.unpack_from("<HH", directory, extra)
            if kind == 1:  # ZIP64: 8 bytes for each field that is full, in this order
                full = iter(struct.unpack_from(f"<{n // 8}Q", directory, extra + 4))
                whole = next(full) if whole == 0xFFFFFFFF else whole
                packed = next(full) if packed == 0xFFFFFFFF else packed
                header = next(full) if header == 0xFFFFFFFF else header
            extra += 4 + n
        members.append(Member(name, method, whole, packed, header))
        here = end + note_n
    return members


def data_offset(f: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0 or member.size != member.packed:
        raise ValueError(f"{member.name} is compressed, so it can't be read by ranges")
    f.seek(member.header)
    local = f.read(30)
    if local[:4] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def archive_index(f: pa.NativeFile, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the archive, length) of every record: from the index, or by walking the data where there is none."""
    members = {m.name: m for m in read_directory(f, size)}
    base = {name: data_offset(f, m) for name, m in members.items() if name.startswith("archive/") and name.endswith((".warc.gz", ".warc"))}
    indexes = [m for name, m in members.items() if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))]
    for m in indexes:
        f.seek(data_offset(f, m))
        lines = f.read(m.size)
        for line in (gunzip(lines) if lines[:2] == b"\x1f\x8b" else lines).splitlines():
            entry = line.split(b" ", 2)
            if line[:1] == b"!" or len(entry) < 3 or entry[2][:1] != b"{":
                continue  # a header line
            entry = json.loads(entry[2])
            yield base[f"archive/{entry['filename']}"] + int(entry["offset"]), int(entry["length"])
    if not indexes:
        for name, start in base.items():
            if not name.endswith(".gz"):
                raise ValueError(f"{name} has no index and isn't compressed by record")
            at, stop = start, start + members[name].size
            while at < stop:
                f.seek(at)
                unpack, n = zlib.decompressobj(31), 0
                while not unpack.eof:
                    chunk = f.read(min(1 << 16, stop - at - n))
                    if not chunk:
                        raise ValueError(f"{name} ends inside a record")
                    unpack.decompress(chunk)
                    n += len(chunk) - len(unpack.unused_data)
                yield at, n
                at += n


class ArchiveWriter:
    """Streams records into one archive."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.path, self.at, self.lines = path, 0, []
        self.sink = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, page_id: int | None, record: bytes) -> None:
        entry = {"filename": DATA.split("/")[1], "offset": str(self.at), "length": str(len(record))}
        self.lines.append(f"page:{page_id} 20240101000000 {json.dumps(entry)}\n".encode())
        self.data.write(record)
        self.at += len(record)

    def close(self) -> int:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), b"".join(self.lines))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        size = self.sink.tell()
        self.sink.close()
        return size


# --- Spark


def plan_records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)`` per row; revisits carry no payload."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    shared = rows.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    shared = materialise(shared.where("_n > 1 and _last is not null"), "warc-shared")  # no payload in it
    total = shared.agg(F.count("*").alias("n"), F.sum("_n").alias("rows")).first()
    keys = ["payload_digest", "payload_bytes"]
    again = F.col("_last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_last")))
    decided = ["page_id", "url", F.when(~again, F.col("payload")).alias("payload"), *keys, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_last")).alias("refers_to")]
    few = shared.drop("_n")
    if total.n <= MOST_BROADCAST:  # payloads stay where they are
        return rows.join(F.broadcast(few), keys, "left").select(*decided)
    # payloads that more than one in HOT_SHARE repeats has are decided in place, so that none of them makes a large task
    is_hot = F.col("_n") * HOT_SHARE > F.lit(total.rows)
    hot = F.broadcast(shared.where(is_hot).drop("_n"))  # HOT_SHARE rows at most
    warm = rows.join(hot, keys).select(*decided)
    rest = rows.join(hot, keys, "left_anti").join(shared.where(~is_hot).drop("_n"), keys, "left").select(*decided)
    return warm.unionByName(rest)


#: Spark's names of stores that pyarrow calls otherwise; those it has under the same name need none.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(uri: str) -> str:
    """A folder's or file's URI as pyarrow names it; a store that it doesn't know raises when it is opened."""
    scheme, found, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if found else uri


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    try:
        return pafs.FileSystem.from_uri(arrow_uri(uri))
    except pa.ArrowInvalid as e:
        raise ValueError(f"archives can't be kept at {uri}: pyarrow has no file system for it; set spark.checkpoint.dir to one that it has (file, hdfs, s3, gs, abfs)") from e


def write_archives(records: DataFrame, folder: str | None = None, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records below ``folder``; the manifest ``(archive, size, n_records)`` of what was committed."""
    folder = folder or fresh_dir(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        made: list[tuple[str, int, int]] = []
        writer = None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    writer = ArchiveWriter(fs, f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz")
                page_id, url, payload, size, digest, kind, refers_to = row
                writer.add(page_id, pack_record(page_id, url, payload or b"", kind, digest, size, refers_to))
                if writer.at >= archive_bytes:
                    made.append((writer.path, writer.close(), len(writer.lines)))
                    writer = None
        if writer is not None:
            made.append((writer.path, writer.close(), len(writer.lines)))
        for path, size, n in made:
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"], "size": [size], "n_records": [n]})

    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return materialise(records.select(*columns).mapInArrow(run, "archive string, size long, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest`` (``archive`` URI and ``size``), by range reads."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = _file_system(uri)
                with fs.open_input_file(path) as f:
                    ranges = list(archive_index(f, size))
                for at in range(0, len(ranges), 8192):
                    some = ranges[at : at + 8192]
                    yield pa.RecordBatch.from_pydict({"archive": [uri] * len(some), "at": [a for a, _ in some], "length": [n for _, n in some]})

    fields = {"record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    if with_payload:
        fields["payload"] = pa.binary()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = sorted(zip(*[c.to_pylist() for c in batch.columns]))
            at = 0
            while at < len(wanted):  # neighbours within RANGE_BYTES are one read
                uri, start, _ = wanted[at]
                stop = at
                while stop < len(wanted) and wanted[stop][0] == uri and (stop == at or wanted[stop][1] + wanted[stop][2] - start <= RANGE_BYTES):
                    stop += 1
                fs, path = _file_system(uri)
                with fs.open_input_file(path) as f:
                    f.seek(start)
                    data = f.read(wanted[stop - 1][1] + wanted[stop - 1][2] - start)
                found = [unpack_record(data[a - start : a - start + n]) for _, a, n in wanted[at:stop]]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in found], t) for c, t in fields.items()})
                at = stop

    ranges = manifest.select("archive", "size").mapInArrow(index, "archive string, at long, length long")
    bytes_ = manifest.agg(F.sum("size")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-bytes_ // TASK_BYTES))  # by what is read, not by the size of the ranges' rows
    dealt = ranges.repartition(tasks, "archive", F.floor(F.col("at") / F.lit(RANGE_BYTES)))
    schema = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return dealt.mapInArrow(records, schema)
