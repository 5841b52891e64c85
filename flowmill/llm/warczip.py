"""WARC records in ZIP packages, read by range without extraction.

A package is a ZIP file with stored (not deflated) members: ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdxj``, a line a record with its range in the archive.  The reader takes the end record and the central
directory (ZIP64 where the counts or sizes ask for it), finds the stored members, and reads index and records by offset.

Of records with equal payloads of at least ``min_bytes``, the one of the smallest page_id is a response and the others
are revisits that name it; shorter payloads are all responses.

A record has an identifier of its own; page numbers stand in fields of their own, and a revisit names its response by
number, target and date.  A payload of over one row in HOT_SHARE meets its head by a broadcast (there are fewer than
HOT_SHARE such payloads), others by a shuffle.

Rows: null html is an empty payload; a null page_id is never referred to (alone among nulls it is a response); rows of
one page_id and one payload are all of one type; urls may be null or hold any characters; an empty table gives no
package; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import storage, textbuf

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PAGE, REFERS_TO = "X-Page-Id", "X-Refers-To-Page-Id"
HOT_SHARE = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKAGE_SCHEMA = "path string, n_records long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(url: str) -> str:
    return "".join(f"%{ord(x):02X}" if ord(x) < 33 or ord(x) == 127 else x for x in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, digest: str | None = None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", uuid.uuid4().urn.join("<>")), ("WARC-Date", date)]
    if page_id is not None:
        head.append((PAGE, str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", _target(url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest or digest32(payload)}"))
    if refers_to is not None:
        head += [(REFERS_TO, str(refers_to)), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE)]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _target(refers_url)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record; checks lengths, and the digest of a payload that is there."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n:
        raise ValueError("a record ends early")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError("a payload differs from its digest")
    page = lambda k: int(fields[k.lower()]) if k.lower() in fields else None
    return {"page_id": page(PAGE), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(REFERS_TO), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


class ZipDirectory:
    """The members of a ZIP file: name -> (method, first byte of data, size), from ranges of a seekable file."""

    def __init__(self, f, size: int):
        self.f = f
        tail_at = max(0, size - 65557)
        tail = self._read(tail_at, size - tail_at)
        k = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
        while k >= 0 and k + 22 + struct.unpack("<H", tail[k + 20 : k + 22])[0] != len(tail):
            k = tail.rfind(b"PK\x05\x06", 0, k)
        if k < 0:
            raise ValueError("no end record: not a ZIP file")
        count, n, at = struct.unpack("<HII", tail[k + 10 : k + 20])
        if count == 0xFFFF or n == 0xFFFFFFFF or at == 0xFFFFFFFF:
            sign, _, end_at, _ = struct.unpack("<IIQI", self._read(tail_at + k - 20, 20))
            if sign != 0x07064B50:
                raise ValueError("a ZIP64 locator is missing")
            end = self._read(end_at, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("a ZIP64 end record is missing")
            count, n, at = struct.unpack("<QQQ", end[32:56])
        self.members: dict[str, tuple[int, int, int]] = {}
        raw, p = self._read(at, n), 0
        for _ in range(count):
            if raw[p : p + 4] != b"PK\x01\x02":
                raise ValueError("a central directory entry is missing")
            flags, method = struct.unpack("<HH", raw[p + 8 : p + 12])
            packed, full, name_n, extra_n, note_n = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
            (offset,) = struct.unpack("<I", raw[p + 42 : p + 46])
            name = raw[p + 46 : p + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            packed, full, offset = self._wide(raw[p + 46 + name_n : p + 46 + name_n + extra_n], packed, full, offset)
            self.members[name] = (method, offset, packed)
            p += 46 + name_n + extra_n + note_n

    @staticmethod
    def _wide(extra: bytes, packed: int, full: int, offset: int) -> tuple[int, int, int]:
        """Sizes and offset with those of the ZIP64 extra field, which lists only what did not fit, full size first."""
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF and wide else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF and wide else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF and wide else offset
            extra = extra[4 + n :]
        return packed, full, offset

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def stored(self, name: str) -> tuple[int, int]:
        """(first byte, size) of a stored member's data in the package."""
        method, at, size = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        local = self._read(at, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a local header is missing")
        name_n, extra_n = struct.unpack("<HH", local[26:30])
        return at + 30 + name_n + extra_n, size

    def range(self, name: str, at: int, n: int) -> bytes:
        first, size = self.stored(name)
        if at < 0 or at + n > size:
            raise ValueError("a range beyond its member")
        return self._read(first + at, n)


def read_package(f, size: int, chunk: int = 4 << 20) -> Iterator[dict]:
    """The records of one package by its index, neighbouring records in one read of about ``chunk`` bytes."""
    z = ZipDirectory(f, size)
    lines = z.range(INDEX, 0, z.stored(INDEX)[1]).decode().splitlines()
    entries = [(int(e["offset"]), int(e["length"])) for e in (json.loads(x.split(" ", 2)[2]) for x in lines)]
    entries.sort()
    k = 0
    while k < len(entries):
        first, last = entries[k][0], k
        while last < len(entries) and (last == k or entries[last][0] + entries[last][1] - first <= chunk):
            last += 1
        raw = z.range(ARCHIVE, first, entries[last - 1][0] + entries[last - 1][1] - first)
        for at, n in entries[k:last]:
            yield parse_record(zlib.decompress(raw[at - first : at - first + n], 31))
        k = last


def write_package(out, records: Iterator[tuple[int | None, str | None, bytes, int | None, str | None]], date: str, level: int = 1) -> int:
    """records: (page_id, url, payload, refers_to, its url).  Streams the archive, then the sorted index.  Number of records."""
    index, at = [], 0
    stamp = re.sub(r"\D", "", date)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as f:
            for page_id, url, payload, refers_to, refers_url in records:
                digest = digest32(payload)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = packer.compress(record(page_id, url, payload, refers_to, date, digest, refers_url)) + packer.flush()
                f.write(raw)
                index.append(f"{page_id if page_id is not None else 'none'} {stamp} " + json.dumps({"url": url, "digest": f"sha1:{digest}", "offset": str(at), "length": str(len(raw))}))
                at += len(raw)
        with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for line in sorted(index):
                f.write(line.encode() + b"\n")
    return len(index)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Packages of ``pages`` (page_id, url, html) under ``folder``; the table of packages.  A task that runs again writes
    a package of its own, and only the one named in the table counts."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha"))
    large = F.octet_length("html") >= min_bytes
    heads = rows.filter(large).groupBy("sha").agg(F.min("page_id").alias("head"), F.min_by("url", "page_id").alias("head_url"), F.count(F.lit(1)).alias("n"))
    heads = storage.materialize(heads.filter("n > 1 AND head IS NOT NULL"), "heads")
    many = F.col("n") * HOT_SHARE > rows.count()
    hot = F.broadcast(heads.filter(many).select("sha", F.struct("head", "head_url").alias("_hot")))
    cold = heads.filter(~many).select(F.col("sha").alias("_key"), F.struct("head", "head_url").alias("_cold"))
    # rows that need no cold head are dealt evenly
    key = F.when(large & F.col("_hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("~"), F.xxhash64("page_id", "url").cast("string")))
    met = rows.join(hot, "sha", "left").withColumn("_key", key).join(cold, "_key", "left")
    found = F.when(large, F.coalesce("_hot", "_cold"))
    found = F.when(~F.col("page_id").eqNullSafe(found["head"]), found)
    dealt = met.select("page_id", "url", "html", found["head"].alias("head"), found["head_url"].alias("head_url"))

    def write(batches):
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        fs, root = storage.filesystem(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}.wacz"

        def records():
            batch = first
            while batch is not None:
                for page_id, url, payload, head, head_url in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    yield page_id, url, (payload or "").encode(), head, head_url
                batch = next(batches, None)

        with fs.open_output_stream(path) as out:
            n = write_package(out, records(), date)
        yield pa.RecordBatch.from_pydict({"path": [folder[: len(folder) - len(root)] + path if folder.endswith(root) else path], "n_records": [n]})

    return storage.materialize(dealt.mapInArrow(textbuf.frugal(write), PACKAGE_SCHEMA), "packages")


def read_archives(packages: DataFrame) -> DataFrame:
    """Every record of the packages (path)."""
    tasks = max(1, packages.count())

    def read(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = storage.filesystem(path)
                with fs.open_input_file(at) as f:
                    some, held = [], 0
                    for x in read_package(f, f.size()):
                        some.append(x)
                        held += x["payload_bytes"]
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(some, schema)
                            some, held = [], 0
                    if some:
                        yield pa.RecordBatch.from_pylist(some, schema)

    return packages.select("path").repartition(tasks).mapInArrow(textbuf.frugal(read), RECORD_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    return read_archives(write_archives(pages, storage.shared_dir(spark, "packages"), min_bytes))
