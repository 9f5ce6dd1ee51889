"""WARC records in ZIP packages: writer, and a reader that never extracts.

Each task packs its pages into ZIP files with two stored (uncompressed) members: a .warc.gz whose
records are gzip members of their own, and a CDXJ index with place and length of every record.  The
reader parses the end-of-directory records (ZIP64 forms included), finds both members through the central
directory, and reads neighbouring records with one range request each time; nothing is unpacked to disk.

Of records with equal payloads (SHA-256 and length) of ``min_bytes`` or more, the one with the largest
page_id is written as a response and the others as revisits of it, with the HTTP header of the full
payload and its digest.  A payload that a third of all pages share meets in no task: the largest id
comes from a partial aggregate, and the join back is one that Spark splits by itself when skewed.

Null html is an empty payload; a null url is left out of the header and read back as null.  Rows that repeat a page_id are
separate records, and those that have the largest id of their payload are responses all.  Null ids
are smaller than any other.  Extra columns are not read.  An empty table gives no archive.

Task attempts write under names of their own and report them in the manifest, so a lost executor's files
are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, open_fs, spread, table

ARCHIVE_BYTES, READ_BYTES = 64_000_000, 4_000_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Signatures and sizes of the ZIP format (APPNOTE 6.3.10): fixed values.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def record_id(page_id: int | None, sha: str) -> str:
    """Rows that share a page_id have records of their own if their payloads differ."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{sha}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record.  A URL with characters that a URI may not hold is escaped, and stands beside as it is."""
    sha, uri = digest(payload), urllib.parse.quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, sha)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if url is not None else []),
        *([f"X-Source-URL: {json.dumps(url)}"] if url is not None and url != uri else []),
        f"WARC-Payload-Digest: sha1:{sha}",
        *([f"WARC-Refers-To: {record_id(refers_to, sha)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse(raw: bytes) -> dict:
    """Fields of one record; a response's payload must have the length and digest that it names."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or digest(payload) != sha):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda s: int(n) if (n := s.split(":")[2]) else None
    url = json.loads(fields["X-Source-URL"]) if "X-Source-URL" in fields else fields.get("WARC-Target-URI")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": url, "payload_bytes": n, "payload_digest": sha, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


# -- writing


class _Package:
    """A ZIP package being written: records go straight to the stored member."""

    def __init__(self, url: str) -> None:
        fs, path = open_fs(url)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.url, self.raw = url, fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Unseekable(self.raw), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = self.payloads = 0

    def add(self, page_id, url, payload: bytes, refers_to, revisit: bool) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(record(page_id, url, payload, refers_to, revisit)) + z.flush()
        self.data.write(member)
        self.index.append(json.dumps({"id": page_id, "offset": self.at, "length": len(member)}))
        self.at += len(member)
        self.payloads += len(payload)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("\n".join(self.index).encode())
        self.zip.close()
        self.raw.close()
        return self.url, len(self.index), self.at


class _Unseekable:
    """What zipfile needs of a stream that can only be appended to."""

    def __init__(self, raw) -> None:
        self.raw, self.flush = raw, raw.flush

    def write(self, b) -> int:
        self.raw.write(b)
        return len(b)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the packages into folder and returns their manifest (path, records, bytes)."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    heads = rows.groupBy(F.col("key").alias("k")).agg(F.max("page_id").alias("head"))
    rows = rows.join(heads, F.col("key") == F.col("k"))
    revisit = (F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("head"))
    rows = rows.select("page_id", "url", "payload", F.when(revisit, F.col("head")).alias("refers_to"))

    def run(batches):
        package, done = None, []
        for b in batches:
            for page_id, url, data, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                package = package or _Package(f"{folder}/{uuid.uuid4().hex}.zip")
                package.add(page_id, url, data, refers_to, refers_to is not None)
                if package.payloads >= ARCHIVE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["path", "records", "bytes"])

    return cut(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


# -- reading


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """name -> (place of the data, length) of the stored members of a ZIP file open for range reads."""

    def at(place: int, n: int) -> bytes:
        f.seek(place)
        return f.read(n)

    tail_at = max(0, size - 22 - 65_535)
    tail = at(tail_at, size - tail_at)
    e = tail.rfind(END)
    if e < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[e + 10 : e + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = at(tail_at + e - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end = at(struct.unpack("<Q", locator[8:16])[0], 56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    directory, p, out = at(start, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != ENTRY:
            raise ValueError("damaged central directory")
        (method,) = struct.unpack("<H", directory[p + 10 : p + 12])
        packed, full, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        (local,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:  # ZIP64 has those of the three that do not fit, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            q += 4 + n
        head = at(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        n_local = sum(struct.unpack("<HH", head[26:30]))
        if method == 0:
            out[name] = (local + 30 + n_local, packed)
        p += 46 + n_name + n_extra + n_note
    return out


def read_package(url: str) -> Iterator[bytes]:
    """The records of one package, unzipped one by one, neighbours by one range request."""
    fs, path = open_fs(url)
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        found = members(f, size)
        f.seek(found[INDEX][0])
        index = [json.loads(line) for line in f.read(found[INDEX][1]).decode().split("\n") if line]
        base, k = found[DATA][0], 0
        while k < len(index):
            to, start = k, index[k]["offset"]
            while to + 1 < len(index) and index[to + 1]["offset"] + index[to + 1]["length"] - start <= READ_BYTES:
                to += 1
            f.seek(base + start)
            block = f.read(index[to]["offset"] + index[to]["length"] - start)
            for x in index[k : to + 1]:
                yield zlib.decompress(block[x["offset"] - start : x["offset"] - start + x["length"]], 31)
            k = to + 1


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the packages in the manifest."""
    names = [n for n in FIELDS if payloads or n != "payload"]
    spark_type = {"int64": "bigint", "string": "string", "binary": "binary"}

    def run(batches):
        for b in batches:
            for url in b.column(0).to_pylist():
                rows, held = [], 0
                for raw in read_package(url):
                    rows.append(parse(raw))
                    held += len(raw)
                    if len(rows) >= 2000 or held > 8 * READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, FIELDS[n]) for n in names]))
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, FIELDS[n]) for n in names]))

    return spread(manifest.select("path")).mapInArrow(run, ", ".join(f"{n} {spark_type[str(FIELDS[n])]}" for n in names))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(manifest, payloads=False).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages),
d AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(hex, (k // 8)::INT * 10 + 1, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to
FROM d
"""
