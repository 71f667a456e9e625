"""WARC records in ZIP-packaged archives, written and range-read by Spark tasks.

An archive is a ZIP whose members are stored, not compressed: a ``.warc.gz`` of
one gzip member a record, and a ``.cdxj`` index with each record's offset and
length.  Readers parse the central directory (ZIP64 included), locate the stored
members by their local headers, turn the index into byte ranges of about
``RANGE`` bytes, and read only those ranges: no member is ever extracted, and
one large archive feeds many tasks.

``write`` is one map over the records; a task writes archives of about ``ROLL``
bytes under names that no other attempt uses, and only archives in the returned
manifest (checkpointed, so from exactly one attempt a partition) exist for
readers.  Files are reached through ``pyarrow.fs`` URIs (file, S3, GCS, HDFS)
under the shared folder, never a task's own disk.

``record_types`` marks captures with equal payloads of at least ``MIN_REVISIT``
bytes: that with the smallest page_id is the response, the others revisit it.
Only digests are grouped (partial minima, so a hot payload is no hot task).

Defined results: a null html is an empty payload; payloads below the limit are
all responses; rows that repeat the smallest page_id are responses, too (the
page was captured twice); a null page_id is never the original if another id
has the payload, and revisits it; a null url is written as the record's URN; an
empty table writes no archive.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import BinaryIO

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import broadcast_if_small, checkpointed, scratch, table

MIN_REVISIT = 100
ROLL = 64 << 20
RANGE = 4 << 20
CHUNK = 1 << 18
DATE = "2000-01-01T00:00:00Z"
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])
RANGES = T.StructType([T.StructField("path", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


# ---- ZIP directories -------------------------------------------------------


@dataclass
class Member:
    name: str
    stored: bool
    size: int
    header: int  # offset of the local header


def directory(f: BinaryIO, size: int) -> list[Member]:
    """The members of a ZIP, from its central directory alone."""
    tail_at = max(0, size - (22 + 65535))
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = len(tail)
    while (at := tail.rfind(b"PK\5\6", 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail):
            break
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = tail_at + at
    if count == 0xFFFF or length == 0xFFFFFFFF or begin == 0xFFFFFFFF:
        f.seek(end - 20)
        locator = f.read(20)
        if locator[:4] == b"PK\6\7":
            f.seek(int.from_bytes(locator[8:16], "little"))
            wide = f.read(56)
            if wide[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            count, length, begin = struct.unpack("<QQQ", wide[32:56])
            end = begin + length
    shift = end - length - begin  # bytes before the archive
    f.seek(begin + shift)
    raw, out, at = f.read(length), [], 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("a broken central directory")
        method, packed, full, n, extra, comment = struct.unpack("<H8xIIHHH", raw[at + 10 : at + 34])
        header = int.from_bytes(raw[at + 42 : at + 46], "little")
        name = raw[at + 46 : at + 46 + n].decode("utf-8", "replace")
        fields, k = raw[at + 46 + n : at + 46 + n + extra], 0
        while k + 4 <= len(fields):
            kind, room = struct.unpack("<HH", fields[k : k + 4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{room // 8}Q", fields[k + 4 : k + 4 + room // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + room
        out.append(Member(name, method == 0 and packed == full, packed, header + shift))
        at += 46 + n + extra + comment
    return out


def data_offset(f: BinaryIO, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if not m.stored:
        raise ValueError(f"{m.name} is compressed, so it has no byte ranges")
    f.seek(m.header)
    local = f.read(30)
    if local[:4] != b"PK\3\4":
        raise ValueError(f"no local header for {m.name}")
    n, extra = struct.unpack("<HH", local[26:30])
    return m.header + 30 + n + extra


# ---- WARC records ----------------------------------------------------------


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, size: int, digest: str, body: bytes) -> bytes:
    """One gzip-packed WARC record; a revisit has no payload of its own."""
    safe = urllib.parse.quote(url, safe="!#$%&'()*+,-./:;=?@[]_~") if url else urn(page_id)[1:-1]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (body if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _plain(f: BinaryIO, begin: int, end: int) -> Iterator[bytes]:
    """The bytes of a range, unpacked if they are gzip members."""
    f.seek(begin)
    unpack, first = None, True
    while begin < end:
        raw = f.read(min(CHUNK, end - begin))
        if not raw:
            raise ValueError("a range ends early")
        begin += len(raw)
        if first:
            unpack, first = (zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None), False
        if unpack is None:
            yield raw
            continue
        while raw:
            yield unpack.decompress(raw)
            raw = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)


def records(f: BinaryIO, begin: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record in a range."""
    source, held = _plain(f, begin, end), b""
    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            more = next(source, None)
            if more is None:
                if held.strip():
                    raise ValueError("a range ends inside a record")
                return
            held += more
        lines = held[:cut].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one is due")
        heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        need = cut + 4 + int(heads["content-length"]) + 4
        parts, size = [held], len(held)
        while size < need:
            more = next(source, None)
            if more is None:
                raise ValueError("a range ends inside a record")
            parts.append(more)
            size += len(more)
        held = b"".join(parts)
        yield heads, held[cut + 4 : need - 4]
        held = held[need:]


# ---- Spark -----------------------------------------------------------------


def record_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` a row."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(broadcast_if_small(checkpointed(first)), F.col("payload_digest") == F.col("_digest"), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"),
    )


class _Archive:
    """One archive being written."""

    def __init__(self, folder: str, name: str):
        fs, base = open_fs(folder)
        self.path, self.name = f"{folder}/{name}.zip", name
        self.stream = fs.open_output_stream(f"{base}/{name}.zip")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(f"archive/{name}.warc.gz"), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, row) -> None:
        body = b"" if row.payload is None else bytes(row.payload)
        packed = record(row.page_id, row.url, row.record_type, row.refers_to, row.payload_bytes, row.payload_digest, body)
        entry = {"filename": f"{self.name}.warc.gz", "offset": self.size, "length": len(packed), "type": row.record_type, "digest": f"sha256:{row.payload_digest}"}
        self.index.append(f"{urn(row.page_id)} {json.dumps(entry)}\n")
        self.member.write(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(f"indexes/{self.name}.cdxj"), "".join(self.index))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index)


def write(rows: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write ``record_types`` rows; the manifest ``(path, records)`` of the archives."""
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        archive, done = None, []
        for pdf in batches:
            for c in ("page_id", "refers_to"):
                # as objects: a column of integers and nulls would turn into floats
                pdf[c] = pd.Series([None if x == "" else int(x) for x in pdf[c]], pdf.index, dtype=object)
            for row in pdf.itertuples(index=False):
                if archive is None:
                    archive = _Archive(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}")
                archive.add(row)
                if archive.size >= roll:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=MANIFEST.names)

    # ids as text, as pandas has no nullable integers by default
    plain = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "refers_to")})
    return checkpointed(plain.mapInPandas(put, MANIFEST))


def ranges(archives: DataFrame, size: int = RANGE) -> DataFrame:
    """Byte ranges of whole records for ``archives(path)``, from their indexes."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    members = directory(f, f.size())
                    warcs = {m.name.rpartition("/")[2]: (data_offset(f, m), m.size) for m in members if m.name.endswith((".warc", ".warc.gz"))}
                    found, indexed = [], set()
                    for m in members:
                        if not m.name.endswith((".cdxj", ".cdx")):
                            continue
                        begin, rest, last = data_offset(f, m), b"", None
                        for lo in range(begin, begin + m.size, CHUNK):
                            f.seek(lo)
                            *lines, rest = (rest + f.read(min(CHUNK, begin + m.size - lo))).split(b"\n")
                            for x in lines:
                                if b"{" not in x:
                                    continue
                                e = json.loads(x[x.index(b"{") :])
                                a = warcs[e["filename"]][0] + int(e["offset"])
                                b = a + int(e["length"])
                                indexed.add(e["filename"])
                                if last and last[1] == a and b - last[0] <= size:
                                    last[1] = b
                                else:
                                    found.append(last := [a, b])
                    found += [[a, a + n] for name, (a, n) in warcs.items() if name not in indexed]
                yield pd.DataFrame([(path, a, b) for a, b in found if a < b], columns=RANGES.names)

    return archives.select("path").mapInPandas(locate, RANGES)


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of ``archives(path)``; ``payload`` is null unless asked for.

    A response's size and digest are those of the payload as read, and a digest
    that differs from its header fails the job; a revisit's come from its header.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                fs, at = open_fs(r.path)
                out, held = [], 0
                with fs.open_input_file(at) as f:
                    for heads, block in records(f, int(r.begin), int(r.end)):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        kind, said = heads["warc-type"], heads["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            size, digest = len(payload), sha256(payload).hexdigest()
                            if digest != said:
                                raise ValueError(f"{heads['warc-record-id']}: the payload is not what was written")
                        else:
                            size, digest = int(head.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0]), said
                        out.append((_id(heads["warc-record-id"]), heads.get("warc-target-uri"), kind, _id(heads.get("warc-refers-to")), size, digest, payload if payloads and kind == "response" else None))
                        held += len(payload)
                        if held > RANGE or len(out) >= 5_000:
                            yield _frame(out)
                            out, held = [], 0
                yield _frame(out)

    # a range is a few bytes here and megabytes in the task: the number of tasks must not follow the former
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ranges(archives).repartition(tasks, F.col("path"), F.col("begin"))
    return spread.mapInPandas(load, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=RECORDS.names, dtype=object)
    return pdf.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    rows = record_types(table(spark, sf_dir, "pages"))
    manifest = write(rows, scratch(spark, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
