"""WARC archives in ZIPs: round trips, foreign ZIPs, revisits."""

import gzip
import hashlib
import io
import struct
import zipfile

import pytest

from lorespark.llm import warc_zip

ROWS = [
    (1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99), (7, "http://a/3", "y" * 100), (5, "http://é/ü x", "y" * 100), (5, "http://a/5", "y" * 100),
    (6, None, "é" * 50), (None, "http://a/6", "é" * 50), (8, "", None), (9, "http://a/9", ""), (10, "http://a/\r\nWARC-Type: x", "big " * 400_000),
    (11, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 20), (None, None, "only null " * 20), (None, None, "only null " * 20),
]
SCHEMA = "page_id long, url string, html string, payload int, record_type string, _n long"


def pages(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, 1, "old", 2) for r in rows], SCHEMA)


def plain(rows):
    """What must be read back, a row each."""
    least = {}
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= 100:
            least[html] = min(page_id, least.get(html, page_id))
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = least.get(html)
        again = first is not None and first != page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll", [1, 64 << 20])
def test_round_trip(spark, tmp_path, roll):
    manifest = warc_zip.write(warc_zip.record_types(pages(spark).repartition(3)), f"file://{tmp_path}", roll)
    found = warc_zip.read(manifest, payloads=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == plain(ROWS)
    bodies = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]) for r in found if r["record_type"] == "response"}
    assert all(hashlib.sha256(b).hexdigest() == d for (_, d), b in bodies.items())
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS)
    if roll == 1:
        assert manifest.count() == len(ROWS)


def test_archives_are_plain_zips_of_plain_warcs(spark, tmp_path):
    manifest = warc_zip.write(warc_zip.record_types(pages(spark).coalesce(1)), f"file://{tmp_path}").collect()
    with zipfile.ZipFile(manifest[0]["path"].removeprefix("file://")) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        warc = next(n for n in z.namelist() if n.endswith(".warc.gz"))
        assert gzip.decompress(z.read(warc)).count(b"WARC-Record-ID") == len(ROWS)
        index = next(n for n in z.namelist() if n.endswith(".cdxj"))
        assert len(z.read(index).splitlines()) == len(ROWS)


def test_no_pages_and_one_page(spark, tmp_path):
    manifest = warc_zip.write(warc_zip.record_types(pages(spark, []).limit(0)), f"file://{tmp_path}/none")
    assert manifest.count() == 0 and warc_zip.read(manifest).count() == 0
    one = warc_zip.write(warc_zip.record_types(pages(spark, [(None, None, None)])), f"file://{tmp_path}/one")
    assert [(r["page_id"], r["payload_bytes"], r["record_type"]) for r in warc_zip.read(one).collect()] == [(None, 0, "response")]


def wide(data: bytes) -> bytes:
    """The same one-member ZIP with ZIP64 fields in place of the short ones."""
    end = data.rindex(b"PK\5\6")
    length, begin = struct.unpack("<II", data[end + 12 : end + 20])
    entry = data[begin : begin + length]
    packed, full, n = struct.unpack("<IIH", entry[20:30])
    header = int.from_bytes(entry[42:46], "little")
    extra = struct.pack("<HHQQQ", 1, 24, full, packed, header)
    entry = entry[:20] + b"\xff" * 8 + entry[28:30] + struct.pack("<H", len(extra)) + entry[32:42] + b"\xff" * 4 + entry[46 : 46 + n] + extra
    record = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), begin)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, begin + len(entry), 1)
    return data[:begin] + entry + record + locator + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def one_member(name, body, method=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr(name, body)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("form", ["plain", "wide", "comment"])
def test_directories_of_foreign_zips(form):
    body = b"payload" * 50
    data = one_member("m.warc", body, comment=b"PK\5\6 in a comment" if form == "comment" else b"")
    data = wide(data) if form == "wide" else data
    f = io.BytesIO(data)
    (m,) = warc_zip.directory(f, len(data))
    at = warc_zip.data_offset(f, m)
    assert m.name == "m.warc" and m.size == len(body) and data[at : at + m.size] == body


def test_foreign_archives_without_an_index_are_read_whole(spark, tmp_path):
    plain_record = lambda i, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body) + 19}\r\n\r\n".encode() + b"HTTP/1.1 200 OK\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a.zip").write_bytes(one_member("x/a.warc", plain_record(1, b"one") + plain_record(2, b"two" * 200_000)))
    found = warc_zip.read(spark.createDataFrame([(f"file://{tmp_path}/a.zip",)], "path string")).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in found) == [(1, 3), (2, 600_000)]


def test_broken_archives_fail():
    data = one_member("m.warc", b"x" * 500, zipfile.ZIP_DEFLATED)
    (m,) = warc_zip.directory(io.BytesIO(data), len(data))
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.data_offset(io.BytesIO(data), m)
    with pytest.raises(ValueError, match="central directory"):
        warc_zip.directory(io.BytesIO(b"nothing"), 7)
    with pytest.raises(ValueError, match="inside a record"):
        list(warc_zip.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"), 0, 37))
