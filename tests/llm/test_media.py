"""JPEG media: exact round trips, pictures of other encoders, bad bytes."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm import jpeg, media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=300)), max_size=6))
def test_payload_returns_exactly(texts):
    stored = media.encode_texts(texts)
    for text, value, row in zip(texts, stored, media.read_media(stored), strict=True):
        body = media.payload(text)
        got = dict(zip(media.FEATURES.names, row, strict=True))
        assert got["payload_bytes"] == len(body) > 0 and len(body) % 64 == 0 and body.rstrip(b"\0") == (text or "").encode("utf-8", "replace").rstrip(b"\0")
        assert got["payload_sha256"] == hashlib.sha256(body).hexdigest() and got["tail_crc32"] == zlib.crc32(body[-64:])
        assert got["media_bytes"] == len(value) and got["media_sha256"] == hashlib.sha256(value).hexdigest() and got["error"] is None


def test_bytes_of_all_kinds_and_texts_of_several_pictures():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 256, (n, 64)).astype(np.uint8) for n in (1, 7, 300)] + [np.zeros((2, 64), np.uint8), np.full((3, 64), 255, np.uint8)]
    stored = jpeg.encode_gray(blocks)
    for want, got in zip(blocks, jpeg.decode_thumbnails([(x, jpeg.parse(x)) for x in stored]), strict=True):
        assert (want == got).all()
    long = "é long text " * 60_000
    (value,) = media.encode_texts([long])
    row = dict(zip(media.FEATURES.names, media.read_media([value])[0], strict=True))
    assert row["pictures"] == 2 and row["payload_sha256"] == hashlib.sha256(media.payload(long)).hexdigest()


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        self.s += format(value, f"0{n}b") if n else ""

    def done(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")


def amount(v):
    n = abs(v).bit_length()
    return n, v if v > 0 else v + (1 << n) - 1


def colour_picture(rng, width, height, interval):
    """A 4:2:0 picture with AC coefficients, coded symbol by symbol; and its luminance DC grid."""
    ac_lengths, ac_symbols = (0, 2, 1, 2, *[0] * 12), (0x00, 0x01, 0x12, 0xF0, 0x31)
    dc, ac = jpeg.code_table(jpeg.DC_LENGTHS, jpeg.DC_SYMBOLS), jpeg.code_table(ac_lengths, ac_symbols)
    across, down = -(-width // 16), -(-height // 16)
    grid = np.zeros((down * 2, across * 2), int)
    scan, bits, before = b"", Bits(), [0, 0, 0]
    for m in range(across * down):
        if interval and m and m % interval == 0:
            scan += bits.done() + bytes((0xFF, 0xD0 + (m // interval - 1) % 8))
            bits, before = Bits(), [0, 0, 0]
        for c, n in ((0, 4), (1, 1), (2, 1)):
            for i in range(n):
                value = rng.randrange(-60, 60)
                size, extra = amount(value - before[c])
                bits.put(*dc[size])
                bits.put(extra, size)
                before[c] = value
                if c == 0:
                    grid[m // across * 2 + i // 2, m % across * 2 + i % 2] = value
                k = 1
                while k < 64:
                    s = rng.choice([x for x in ac_symbols if x == 0 or k + (16 if x == 0xF0 else (x >> 4) + 1) <= 64])
                    bits.put(*ac[s])
                    if s == 0:
                        break
                    bits.put(rng.randrange(1 << (s & 15)) if s & 15 else 0, s & 15)
                    k += 16 if s == 0xF0 else (s >> 4) + 1
    scan += bits.done()
    part = lambda marker, body: bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body
    head = b"\xff\xd8" + part(0xFE, b"a comment") + part(0xDB, bytes((0, 4, *[2] * 63)))
    head += part(0xC0, bytes((8,)) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes((3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0)))
    head += part(0xC4, bytes((0, *jpeg.DC_LENGTHS, *jpeg.DC_SYMBOLS)) + bytes((0x10, *ac_lengths, *ac_symbols)))
    head += part(0xDD, interval.to_bytes(2, "big")) if interval else b""
    head += part(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0)))
    want = np.clip((grid * 4 + 4 >> 3) + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]
    return head + scan + b"\xff\xd9", want


def test_colour_pictures_with_ac_coefficients_and_restarts():
    rng = random.Random(8)
    made = [colour_picture(rng, w, h, r) for w, h, r in ((16, 16, 0), (50, 37, 0), (64, 48, 3), (33, 100, 1))]
    got = jpeg.decode_thumbnails([(x, jpeg.parse(x)) for x, _ in made])
    for (_, want), thumb in zip(made, got, strict=True):
        assert thumb.shape == want.shape and (thumb == want).all()


def test_bad_media_become_error_rows_and_leave_others_alone():
    good = media.encode_texts(["a fine text"])[0]
    cut = good[: len(good) - 20] + b"\xff\xd9"
    rows = media.read_media([good, b"", b"no picture", good[:40], None, cut, good])
    errors = [r is not None and r[-1] is not None for r in rows]
    assert errors == [False, True, True, True, False, True, False] and rows[4] is None
    assert rows[0] == rows[6] and rows[1][0] is None


def test_average_hash_bits():
    thumb = np.zeros((16, 64), np.uint8)
    thumb[:, 32:] = 200
    assert media.average_hash(thumb) == int("00001111" * 8, 2)
    assert media.average_hash(np.zeros((1, 64), np.uint8)) == 0


def test_columns_and_rows_pass_through(spark):
    rows = [(1, "same", "x", 1), (2, "same", None, None), (3, None, "y", 2), (4, "", "y", 2), (None, "same", "z", 3), (1, "same", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string, features int")
    out = media.decode(media.encode(docs))
    assert out.columns == ["doc_id", "text", "media", "features"]
    got = out.collect()
    assert len(got) == len(rows)
    assert len({bytes(r["media"]) for r in got if r["text"] == "same"}) == 1 and len({r["features"] for r in got if not r["text"]}) == 1
    assert media.decode(media.encode(docs.limit(0))).count() == 0
    nothing = spark.createDataFrame([(None,)], "media binary")
    assert media.decode(nothing).first()["features"]["width"] is None


def test_query_against_digests_of_the_texts(spark, sf):
    from lorespark.llm.shared import table

    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = media.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        body = media.payload(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((texts[r["doc_id"]] or "").encode()), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]
