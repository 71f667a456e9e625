"""Media columns: texts as baseline JPEG pictures, read back as DC thumbnails.

``encode`` gives every text a ``media`` column: its UTF-8 bytes, padded with
zero bytes to a positive multiple of ``BLOCK``, stand as the DC coefficients of
a grey baseline JPEG, ``BLOCK`` a block row, so the picture's DC-only thumbnail
is the payload.  Payloads of more rows than a JPEG can hold become several
pictures in a row.  ``decode`` takes any column of baseline JPEGs, parses their
markers, Huffman-decodes the scans (see ``jpeg.py``) and stores dimensions and
thumbnail hashes; it knows nothing of the texts.

How it scales: two maps over the rows, no shuffle, each row alone; pictures are
coded and decoded in groups of about ``GROUP`` payload bytes, which bounds the
memory beyond the Arrow batch and keeps numpy's vectors long.

Defined results: a null or empty text is one row of zero bytes; equal texts
give equal media and features; null media gives null features; bytes that are
no baseline JPEG give a row with ``error`` set and nulls else.  Extra columns
are carried through; a column with an added name is replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jpeg import MAX_ROWS, Picture, decode_thumbnails, encode_gray, parse
from .shared import texts_table

BLOCK = 64
GROUP = 1 << 20
HASH_SIDE = 8

FEATURES = T.StructType(
    [
        T.StructField("width", T.IntegerType()), T.StructField("height", T.LongType()), T.StructField("pictures", T.IntegerType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
        T.StructField("thumb_hash", T.StringType()), T.StructField("error", T.StringType()),
    ]
)


def payload(text: str | None) -> bytes:
    b = (text or "").encode("utf-8", "replace")
    return b + bytes(-len(b) % BLOCK or (BLOCK if not b else 0))


def encode_texts(texts: list[str | None]) -> list[bytes]:
    """The media of each text."""
    out: list[list[bytes]] = [[] for _ in texts]
    group: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        for k, media in zip(owner, encode_gray(group), strict=True):
            out[k].append(media)
        group.clear()
        owner.clear()

    held = 0
    for k, text in enumerate(texts):
        rows = np.frombuffer(payload(text), np.uint8).reshape(-1, BLOCK)
        for lo in range(0, len(rows), MAX_ROWS):
            group.append(rows[lo : lo + MAX_ROWS])
            owner.append(k)
            held += group[-1].size
            if held >= GROUP:
                flush()
                held = 0
    flush()
    return [b"".join(x) for x in out]


def average_hash(thumb: np.ndarray, side: int = HASH_SIDE) -> int:
    """Bits of ``side`` x ``side`` cell means that exceed the cells' median."""
    edge = lambda n: (np.arange(side) * n // side, np.maximum((np.arange(side) + 1) * n // side, np.arange(side) * n // side + 1))
    total = np.zeros((len(thumb) + 1, thumb.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(thumb, 0, dtype=np.int64), 1, out=total[1:, 1:])
    (top, bottom), (west, east) = edge(len(thumb)), edge(thumb.shape[1])
    area = (bottom - top)[:, None] * (east - west)[None, :]
    cells = (total[bottom][:, east] - total[top][:, east] - total[bottom][:, west] + total[top][:, west]) / area
    return int.from_bytes(np.packbits(cells.ravel() > np.median(cells)).tobytes(), "big")


class _Reading:
    """Features of one media value, gathered picture by picture."""

    def __init__(self, media: bytes):
        self.media, self.sha, self.tail = media, hashlib.sha256(), b""
        self.width = self.height = self.pictures = self.size = self.hash = 0
        self.error: str | None = None

    def add(self, p: Picture, thumb: np.ndarray) -> None:
        body = thumb.tobytes()
        self.sha.update(body)
        self.size += len(body)
        self.tail = (self.tail + body[-BLOCK:])[-BLOCK:]
        self.width, self.height, self.pictures = max(self.width, p.width), self.height + p.height, self.pictures + 1
        self.hash = (self.hash * 31 + average_hash(thumb)) & (2**64 - 1)

    def row(self) -> tuple:
        stored = len(self.media), hashlib.sha256(self.media).hexdigest()
        if self.error is not None:
            return (None,) * 6 + (*stored, None, self.error)
        return self.width, self.height, self.pictures, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), *stored, f"{self.hash:016x}", None


def read_media(values: list[bytes | None]) -> list[tuple | None]:
    """Features of each media value, in the order of ``FEATURES``."""
    readings = [None if v is None else _Reading(bytes(v)) for v in values]
    group: list[tuple[_Reading, Picture]] = []

    def flush() -> None:
        try:
            for (r, p), thumb in zip(group, decode_thumbnails([(r.media, p) for r, p in group]), strict=True):
                r.add(p, thumb)
        except ValueError:  # one of them is bad: find out which
            for r, p in group:
                try:
                    r.add(p, decode_thumbnails([(r.media, p)])[0])
                except ValueError as e:
                    r.error = str(e)
        group.clear()

    held = 0
    for r in readings:
        at = 0
        while r is not None and r.error is None and (at < len(r.media) or not r.media):
            try:
                p = parse(r.media, at)
            except (ValueError, IndexError, KeyError) as e:
                r.error = f"{type(e).__name__}: {e}"
                break
            group.append((r, p))
            held += p.end - at
            at = p.end
            if held >= GROUP:
                flush()
                held = 0
    flush()
    return [None if r is None else r.row() for r in readings]


@F.pandas_udf(T.BinaryType())
def _encode_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(encode_texts(list(texts)), dtype=object)


@F.pandas_udf(FEATURES)
def _read_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    nothing = (None,) * len(FEATURES)
    for values in batches:
        yield pd.DataFrame([nothing if x is None else x for x in read_media(list(values))], columns=FEATURES.names, dtype=object)


def encode(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with every text as JPEG media."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != media.lower()]
    return docs.select(*kept, _encode_udf(F.col(f"`{text}`")).alias(media))


def decode(rows: DataFrame, media: str = "media", features: str = "features") -> DataFrame:
    """``rows`` with the features struct of their JPEG media."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() != features.lower()]
    return rows.select(*kept, _read_udf(F.col(f"`{media}`")).alias(features))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's media digests and features."""
    docs = texts_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    read = decode(encode(docs).drop("text")).drop("media")
    f = F.col("features")
    return read.select(
        "doc_id", "n_bytes", f["payload_bytes"].alias("payload_bytes"), f["payload_sha256"].alias("payload_sha256"), f["tail_crc32"].alias("tail_crc32"),
        f["media_bytes"].alias("media_bytes"), f["media_sha256"].alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", f["width"], f["height"]), f["pictures"], f["thumb_hash"]).alias("feature"),
    )
