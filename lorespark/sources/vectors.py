"""Legacy binary vector files: header, then fixed-size entries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAGIC = b"WMV\0"
SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("v", T.ArrayType(T.FloatType()))])


def parse(raw: bytes) -> list[tuple[str, str, list[float]]]:
    """Entries of one file.

    Header: magic, u32 version 1, u32 dimensions, u64 count, u32 length of the
    model's name, the name padded to 32; an entry: u32 length of its id, the id
    padded to 8, a 32-byte content hash, little-endian floats.
    """
    if raw[:4] != MAGIC or struct.unpack_from("<I", raw, 4)[0] != 1:
        raise ValueError("not a version 1 vector file")
    dims, count, name = struct.unpack_from("<IQI", raw, 8)
    at, out = 24 + -(-name // 32) * 32, []
    for _ in range(count):
        (size,) = struct.unpack_from("<I", raw, at)
        key = raw[at + 4 : at + 4 + size].decode("utf-8", "replace")
        at += 4 + -(-size // 8) * 8
        out.append((key, raw[at : at + 32].hex(), list(struct.unpack_from(f"<{dims}f", raw, at + 32))))
        at += 32 + 4 * dims
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                yield pd.DataFrame(parse(bytes(raw)), columns=SCHEMA.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, SCHEMA)
