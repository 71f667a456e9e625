"""Audit log queries over ``(line_no, value)`` rows of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()), T.StructField("tool_name", T.StringType()), T.StructField("action", T.StringType()),
        T.StructField("duration_ms", T.LongType()), T.StructField("result", T.StringType()), T.StructField("error_message", T.StringType()),
        T.StructField("entity_refs", T.ArrayType(T.StringType())),
    ]
)
QUIET = ("help", "initial")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines; events sort by file, block and place in it."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.monotonically_increasing_id().alias("line_no"), "value", F.from_json("value", EVENT).alias("event"))


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` lines in file order."""
    return log.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def since(log: DataFrame, marker: str) -> DataFrame:
    """Lines after the first that contains ``marker``; none if no line does."""
    first = log.where(F.contains("value", F.lit(marker))).agg(F.min("line_no").alias("_first"))
    return log.where(F.col("line_no") > first.scalar())


def search(log: DataFrame, part: str) -> DataFrame:
    return log.where(F.contains(F.lower("value"), F.lit(part.lower())))


def append(events: DataFrame, path: str, quiet: tuple[str, ...] = QUIET) -> None:
    """Write events as JSON lines, without the quiet actions."""
    events.where(~F.col("action").isin(*quiet)).write.mode("append").json(path)


def sanitised(c: Column | str, limit: int = 256) -> Column:
    """Text for security events: no control characters, cut at ``limit``."""
    return F.substring(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\p{Cntrl}", ""), 1, limit)
