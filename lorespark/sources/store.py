"""The shared folder of a session, and checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is absent (tests), a temporary folder that is then set."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (have.get() if have.isDefined() else None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lorespark-")
    if not have.isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so loops keep a short lineage and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lorespark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where its files give fewer splits than there are cores; a larger input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def confined(path: str) -> str:
    """A relative path without detours; one that leaves its root or names hidden files or folders is refused."""
    out: list[str] = []
    if path.startswith("/") or "\0" in path:
        raise ValueError(f"the path leaves its root: {path}")
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if not out:
                raise ValueError(f"the path leaves its root: {path}")
            out.pop()
        else:
            out.append(part)
    if any(p.startswith(".") for p in out):
        raise ValueError(f"hidden files and folders are not read: {path}")
    return "/".join(out)


def allowed_sources(files: DataFrame, extensions: list[str] | None = None, folders: list[str] | None = None) -> DataFrame:
    """``files(path)`` with one of the extensions (none given: any) below one of the folders (none given: any)."""
    out = files
    if extensions:
        out = out.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*extensions))
    if folders:
        out = out.where(reduce(or_, [F.startswith("path", F.lit(confined(f) + "/")) for f in folders]))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
