"""A sink of one file a row: ``df.write.format("page_files").option("protected", wiki).save(folder)``.

Tasks write ``(path, content)`` rows into a folder beside the target, in stores
that Arrow can open; the commit renames it, so readers see all files or none, and
an abort deletes it.  A task that runs again writes the same files again.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .store import confined

NAME = "page_files"


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + posixpath.normpath(path.removeprefix("file:"))


class PageFiles(DataSource):
    """Writes ``path string, content string``; options ``path`` and ``protected`` (a folder that no target may be in)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        if [f.name for f in schema.fields] != ["path", "content"]:
            raise ValueError(f"the columns must be path and content, not {', '.join(f.name for f in schema.fields)}")
        target, protected = _uri(self.options["path"].rstrip("/")), self.options.get("protected")
        if protected is not None and (target + "/").startswith(_uri(protected.rstrip("/")) + "/"):
            raise ValueError(f"{target} is inside the protected folder {protected}")
        return PageWriter(target, overwrite)


class PageWriter(DataSourceWriter):
    def __init__(self, target: str, overwrite: bool) -> None:
        self.target, self.overwrite = target, overwrite
        self.stage = f"{target}.staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, base = fs.FileSystem.from_uri(self.stage)
        made: set[str] = set()
        for row in rows:
            at = f"{base}/{confined(row['path'])}"
            folder = posixpath.dirname(at)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(at) as f:
                f.write((row["content"] or "").encode())
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        store, stage = fs.FileSystem.from_uri(self.stage)
        target = fs.FileSystem.from_uri(self.target)[1]
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.target} exists; write with mode overwrite to replace it")
        if there:
            store.delete_dir(target)
        if store.get_file_info(stage).type == fs.FileType.NotFound:  # no rows
            store.create_dir(stage, recursive=True)
        store.move(stage, target)

    def abort(self, messages: list) -> None:
        store, stage = fs.FileSystem.from_uri(self.stage)
        if store.get_file_info(stage).type != fs.FileType.NotFound:
            store.delete_dir(stage)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)


def vault(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, content)`` of each page's note: its text and, without repeats, a line a link."""
    from ..operators.graph import vault_links

    noted = pages.select("id", "path", "content").join(vault_links(edges), "id", "left")
    lines = F.when(F.size("lines") > 0, F.concat(F.lit("\n\n## Links\n\n"), F.array_join("lines", "\n"), F.lit("\n"))).otherwise("")
    return noted.select("path", F.concat(F.coalesce("content", F.lit("")), F.coalesce(lines, F.lit(""))).alias("content"))


def write_vault(pages: DataFrame, edges: DataFrame, folder: str, wiki: str, overwrite: bool = False) -> None:
    """Write the vault; a target inside the wiki's own folder is refused."""
    register(pages.sparkSession)
    vault(pages, edges).write.format(NAME).option("protected", wiki).mode("overwrite" if overwrite else "append").save(folder)
