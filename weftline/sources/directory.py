"""Source files of a directory tree as rows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.config import SKIPPED_DIRS, SUFFIX_LANGUAGE, Settings
from weftline.functions.text import language_of


class Slice(InputPartition):
    """Files, or a directory that the task walks itself."""

    def __init__(self, paths: list[str], below: str | None = None):
        self.paths, self.below = paths, below


class TreeReader(DataSourceReader):
    """The driver lists the uppermost directories only, until there are enough for the tasks, which walk and read what is below; whole
    directories are left out before they are entered. Spark's own file sources hide
    names that begin with ``_`` or a dot, so ``__init__.py`` would be lost to them."""

    SLICE, DIRECTORIES = 500, 256

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def _look(self, at: str) -> tuple[list[str], list[str]]:
        """Directories to enter and source files of one directory, by path below the root."""
        dirs, files = [], []
        with os.scandir(os.path.join(self.root, at)) as entries:
            for e in sorted(entries, key=lambda x: x.name):
                if e.is_dir():
                    if not e.is_symlink() and e.name not in SKIPPED_DIRS and not e.name.startswith("."):
                        dirs.append(os.path.join(at, e.name))
                elif e.name.endswith(tuple(SUFFIX_LANGUAGE)):
                    files.append(os.path.join(at, e.name))
        return dirs, files

    def partitions(self) -> list[InputPartition]:
        level, found = [""], []
        while level and len(level) < self.DIRECTORIES:
            looked = [self._look(d) for d in level]
            found += [f for _, files in looked for f in files]
            level = [d for dirs, _ in looked for d in dirs]
        return [Slice(found[k : k + self.SLICE]) for k in range(0, len(found), self.SLICE)] + [Slice([], d) for d in level] or [Slice([])]

    def walk(self, at: str) -> Iterator[str]:
        todo = [at]
        while todo:
            dirs, files = self._look(todo.pop())
            todo += reversed(dirs)
            yield from files

    def read(self, partition: Slice) -> Iterator[tuple]:
        for path in partition.paths if partition.below is None else self.walk(partition.below):
            full = os.path.join(self.root, path)
            try:
                with open(full, "rb") as f:
                    content = f.read()
                stat = os.stat(full)
            except OSError:  # gone or not readable since it was listed
                continue
            yield path.replace(os.sep, "/"), content, len(content), datetime.fromtimestamp(stat.st_mtime, timezone.utc).replace(tzinfo=None)


class TreeDataSource(DataSource):
    """Option: path, a directory that the driver and all executors see."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content binary, length long, modified_at timestamp_ntz"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """(path, language, content, size_bytes, content_hash, fingerprint, modified_at) of the files under ``root`` with a known suffix.

    Directories that begin with a dot or hold builds and dependencies are left out (files that begin with a dot are not), and so are files
    that are no UTF-8 or longer than max_file_size characters. Only files that the path filter keeps are read."""
    spark.dataSource.register(TreeDataSource)
    rows = spark.read.format("source_tree").option("path", root).load()
    text = F.try_validate_utf8(F.col("content").cast("string"))
    out = rows.select(
        F.col("path"),
        language_of(F.col("path")).alias("language"),
        text.alias("text"),
        F.col("length").cast("int").alias("size_bytes"),
        F.sha2("content", 256).alias("content_hash"),
        F.sha1("content").alias("fingerprint"),
        F.col("modified_at"),
    )
    return out.where(F.col("text").isNotNull() & (F.char_length("text") <= settings.max_file_size)).withColumnRenamed("text", "content")
