"""Files as tables: listings, contents, monitor events, and a data source of directory trees."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sextant.functions.paths import base_name, hidden, parent
from sextant.model import SCHEMAS


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``uri, file_name, folder, size, mtime`` of all files below a root, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(F.col("path").alias("uri"), base_name(F.col("path")).alias("file_name"), parent(F.col("path")).alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def contents(spark: SparkSession, root: str, mimes: dict[str, str]) -> DataFrame:
    """``path, mime, content`` of files; mimes: by extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    table = F.create_map(*[F.lit(x) for kv in mimes.items() for x in kv])
    return files.select("path", F.element_at(table, F.lower(F.substring_index("path", ".", -1))).alias("mime"), "content")


def crawl_counters(files: DataFrame, filtered) -> DataFrame:
    """``folder, found, ignored``; filtered: column of the files that don't count."""
    gone = filtered | hidden(F.col("file_name"))
    return files.groupBy("folder").agg(F.count_if(~gone).alias("found"), F.count_if(gone).alias("ignored"))


def monitor(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Change events as they arrive: JSON lines in new files of a folder; so many files at a time."""
    return spark.readStream.schema(SCHEMAS["monitor_events"]).option("maxFilesPerTrigger", files_per_trigger).json(path)


class Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[Folder]:
        """One for the root's own files, and one for each folder directly in it."""
        inner = [Folder(e.path) for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False)]
        return [Folder(self.root), *sorted(inner, key=lambda f: f.path)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if partition.path == self.root:
            found = ((self.root, e) for e in os.scandir(self.root) if e.is_file(follow_symlinks=False))
        else:
            found = ((d, e) for d, _, _ in os.walk(partition.path) for e in os.scandir(d) if e.is_file(follow_symlinks=False))
        for folder, entry in found:
            stat = entry.stat()
            yield "file://" + entry.path, entry.name, "file://" + folder, stat.st_size, int(stat.st_mtime)


class TreeSource(DataSource):
    """``spark.read.format("sextant_tree").load(path)``: an enumerator that can be replaced by another.

    The path must be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "sextant_tree"

    def schema(self) -> str:
        return "uri string, file_name string, folder string, size long, mtime long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
