"""Source trees as tables, by a Python data source: Spark's own file readers leave out names that begin with ``_`` or ``.``.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").load("/path/to/tree")

One row a file: path (relative, with slashes), size, head (the first bytes, for probes) and content (text, or null
if it isn't UTF-8). The driver lists the top folders alone; the others are walked, and files read, where their
tasks run, so the tree has to be visible to the executors.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gneiss.plans.lineage import cut

SCHEMA = "path string, size long, head binary, content string"
HEAD = 4096


class Part(InputPartition):
    """Some files, or a folder with all that is under it."""

    def __init__(self, paths: list[str], folder: str | None = None):
        super().__init__(None)
        self.paths, self.folder = paths, folder


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.most = int(options.get("partitionfiles", 2_000))
        self.spread = int(options.get("spread", 256))
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """The driver lists folders from the top until there are ``spread`` of them; what is under those is walked where their tasks run."""
        folders, files, listed = [""], [], 0
        while folders and len(folders) < self.spread and listed < self.spread:
            here = folders.pop(0)
            listed += 1
            for e in sorted(os.scandir(Path(self.root, here)), key=lambda e: e.name):
                path = f"{here}/{e.name}" if here else e.name
                if e.is_dir(follow_symlinks=False):
                    if e.name != ".git":
                        folders.append(path)
                elif e.is_file():
                    files.append(path)
        return [Part(files[i : i + self.most]) for i in range(0, len(files), self.most)] + [Part([], f) for f in folders] or [Part([])]

    def under(self, part: Part) -> Iterator[str]:
        yield from part.paths
        if part.folder is not None:
            for folder, names, files in os.walk(Path(self.root, part.folder)):
                names[:] = sorted(n for n in names if n != ".git")
                for f in sorted(files):
                    at = Path(folder, f)
                    if at.is_file():
                        yield at.relative_to(self.root).as_posix()

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in self.under(partition):
            at = Path(self.root, path)
            try:
                data = at.read_bytes() if self.content else at.open("rb").read(HEAD)
                size = at.stat().st_size
            except OSError:
                continue
            text = None
            if self.content:
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    text = None
            yield path, size, data[:HEAD], text


def read_tree(spark, root: str, content: bool = True):
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("content", str(content)).load(root)


def listing(spark, root: str):
    """path, size, changed (the time of its last change, in nanoseconds) of a tree's files: nothing is read."""
    spark.dataSource.register(TreeListing)
    return spark.read.format("source_tree_listing").load(root)


class TreeListing(SourceTree):
    @classmethod
    def name(cls) -> str:
        return "source_tree_listing"

    def schema(self) -> str:
        return "path string, size long, changed long"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


class ListingReader(TreeReader):
    def read(self, partition: Part) -> Iterator[tuple]:
        for path in self.under(partition):
            try:
                told = Path(self.root, path).stat()
            except OSError:
                continue
            yield path, told.st_size, told.st_mtime_ns


def read_files(paths, root: str):
    """paths(path) -> path, content (null if it is gone or no UTF-8), hash (of the bytes): read where the rows are."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    data = Path(root, path).read_bytes()
                except OSError:
                    rows.append((path, None, None))
                    continue
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    text = None
                rows.append((path, text, hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "content", "hash"])

    return paths.select("path").mapInPandas(run, "path string, content string, hash string")


def changed_since(spark, root: str, before):
    """A tree against an older state of it, before(path, size, changed, hash): path, size, changed, hash, content, change, was.

    ``change``: same (size and time hold, or else the hash), changed, added, renamed (an added file whose bytes a removed one had; ``was`` is that
    one's path), removed. Only files whose size or time differ are read, each where its row is; no other program is asked. Of several that have the same
    bytes the smallest paths are matched, each once. ``content`` is that of files that were read.
    """
    now = listing(spark, root)
    old = before.select("path", F.col("size").alias("old_size"), F.col("changed").alias("old_changed"), F.col("hash").alias("old_hash"))
    met = now.join(old, "path", "full_outer")
    held = (F.col("size") == F.col("old_size")) & (F.col("changed") == F.col("old_changed"))
    told = met.withColumn("held", F.coalesce(held, F.lit(False)))
    looked = read_files(told.where("not held and size is not null"), root)
    full = cut(told.join(looked, "path", "left"))  # files are read once
    nth = Window.partitionBy("hash").orderBy("path")
    added = full.where("old_size is null and hash is not null").select("path", "hash").withColumn("nth", F.row_number().over(nth))
    removed = full.where("size is null and old_hash is not null").select(F.col("path").alias("was"), F.col("old_hash").alias("hash")).withColumn("nth", F.row_number().over(Window.partitionBy("hash").orderBy("was")))
    renamed = added.join(removed, ["hash", "nth"]).select("path", "was")
    out = full.join(renamed, "path", "left").join(renamed.select(F.col("was").alias("path"), F.lit(True).alias("moved")), "path", "left")
    same = F.col("held") | (F.col("hash") == F.col("old_hash"))
    change = F.when(F.col("size").isNull(), "removed").when(F.col("old_size").isNull(), F.when(F.col("was").isNotNull(), "renamed").otherwise("added")).when(same, "same").otherwise("changed")
    kept = out.where("moved is null")  # a renamed file is one row, under its new path
    return kept.select("path", "size", "changed", F.coalesce("hash", "old_hash").alias("hash"), "content", change.alias("change"), F.coalesce("was", F.lit("")).alias("was"))
