"""Caches of computed stages: keyed rows in partitions, and a manifest that says which files of each partition hold.

    store = CacheStore(spark, "/shared/cache")
    store.commit({"module": rows})         # rows(key, hash, ...): only partitions that they touch are written
    store.load("module"); store.drop("module", keys); store.clear()

A key's partition is a checksum of it. A commit writes new folders first and the manifest last, under a name that
is taken once; readers follow the newest manifest. A commit that fails anywhere leaves the old manifest, and with it
the old cache, whole. Folders that no manifest names are removed by the next commit that succeeds.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


class CacheStore:
    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def part(self, key: str = "key") -> Column:
        return F.crc32(F.col(key).cast("string")) % self.parts

    # The manifest: {"run": n, "stages": {stage: {part: folder}}}

    def _runs(self) -> list[int]:
        at = self._path(f"{self.folder}/_manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        runs = self._runs()
        if not runs:
            return {"run": 0, "stages": {}}
        text = self.spark.read.option("wholetext", "true").text(f"{self.folder}/_manifests/{runs[-1]:09d}.json").first()["value"]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        """Written aside, then renamed to the next number; two runs can't both have it."""
        draft = self._path(f"{self.folder}/_drafts/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        at = self._path(f"{self.folder}/_manifests/{manifest['run']:09d}.json")
        self._fs.mkdirs(at.getParent())
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            raise RuntimeError(f"another run has committed {at.toString()}")

    # Rows

    def load(self, stage: str) -> DataFrame | None:
        """The stage's rows, or None where nothing is cached."""
        held = self.manifest()["stages"].get(stage, {})
        if not held:
            return None
        return self.spark.read.parquet(*sorted(f"{self.folder}/{f}" for f in held.values()))

    def commit(self, tables: dict[str, DataFrame], drop: dict[str, DataFrame] | None = None) -> int:
        """Put rows(key, ...) in place of those of the same keys, take out the keys of ``drop``; all stages in one step. The new run's number.

        A partition that nothing touches keeps its files. Within a touched one old rows stay but for the keys at hand.
        """
        drop = drop or {}
        old = self.manifest()
        new = {"run": old["run"] + 1, "stages": {s: dict(p) for s, p in old["stages"].items()}}
        for stage in {*tables, *drop}:
            before = self.load(stage)
            rows, gone = tables.get(stage), drop.get(stage)
            keys = [d.select(F.col("key").cast("string").alias("key")) for d in (rows, gone) if d is not None]
            touched = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
            kept = None
            if before is not None:
                # of the touched partitions, the rows whose key isn't at hand: at most ``parts`` numbers are sent
                where = F.broadcast(touched.select(self.part().alias("part")).distinct())
                kept = before.withColumn("part", self.part()).join(where, "part", "left_semi").join(touched.distinct(), "key", "left_anti")
            written = rows.withColumn("part", self.part()) if rows is not None else None
            both = kept if written is None else written if kept is None else written.unionByName(kept.select(*written.columns))
            held = new["stages"].setdefault(stage, {})
            for p in touched.select(self.part().alias("part")).distinct().collect():
                held.pop(str(p["part"]), None)
            if both is not None:
                run = f"{stage}/{new['run']:09d}-{uuid.uuid4().hex}"
                both.repartition("part").write.partitionBy("part").parquet(f"{self.folder}/{run}")
                for status in self._fs.listStatus(self._path(f"{self.folder}/{run}")):
                    name = status.getPath().getName()
                    if name.startswith("part="):
                        held[name[5:]] = f"{run}/{name}"
        self._publish(new)
        self._sweep(new)
        return new["run"]

    def _sweep(self, manifest: dict) -> None:
        """Remove runs that neither the manifest nor the one before names: a reader of that one may still be at work."""
        runs = self._runs()
        named = {f.rsplit("/", 1)[0] for p in manifest["stages"].values() for f in p.values()}
        if len(runs) > 1:
            text = self.spark.read.option("wholetext", "true").text(f"{self.folder}/_manifests/{runs[-2]:09d}.json").first()["value"]
            named |= {f.rsplit("/", 1)[0] for p in json.loads(text)["stages"].values() for f in p.values()}
        for status in self._fs.listStatus(self._path(self.folder)):
            stage = status.getPath().getName()
            if status.isDirectory() and not stage.startswith("_"):
                for run in self._fs.listStatus(status.getPath()):
                    if f"{stage}/{run.getPath().getName()}" not in named:
                        self._fs.delete(run.getPath(), True)
        for n in runs[:-2]:
            self._fs.delete(self._path(f"{self.folder}/_manifests/{n:09d}.json"), False)

    def clear(self) -> None:
        """A full refresh: everything that is cached goes."""
        self._fs.delete(self._path(self.folder), True)
