"""Index documents: one JSON object with files as a map, read with a stated schema into tables and written back.

Inference would make a struct field of every path, so the schema says ``map``. Each table has ``ord``, the
document's order.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = "struct<name: string, kind: string, line: int, parent: string, desc: string>"
SCHEMA = f"""version int, generated_at string,
project struct<overview: string, architecture: string, scale: struct<files: int, modules: int, primary_lang: string>>,
modules array<struct<id: string, desc: string, file_count: int, core_score: double, tier: string, role: string, key_files: array<string>>>,
files map<string, struct<id: string, type: string, name: string, lang: string, desc: string, tags: array<string>, module: string, signatures: array<{SIGNATURE}>>>,
stats struct<total_files: int, total_modules: int, total_signatures: int>,
module_dependencies map<string, array<struct<target: string, weight: long>>>,
file_dependencies map<string, array<string>>,
function_dependencies map<string, array<struct<target: string, weight: long, lines: array<int>>>>,
_snapshot struct<snapshot_id: string, snapshot_created_at: string, message: string>,
_corrupt_record string"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """Index documents at a path or glob, with ``file_name``; broken ones have ``_corrupt_record`` alone."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("file_name", F.col("_metadata.file_name"))


def sound(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("_corrupt_record").isNull() & F.col("files").isNotNull())


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """files, signatures, modules, module_deps, file_deps, function_deps, project, each with the document's snapshot_id."""
    d = sound(documents).withColumn("snapshot_id", F.coalesce(F.col("_snapshot.snapshot_id"), F.lit("current")))
    files = d.select("snapshot_id", F.posexplode("files").alias("ord", "path", "f")).select(
        "snapshot_id", "ord", "path", F.coalesce("f.name", F.substring_index("path", "/", -1)).alias("name"), F.coalesce("f.lang", F.lit("unknown")).alias("lang"),
        F.coalesce("f.desc", F.lit("")).alias("desc"), F.coalesce("f.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("f.module", F.lit("")).alias("module"),
        F.coalesce("f.signatures", F.array().cast(f"array<{SIGNATURE}>")).alias("signatures"),
    )
    signatures = files.select("snapshot_id", "path", F.posexplode("signatures").alias("ord", "s")).select("snapshot_id", "path", "ord", "s.*")
    modules = d.select("snapshot_id", F.posexplode("modules").alias("ord", "m")).select("snapshot_id", "ord", F.col("m.id").alias("module"), F.col("m.desc").alias("desc"), "m.file_count", "m.core_score", "m.tier", "m.role")
    module_deps = d.select("snapshot_id", F.explode("module_dependencies").alias("src", "t")).select("snapshot_id", "src", F.explode("t").alias("t")).select("snapshot_id", "src", F.col("t.target").alias("dst"), "t.weight")
    file_deps = d.select("snapshot_id", F.explode("file_dependencies").alias("src", "t")).select("snapshot_id", "src", F.explode("t").alias("dst"))
    function_deps = d.select("snapshot_id", F.explode("function_dependencies").alias("caller", "t")).select("snapshot_id", "caller", F.explode("t").alias("t")).select("snapshot_id", "caller", F.col("t.target").alias("callee"), "t.weight", "t.lines")
    return {"files": files.withColumn("n_sigs", F.size("signatures")), "signatures": signatures, "modules": modules, "module_deps": module_deps, "file_deps": file_deps, "function_deps": function_deps, "project": d.select("snapshot_id", "generated_at", "project.*")}


def document(files: DataFrame, modules: DataFrame, signatures: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Rows of a merged index: files with their signatures by position, descriptions of files where known, module '' and language unknown where not."""
    sig = F.struct("ord", "name", "kind", "line")
    listed = signatures.groupBy("path").agg(F.array_sort(F.collect_list(sig)).alias("signatures"))
    out = files.join(listed, "path", "left")
    if descriptions is not None:
        out = out.join(descriptions.select("path", F.col("desc").alias("_desc")), "path", "left").withColumn("desc", F.coalesce("_desc", "desc")).drop("_desc")
    return out.join(modules.select("module", "tier"), "module", "left").withColumn("lang", F.coalesce("lang", F.lit("unknown"))).withColumn("module", F.coalesce("module", F.lit("")))


def write(documents: DataFrame, path: str) -> None:
    """JSON lines, one document a line."""
    documents.select(F.to_json(F.struct(*documents.columns)).alias("value")).write.mode("overwrite").text(path)


def pretty(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
