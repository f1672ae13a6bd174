"""Snapshots: every table of an index under a partition column, and references to them in time."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_id(spark: SparkSession) -> str:
    """A sortable id of the present moment in UTC."""
    return spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), spark.conf.get("spark.sql.session.timeZone")), "yyyyMMdd'T'HHmmss_SSSSSS'Z'")).first()[0]


def save(spark: SparkSession, tables: dict[str, DataFrame], archive: str, message: str = "", snapshot_id: str | None = None) -> str:
    """Append tables to the archive; the list of snapshots is written last, so a snapshot is listed once it is whole."""
    snapshot_id = snapshot_id or new_id(spark)
    for name, df in tables.items():
        df.drop("snapshot_id").withColumn("snapshot_id", F.lit(snapshot_id)).write.partitionBy("snapshot_id").mode("append").parquet(f"{archive}/{name}")
    told = spark.range(1).select(F.lit(snapshot_id).alias("id"), F.current_timestamp().alias("created_at"), F.lit(message).alias("message"))
    told.write.mode("append").parquet(f"{archive}/snapshots")
    return snapshot_id


def references(ids: DataFrame) -> DataFrame:
    """ids(id, ...) with ``back``, how many are later, and ``ref``: latest, latest~1 and so on. A window over snapshots alone."""
    back = F.row_number().over(Window.orderBy(F.desc("id"))) - 1
    return ids.withColumn("back", back).withColumn("ref", F.when(F.col("back") == 0, "latest").otherwise(F.concat(F.lit("latest~"), F.col("back").cast("string"))))


def listed(spark: SparkSession, archive: str) -> DataFrame:
    """id, created_at, message, latest first, with ``back`` and ``ref``. A damaged part of the list is left out; ``damaged`` names it."""
    return references(_sound(spark, f"{archive}/snapshots")).orderBy("back")


def _sound(spark: SparkSession, folder: str) -> DataFrame:
    """What can be read of a folder of Parquet files: broken files are passed over by the readers, where tasks run."""
    return spark.read.option("ignoreCorruptFiles", "true").option("partitionColumnTypeInference", "false").schema(_schema(spark, folder)).parquet(folder)


def _schema(spark: SparkSession, folder: str) -> T.StructType:
    """The columns of the first file whose footer can be read."""
    for path in _files(spark, folder):
        try:
            return spark.read.option("basePath", folder).option("partitionColumnTypeInference", "false").parquet(path).schema
        except AnalysisException:
            continue
        except Exception as e:  # a footer that can't be read
            if "parquet" not in str(e).lower():
                raise
    raise LookupError(f"nothing can be read in {folder}")


def _files(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise LookupError(f"no archive at {folder}")
    found, walk = [], fs.listFiles(at, True)
    while walk.hasNext():
        path = walk.next().getPath()
        if path.getName().endswith(".parquet"):
            found.append(path.toString())
    return sorted(found)


def damaged(spark: SparkSession, archive: str, table: str = "snapshots") -> DataFrame:
    """path, reason of the table's files that can't be read. Their heads and ends are looked at where tasks run."""
    files = _files(spark, f"{archive}/{table}")
    raw = spark.read.format("binaryFile").load(files) if files else spark.createDataFrame([], "path string, length long, content binary")
    head, tail = F.substring("content", 1, 4), F.substring(F.col("content"), -4, 4)
    reason = F.when(F.col("length") < 12, "too short").when(head != F.lit(b"PAR1"), "no head").when(tail != F.lit(b"PAR1"), "cut off")
    return raw.select("path", reason.alias("reason")).where("reason is not null")


def documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots kept as JSON files, one document each: sound(path, snapshot_id, created_at, document) by id ascending, and broken(path, reason).

    A file that is no JSON object is set aside with its name; the rest goes on. An id that a document lacks is its file's name.
    """
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.json").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    v = F.try_parse_json("document")
    told = text.withColumn("_v", v).withColumn("_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.json$", "")
    at = lambda name: F.try_variant_get("_v", f"$._snapshot.{name}", "string")
    sound = told.where("_object").select("path", F.coalesce(at("snapshot_id"), stem).alias("snapshot_id"), F.coalesce(at("snapshot_created_at"), F.lit("")).alias("created_at"), "document")
    broken = told.where("not _object").select("path", F.when(F.col("_v").isNull(), "no JSON").otherwise("no object").alias("reason"))
    return sound.orderBy("snapshot_id"), broken


def resolve(spark: SparkSession, archive: str, reference: str) -> str:
    """The id of ``latest`` (``latest~0``), ``latest~N`` or an exact id."""
    known = listed(spark, archive)
    m = re.fullmatch(r"latest(?:~(\d+))?", reference)
    found = known.where((F.col("back") == int(m[1] or 0)) if m else (F.col("id") == reference)).select("id").take(1)
    if not found:
        raise LookupError(f"no snapshot {reference}")
    return found[0]["id"]


def load(spark: SparkSession, archive: str, table: str, reference: str = "latest", current: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table as it was: a read of one partition; or, by the reference ``current``, as it is in the index at hand."""
    if reference == "current":
        if current is None:
            raise LookupError("no index at hand")
        return current[table]
    return _sound(spark, f"{archive}/{table}").where(F.col("snapshot_id") == resolve(spark, archive, reference))
