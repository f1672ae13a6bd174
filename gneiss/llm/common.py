"""What the operators of this package share: reading, cutting lineage, words."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word, as a Java or RE2 pattern: anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, by ``spark.checkpoint.dir``.

    Where that is unset a local master gets a temporary folder. On a cluster that is an error: no other folder is known to be shared.
    """
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if not named.isEmpty():
        return named.get()
    at = sc.getConf().get("spark.checkpoint.dir")
    if not at and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the copy, with what made it forgotten."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Give what a task has freed back to the system: Python workers live on from task to task and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def quoted(name: str) -> Column:
    """The column of this very name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def derived(rows: DataFrame, keep: list[str], given: str | Column, added: dict[str, str], make: Callable[[], Callable[[list], list[list]]], at_once: int = 500) -> DataFrame:
    """Columns ``keep`` of ``rows`` as they are, then columns ``added`` (name to type).

    ``make`` is called once a task and gives a function from some values of ``given`` (an expression, or one of
    ``keep``, which isn't sent twice then) to the added columns.
    Kept columns stay in Arrow: pandas would turn a batch's whole numbers into doubles where one of them is
    null. They are known by place, so their names may be any. ``at_once`` rows are made into objects at a time.
    """
    kept = rows.select(*map(quoted, keep)).schema.fields
    kinds = [f.dataType for f in kept] + [T._parse_datatype_string(k) for k in added.values()]
    names = [f"c{i}" for i in range(len(kinds))]
    new = [to_arrow_type(k) for k in kinds[len(kept) :]]
    own = given in keep if isinstance(given, str) else False
    at = keep.index(given) if own else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        for batch in batches:
            for begin in range(0, batch.num_rows, at_once):
                part = batch.slice(begin, at_once)
                columns = made(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array(c, k) for c, k in zip(columns, new, strict=True))], names=names)
        del made
        release()

    chosen = rows.select(*(quoted(c).alias(n) for c, n in zip(keep, names, strict=False)), *([] if own else [(F.col(given) if isinstance(given, str) else given).alias("given")]))
    out = chosen.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    return out.toDF(*(f.name for f in kept), *added)


def word_count(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
