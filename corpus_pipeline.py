"""Documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it again for the next. All but the last return the columns of documents; other
columns, whatever their names, pass through the first four and are left out by the last.

All stages: null text counts as empty; an empty table gives an empty table; what they decide depends on
the rows alone, not on their order or partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm import bpe, mixing, simhash, substrings, toxicity
from gneiss.llm.common import WORD, forget, shared_folder, table
from gneiss.llm.queries import tokenizer_path


def unused(columns: list[str], name: str) -> str:
    """``name`` with so many underscores that no column begins with it."""
    while any(c.lower().startswith(name) for c in columns):
        name += "_"
    return name


def whole(docs: DataFrame) -> Column:
    """A row as one value, ``row``: names inside it meet no other names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def rewritten(docs: DataFrame, text: Column, n_chars: Column) -> list[Column]:
    """The columns of ``row``, with another text and number of characters."""
    new = {"text": text, "n_chars": n_chars}
    return [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't call toxic.

    Each row is judged by its text alone: repeated rows share a fate, null ids are scored like others, and
    without labels of both kinds nothing goes but what all labels call toxic.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = unused(docs.columns, "toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of their five-word shingles or more alike): that with the smallest doc_id.

    Null ids count as larger than all others. Of several texts under the smallest id that with the smaller
    hash stays; of rows that repeat an id and a text one, the first by source and lang, stays.
    """
    groups = simhash.group_alike(docs)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("said").alias("text"))).alias("first")).select("first.id", "first.text")
    told = docs.select(whole(docs), "doc_id", F.xxhash64("text").alias("said"), "source", "lang")
    stay = told.join(first, told["doc_id"].eqNullSafe(first["id"]) & (told["said"] == first["text"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "said").orderBy("source", "lang"))
    return stay.withColumn("nth", nth).where("nth = 1").select("row.*")


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a document with a smaller id says too, 13 and more in a row. Untouched texts stay as they are.

    Rows that share an id aren't repeats of each other; null ids count as larger than all others; a null text stays null.
    """
    prefix = unused(docs.columns, "dedup_")
    done = substrings.remove_repeats(docs, keep=docs.columns, prefix=prefix)
    cut, kept = F.col(prefix + "n_removed") > 0, F.col(prefix + "kept")
    new = {"text": F.when(cut, kept).otherwise(F.col("text")), "n_chars": F.when(cut, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is there as often as it is taken, three times at the most; one taken in part gives its first words.

    Documents without words, null texts among them, aren't in a mix. Rows that repeat an id and a source are
    documents of their own, told apart by size and text; rows without an id are named by their text.
    """
    named = docs.select(whole(docs), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string"))).alias("doc_id"), "source", "text")
    order = Window.partitionBy("doc_id", "source")
    taken = mixing.mix_sources(named).where("taken > 0").withColumn("nth", F.row_number().over(order.orderBy("size", "taken")))
    taken = taken.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("nth").alias("n"), "size", "taken")
    counted = named.withColumn("words", mixing.word_count(F.col("text"))).where("words > 0")
    numbered = counted.withColumn("nth", F.row_number().over(order.orderBy("words", "text")))
    same = (F.col("doc_id") == F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("nth") == F.col("n"))
    copies = numbered.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")), " ")
    told = copies.select("row", (words == F.col("size")).alias("all"), F.when(words < F.col("size"), part).alias("part"))
    text = F.when(F.col("all"), F.col("row")["text"]).otherwise(F.col("part"))
    return told.select(*rewritten(docs, text, F.when(F.col("all"), F.col("row")["n_chars"]).otherwise(F.length("part").cast("long"))))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of them and of the text they decode to, a row a document of the mix: doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256."""
    return bpe.encode_docs(docs, tokenizer_path(spark), keep=["doc_id", "lang", "source"], results=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_copies_out),
    ("substring_dedup", repeats_out),
    ("mix_sources", mixed),
    ("bpe", encoded),
]

#: The classifier and XXH64 have no DuckDB form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        now = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if before:
            forget(spark, before)  # all that comes reads the newer one
        before = now
    return docs
