"""What a text mentions, and the memory of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P
from gneiss.functions import text as T

# Words that are no identifiers.
STOP_WORDS = (
    "the a an in on at to for of with by from is are was were be been being have has had do does did will would should "
    "can could may might must this that these those fix bug add update remove delete create implement"
).split()
WINDOW, DECAY, FORGET, ACTIVE = 10, 0.8, 0.01, 0.1


def identifiers(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """texts(id, text), symbols(name) -> id, ident: known symbols in any case, and words that look like identifiers."""
    words = texts.select("id", F.explode(F.array_distinct(T.identifier_candidates(F.col("text")))).alias("ident"))
    names = symbols.select(F.lower("name").alias("low")).distinct().withColumn("known", F.lit(True))
    met = words.withColumn("low", F.lower("ident")).join(names, "low", "left")
    noise = F.col("low").isin(STOP_WORDS) | (F.length("ident") < 3)
    looks = F.col("ident").rlike("^[A-Z]") | (F.length("ident") > 5)
    return met.where(F.coalesce("known", F.lit(False)) | (~noise & looks)).select("id", "ident")


def stems(texts: DataFrame, files: DataFrame) -> DataFrame:
    """texts(id, text), files(path) -> id, path of files whose stem is a word of the text. Words meet stems by an equi join."""
    words = texts.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"(?U)\W+"))).alias("stem")).where("stem <> ''")
    return words.join(files.select("path", F.lower(P.stem(F.col("path"))).alias("stem")), "stem").select("id", "path")


def file_mentions(texts: DataFrame, files: DataFrame) -> DataFrame:
    """texts(id, text), files(path) -> id, path: full paths, and base names that one file alone has."""
    words = texts.select("id", F.explode(T.path_words(F.col("text"))).alias("word"))
    full = words.withColumn("path", F.replace("word", F.lit("\\"), F.lit("/"))).join(files.select("path"), "path").select("id", "path")
    base = files.select("path", P.name(F.col("path")).alias("word")).where(F.contains("path", F.lit("/")) | F.col("word").rlike(r"[._-]"))
    once = base.groupBy("word").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("word", "path")
    return full.unionByName(words.join(once, "word").select("id", "path")).distinct()


def memory(mentions: DataFrame, turns: DataFrame) -> DataFrame:
    """mentions(conv_id, turn, path), turns(conv_id, turn) -> conv_id, path, weight after the last turn.

    Weights begin at 1, fade by ``DECAY`` a turn and are forgotten under ``FORGET``: in closed form, by
    how many turns came after the last mention. Two partial aggregations and a join, no fold.
    """
    numbered = turns.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).alias("n"))
    last = numbered.groupBy("conv_id").agg(F.max("n").alias("now"))
    said = mentions.join(numbered, ["conv_id", "turn"]).groupBy("conv_id", "path").agg(F.max("n").alias("at"))
    aged = said.join(last, "conv_id").withColumn("weight", F.pow(F.lit(DECAY), F.col("now") - F.col("at")))
    return aged.where(F.col("weight") >= FORGET).select("conv_id", "path", F.round("weight", 6).alias("weight"))


def active(memories: DataFrame, least: float = ACTIVE) -> DataFrame:
    return memories.where(F.col("weight") >= least).select("conv_id", "path")


def context_text(turns: DataFrame, most: int = WINDOW) -> DataFrame:
    """turns(conv_id, turn, text) -> conv_id, text of the last ``most`` messages. Ranked before they are collected, so lists are bounded."""
    late = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("back", F.row_number().over(late)).where(F.col("back") <= most)
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), "\n").alias("text"))
