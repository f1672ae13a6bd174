"""Checks of what a language model returned, and the tag vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P
from gneiss.functions import text as T
from gneiss.plans.lineage import cut

TAG = r"^[a-z][a-z0-9-]{0,14}$"
LEAST_MODULES, MOST_MODULES = 8, 15


def parsed(text: Column, schema: str) -> Column:
    """JSON, in a code fence or not; null if it is none."""
    return F.from_json(T.json_without_fence(text), schema, {"mode": "PERMISSIVE"})


def file_outputs(outputs: DataFrame) -> DataFrame:
    """outputs(text) -> with ``fault``: a description and tags are asked for."""
    j = parsed(F.col("text"), "desc string, tags array<string>")
    return outputs.withColumn("fault", F.when(j["desc"].isNull(), "no desc").when(j["tags"].isNull(), "no tags").when(F.exists(j["tags"], lambda t: ~t.rlike(TAG)), "bad tag"))


def module_outputs(outputs: DataFrame) -> DataFrame:
    """outputs(text) -> with ``fault``: eight to fifteen modules, ids with ``mod:``, none twice."""
    j = parsed(F.col("text"), "modules array<struct<id: string, desc: string>>")["modules"]
    ids = F.transform(j, lambda m: m["id"])
    n = F.size(j)
    return outputs.withColumn("fault", F.when(j.isNull(), "no modules").when((n < LEAST_MODULES) | (n > MOST_MODULES), "wrong number").when(F.exists(ids, lambda i: i.isNull() | ~i.startswith("mod:")), "bad id").when(F.size(F.array_distinct(ids)) < n, "id twice"))


def assignment_outputs(outputs: DataFrame) -> DataFrame:
    """outputs(text, expected_count, valid_ids) -> with ``fault``: a known module for each file."""
    j = parsed(F.col("text"), "map<string, string>")
    known = F.size(F.array_except(F.map_values(j), F.col("valid_ids"))) == 0
    return outputs.withColumn("fault", F.when(j.isNull(), "no map").when(F.size(F.map_keys(j)) != F.col("expected_count"), "wrong number").when(~known, "bad id"))


def vocabulary_check(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tags(tag), vocabulary(tag) -> tag, verdict: known, new (well formed) or invalid."""
    known = vocabulary.select("tag").distinct().withColumn("known", F.lit(True))
    verdict = F.when(F.col("known"), "known").when(F.col("tag").rlike(TAG), "new").otherwise("invalid")
    return tags.join(known, "tag", "left").select("tag", verdict.alias("verdict"))


def expanded(vocabulary: DataFrame, tags: DataFrame) -> DataFrame:
    """vocabulary(dimension, tag) with well-formed new tags in dimension ``custom``."""
    new = vocabulary_check(tags.select("tag").distinct(), vocabulary).where("verdict = 'new'").select(F.lit("custom").alias("dimension"), "tag")
    return vocabulary.select("dimension", "tag").unionByName(new)


def members_only(claims: DataFrame, members: DataFrame) -> DataFrame:
    """claims(module, path) that name a file of the module: what a model made up goes."""
    return claims.join(members.select("module", "path"), ["module", "path"], "left_semi")


# Outputs whose checks look things up: items leave their output, meet what is known, and faults come back by output.


def json_kind(text: Column) -> Column:
    """object, array or other of a JSON text, in a fence or not; null if it is none."""
    kind = F.schema_of_variant(F.try_parse_json(T.json_without_fence(text)))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.isNotNull(), "other")


def _with_faults(outputs: DataFrame, first: Column, found: DataFrame) -> DataFrame:
    """outputs(id, ...) with ``faults``: those of ``first`` (an array), then those of found(id, nth, fault), in order."""
    listed = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "fault"))), lambda x: x["fault"]).alias("_found"))
    none = F.array().cast("array<string>")
    return outputs.join(listed, "id", "left").withColumn("faults", F.concat(F.coalesce(first, none), F.coalesce("_found", none))).drop("_found")


def assignment_lists(outputs: DataFrame, modules: DataFrame) -> DataFrame:
    """outputs(id, text, expected_count), modules(module) -> with ``faults``: a list of {path, module_id}, as many as expected, all of known modules."""
    items = parsed(F.col("text"), "array<struct<path: string, module_id: string>>")
    told = outputs.withColumn("_kind", json_kind(F.col("text"))).withColumn("_items", F.when(F.col("_kind") == "array", items))
    each = told.select("id", F.posexplode("_items").alias("nth", "item")).select("id", "nth", F.coalesce("item.module_id", F.lit("")).alias("module"))
    bad = each.join(modules.select("module"), "module", "left_anti").select("id", "nth", F.concat(F.lit("unknown module "), "module").alias("fault"))
    n = F.size("_items")
    first = F.when(F.col("_kind").isNull(), F.array(F.lit("no JSON"))).when(F.col("_kind") != "array", F.array(F.lit("no list"))).when(n != F.col("expected_count"), F.array(F.concat(F.lit("items "), n.cast("string"))))
    return _with_faults(told, first, bad).drop("_kind", "_items")


def description_outputs(outputs: DataFrame, members: DataFrame) -> DataFrame:
    """outputs(id, text, module), members(module, path) -> with ``faults``: a description, and key files that are the module's."""
    j = parsed(F.col("text"), "desc string, key_files array<string>")
    has = F.try_variant_get(F.try_parse_json(T.json_without_fence(F.col("text"))), "$.desc", "variant").isNotNull()
    told = outputs.withColumn("_kind", json_kind(F.col("text"))).withColumn("_has", has).withColumn("_files", F.when(F.col("_kind") == "object", j["key_files"]))
    each = told.select("id", "module", F.posexplode("_files").alias("nth", "path"))
    bad = each.join(members.select("module", "path"), ["module", "path"], "left_anti").select("id", "nth", F.concat(F.lit("unknown file "), F.coalesce("path", F.lit(""))).alias("fault"))
    first = F.when(F.col("_kind").isNull(), F.array(F.lit("no JSON"))).when(F.col("_kind") != "object", F.array(F.lit("no object"))).when(~F.col("_has"), F.array(F.lit("no desc")))
    return _with_faults(told, first, bad).drop("_kind", "_has", "_files")


def project_outputs(outputs: DataFrame) -> DataFrame:
    """outputs(text) -> with ``faults``: overview, architecture and scale are asked for."""
    v = F.try_parse_json(T.json_without_fence(F.col("text")))
    kind = json_kind(F.col("text"))
    missing = F.filter(F.array(*[F.when(F.try_variant_get(v, f"$.{f}", "variant").isNull(), F.lit(f"no {f}")) for f in ("overview", "architecture", "scale")]), lambda x: x.isNotNull())
    return outputs.withColumn("faults", F.when(kind.isNull(), F.array(F.lit("no JSON"))).when(kind != "object", F.array(F.lit("no object"))).otherwise(missing))


BRIEF = "summary string, reading_order array<struct<path: string, why: string>>, architecture_axes array<string>, risk_hotspots array<struct<path: string, risk: string, reason: string>>"


def known_places(files: DataFrame) -> DataFrame:
    """files(path) -> place: every path and every directory above one, without a slash at the end."""
    p = P.parts(F.col("path"))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.array_join(F.slice(p, 1, i), "/"))
    dirs = files.where(F.size(p) > 1).select(F.explode(above).alias("place"))
    return files.select(F.col("path").alias("place")).unionByName(dirs).distinct()


def _said(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _brief_items(outputs: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """outputs(id, text) parsed, and the items of their reading orders and hotspots with ``known``: null if a path names no place."""
    told = outputs.withColumn("brief", F.when(json_kind(F.col("text")) == "object", parsed(F.col("text"), BRIEF)))
    known = places.withColumn("known", F.lit(True))

    def met(items: DataFrame) -> DataFrame:
        return items.withColumn("place", F.regexp_replace("path", "/+$", "")).join(known, "place", "left")

    reading = told.select("id", F.posexplode("brief.reading_order").alias("nth", "item")).select("id", "nth", _said(F.col("item.path")).alias("path"), _said(F.col("item.why")).alias("why"))
    spots = told.select("id", F.posexplode("brief.risk_hotspots").alias("nth", "item")).select("id", "nth", *[_said(F.col(f"item.{c}")).alias(c) for c in ("path", "risk", "reason")])
    return told, met(reading), met(spots)


def brief_faults(outputs: DataFrame, places: DataFrame) -> DataFrame:
    """outputs(id, text), places(place) -> with ``faults`` of a navigation brief: a summary, paths that exist with reasons, axes that say something, risks with reasons."""
    told, reading, spots = _brief_items(outputs, places)

    def faults(items: DataFrame, part: str, order: int, tests: list[tuple[Column, str]]) -> DataFrame:
        said = F.filter(F.array(*[F.when(t, F.lit(w)) for t, w in tests]), lambda x: x.isNotNull())
        each = items.select("id", "nth", F.posexplode(said).alias("k", "w"))
        return each.select("id", F.struct(F.lit(order).alias("part"), "nth", "k").alias("nth"), F.concat(F.lit(f"{part}["), F.col("nth").cast("string"), F.lit("] "), "w").alias("fault"))

    axes = told.select("id", F.posexplode("brief.architecture_axes").alias("nth", "axis"))
    unknown = F.col("known").isNull()
    found = (
        faults(reading, "reading_order", 0, [(F.col("path") == "", "no path"), ((F.col("path") != "") & unknown, "unknown path"), (F.col("why") == "", "no why")])
        .unionByName(faults(axes, "architecture_axes", 1, [(_said(F.col("axis")) == "", "empty")]))
        .unionByName(faults(spots, "risk_hotspots", 2, [((F.col("path") != "") & unknown, "unknown path"), (F.col("risk") == "", "no risk"), (F.col("reason") == "", "no reason")]))
    )
    b = F.col("brief")
    tests = [(_said(b["summary"]) == "", "no summary"), (b["reading_order"].isNull(), "no reading_order"), (b["architecture_axes"].isNull(), "no architecture_axes"), (b["risk_hotspots"].isNull(), "no risk_hotspots")]
    first = F.when(b.isNull(), F.array(F.lit("no object"))).otherwise(F.filter(F.array(*[F.when(t, F.lit(w)) for t, w in tests]), lambda x: x.isNotNull()))
    return _with_faults(told, first, found).drop("brief")


def brief_kept(outputs: DataFrame, places: DataFrame, reading_cap: int = 6, axes_cap: int = 5, spots_cap: int = 4) -> DataFrame:
    """outputs(id, text), places(place) -> id, part, nth, path, said: what of a brief is sound, each part up to its cap, a place once."""
    told, reading, spots = _brief_items(outputs, places)
    good = reading.where("path <> '' and why <> '' and known")
    once = good.withColumn("again", F.row_number().over(Window.partitionBy("id", "place").orderBy("nth"))).where("again = 1")
    axes = told.select("id", F.posexplode("brief.architecture_axes").alias("nth", "axis")).where(_said(F.col("axis")) != "")
    risky = spots.where("risk <> '' and reason <> '' and (path = '' or known)")

    def first(items: DataFrame, part: str, cap: int, path: Column, said: Column) -> DataFrame:
        placed = items.withColumn("place_in", F.row_number().over(Window.partitionBy("id").orderBy("nth"))).where(F.col("place_in") <= cap)
        return placed.select("id", F.lit(part).alias("part"), F.col("place_in").alias("nth"), path.alias("path"), said.alias("said"))

    return (
        first(once, "reading_order", reading_cap, F.col("path"), F.col("why"))
        .unionByName(first(axes, "architecture_axes", axes_cap, F.lit(""), _said(F.col("axis"))))
        .unionByName(first(risky, "risk_hotspots", spots_cap, F.col("path"), F.concat_ws(": ", "risk", "reason")))
    )


def repaired(inputs: DataFrame, call: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """inputs(id, ...) through ``call`` until ``check`` finds no fault: accepted(id, text, attempt) and left(id, text, faults, attempt).

    ``call`` gets the inputs that are still open, with ``was`` and ``faults`` of the last attempt (null at first), and returns id, text;
    ``check`` gets id, text and gives them back with ``faults``, an array. Inputs without an output have the fault ``no output``. Each attempt is kept, so
    no caller's function runs twice for one; rows that are accepted are never sent again. What is left after the last attempt is set aside with its faults.
    """
    open_, accepted, tried = inputs.withColumn("was", F.lit(None).cast("string")).withColumn("faults", F.lit(None).cast("array<string>")), None, None
    for attempt in range(1, attempts + 1):
        told = check(call(open_).select("id", "text")).select("id", "text", "faults")
        tried = cut(open_.select("id").join(told, "id", "left").withColumn("faults", F.coalesce("faults", F.array(F.lit("no output")))).withColumn("attempt", F.lit(attempt)))
        good = tried.where(F.size("faults") == 0).select("id", "text", "attempt")
        accepted = good if accepted is None else accepted.unionByName(good)
        bad = tried.where(F.size("faults") > 0)
        open_ = inputs.join(bad.select("id", F.col("text").alias("was"), "faults"), "id")
    return accepted, tried.where(F.size("faults") > 0)
