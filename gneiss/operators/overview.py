"""Reports in layers: what a project is, its modules, its files; more detail as the budget allows.

Lines are columns; how many fit is a running sum. Only lines that fit go to the driver, so what is
collected is bounded by the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import budget as B
from gneiss.operators import search as S


def tokens_of(text: str) -> int:
    return max(1, len(text) // T.CHARS_PER_TOKEN)


def project_text(project: dict) -> str:
    scale = project.get("scale") or {}
    lines = ["# Project Overview", ""]
    lines += [project["overview"], ""] if project.get("overview") else []
    lines += ["## Architecture", "", project["architecture"], ""] if project.get("architecture") else []
    lines += [f"**Scale**: {scale.get('files', '?')} files, {scale.get('modules', '?')} modules, primary language: {scale.get('primary_lang', '?')}", ""] if scale else []
    return "\n".join(lines)


def module_line() -> Column:
    label = F.when(F.coalesce("tier", F.lit("")) != "", F.concat(F.lit(" ["), "tier", F.lit("]"))).otherwise("")
    return F.concat(F.lit("- **"), "module", F.lit("**"), label, F.lit(" (score="), F.format_string("%.2f", F.coalesce("core_score", F.lit(0.0))), F.lit(", "), F.col("file_count").cast("string"), F.lit(" files): "), F.coalesce("desc", F.lit("")))


def module_lines(modules: DataFrame, budget: int) -> DataFrame:
    """modules(ord, module, desc, tier, core_score, file_count) -> the lines that fit, best module first, and what they use."""
    told = modules.withColumn("line", module_line()).withColumn("cost", T.tokens(F.concat("line", F.lit("\n"))))
    # A line costs one at least, so no more lines than the budget can fit.
    return B.capped(told, [F.desc("core_score"), F.asc("ord")], "cost", budget, budget).select("nth", "module", "line", "cost", "used")


def module_blocks(modules: DataFrame, files: DataFrame, budget: int) -> DataFrame:
    """Blocks of files of core modules, most signatures first, that fit: nth, module, block, used."""
    core = modules.where("tier = 'core'").select("module", "core_score", F.col("ord").alias("place"))
    count = F.when(F.col("n_sigs") > 0, F.concat(F.lit(" ("), F.col("n_sigs").cast("string"), F.lit(" sigs)"))).otherwise("")
    line = F.concat(F.lit("    - `"), "path", F.lit("`"), count, F.lit(": "), F.coalesce("desc", F.lit("")))
    # A block is kept whole or not at all, so lines beyond the budget's tokens can't be part of one.
    order = Window.partitionBy("module").orderBy(F.desc("n_sigs"), "ord")
    own = files.select("module", "n_sigs", "ord", line.alias("line")).join(core, "module").withColumn("nth", F.row_number().over(order)).withColumn("run", F.sum(F.length("line") + 1).over(order))
    room = budget * T.CHARS_PER_TOKEN
    whole = own.groupBy("module", "core_score", "place").agg(F.sum(F.length("line") + 1).alias("chars"), F.array_sort(F.collect_list(F.when(F.col("run") <= room + 1, F.struct("nth", "line")))).alias("lines"))
    block = F.concat(F.lit("  **"), "module", F.lit("** files:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    cost = F.greatest(F.lit(1), F.floor((F.length("module") + 14 + F.col("chars")) / T.CHARS_PER_TOKEN))
    blocks = whole.select("module", "core_score", "place", block.alias("block"), cost.cast("long").alias("cost"))
    return B.capped(blocks, [F.desc("core_score"), F.asc("place")], "cost", budget, budget).select("nth", "module", "block", "cost", "used")


def overview(project: dict, modules: DataFrame, files: DataFrame, budget: int = 4000) -> dict:
    """content and consumed_tokens. The first layer is always there, even over the budget."""
    parts = [project_text(project)]
    used = tokens_of(parts[0])
    lines = module_lines(modules, budget - used).orderBy("nth").collect() if budget > used else []
    if lines:
        parts.append("\n".join(["## Modules", "", *(r["line"] for r in lines), ""]))
        used += lines[-1]["used"]
    blocks = module_blocks(modules, files, budget - used).orderBy("nth").collect() if budget > used else []
    if blocks:
        section = "\n".join(["## Core Module Files", "", *(r["block"] for r in blocks), ""])
        spent = blocks[-1]["used"] + tokens_of("## Core Module Files\n\n")
        if used + spent <= budget:
            parts.append(section)
            used += spent
    return {"content": "\n".join(parts), "consumed_tokens": used}


def target_files(files: DataFrame, target: str) -> DataFrame:
    """Files of a module (``mod:id``, with the mark in the id or not) or under a path."""
    if target.startswith("mod:"):
        return files.where(F.col("module").isin(target, target.removeprefix("mod:")))
    return files.where(F.col("path").startswith(target))


def expand(files: DataFrame, signatures: DataFrame, target: str, level: int = 2, budget: int = 2000) -> dict:
    """Files of a target, with signatures at level 3. Over the budget level 3 falls to 2, and 2 is cut off."""
    own = target_files(files, target)
    room = budget * T.CHARS_PER_TOKEN
    head = F.concat(F.lit("## `"), "path", F.lit("`\n"), F.coalesce("desc", F.lit("")), F.lit("\n"))
    plain = own.select("path", F.lit(-1).alias("ord"), head.alias("line"))
    detail = signatures.join(own.select("path"), "path", "left_semi").select("path", "ord", F.concat(F.lit("- "), "kind", F.lit(" `"), "name", F.lit("` (line "), F.col("line").cast("string"), F.lit(")")).alias("line"))

    def text(rows: DataFrame) -> tuple[str, bool]:
        ran = rows.withColumn("run", F.sum(F.length("line") + 1).over(Window.orderBy("path", "ord").rowsBetween(Window.unboundedPreceding, 0)))
        got = [r["line"] for r in ran.where(F.col("run") - F.length("line") <= room + 1).orderBy("path", "ord").collect()]
        whole = "\n".join(got)
        return whole, len(whole) <= room

    full, fits = text(plain.unionByName(detail)) if level >= 3 else text(plain)
    if not fits and level >= 3:
        short, fits = text(plain)
        full = short if fits else full
    return {"content": full if fits else full[:room], "consumed_tokens": tokens_of(full) if fits else budget}


def search_report(files: DataFrame, tags: list[str] | None, pattern: str | None, signatures: DataFrame | None = None, limit: int = 10) -> str:
    rows = S.search(files, tags, pattern, signatures, limit).collect()
    asked = [f"tags: {', '.join(tags)}"] if tags else []
    asked += [f'pattern: "{pattern}"'] if pattern else []
    lines = ["# Search Results", "", f"Query: {' | '.join(asked)}", f"Matches: {len(rows)}", ""]
    for r in rows:
        lines.append(f"- `{r['path']}` **{r['score']:.2f}**" + (f" ({r['module']})" if r["module"] else "") + (f" [{', '.join(r['tags'])}]" if r["tags"] else "") + f": {r['desc']}")
    return "\n".join([*lines, *(["_No matching files found._"] if not rows else []), ""])


def sections(parts: list[tuple[str, str]], budget: int) -> tuple[str, int]:
    """Named sections in order, each if it still fits: the prompt and the tokens left."""
    out, left = [], budget
    for _, text in parts:
        if text and tokens_of(text) <= left:
            out.append(text)
            left -= tokens_of(text)
    return "\n".join(out), left
