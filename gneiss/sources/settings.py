"""Ignore rules from TOML, the tag vocabulary from JSON, prompt templates, a bundle's fingerprint, changed files from git: small things the driver reads."""

from __future__ import annotations

import hashlib
import json
import subprocess
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_FILE = ".architecture-rules.toml"
EMPTY = {"paths": (), "globs": (), "extensions": ()}


def _words(value: object) -> tuple[str, ...]:
    return tuple(w.strip() for w in value if isinstance(w, str) and w.strip()) if isinstance(value, list) else ()


def ignore_rules(root: str, section: str = "gneiss") -> dict[str, tuple[str, ...]]:
    """paths, globs and extensions of [shared] and [section]; no rules where the file is missing or broken."""
    try:
        told = tomllib.loads(Path(root, RULES_FILE).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return dict(EMPTY)
    parts = [told.get(s, {}) for s in ("shared", section)]
    out = {k: tuple(dict.fromkeys(w for p in parts if isinstance(p, dict) for w in _words(p.get(f"ignore_{k}")))) for k in EMPTY}
    out["paths"] = tuple(p.removeprefix("./").rstrip("/") for p in out["paths"])
    out["extensions"] = tuple(e.lower() if e.startswith(".") else f".{e.lower()}" for e in out["extensions"])
    return out


#: What tags say, by dimension, where no vocabulary is given.
VOCABULARY = {"role": ["entrypoint", "lib", "test", "config", "util", "docs"], "domain": ["api", "db", "ui", "auth", "data"], "pattern": ["adapter", "factory", "service", "model"], "tech": ["python", "javascript", "go", "sql"]}


def vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """dimension, tag, ord."""
    known = VOCABULARY
    if path and Path(path).is_file():
        known = json.loads(Path(path).read_text(encoding="utf-8"))
    return spark.createDataFrame([(d, t, i) for d, tags in known.items() for i, t in enumerate(tags)], "dimension string, tag string, ord int")


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    out: dict[str, list[str]] = {}
    for r in vocabulary.select("dimension", "tag").distinct().orderBy("dimension", "tag").toLocalIterator():
        out.setdefault(r["dimension"], []).append(r["tag"])
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")


def template(name: str, folders: list[str]) -> str:
    """The first ``name``.md in a chain of folders."""
    for f in folders:
        if Path(f, f"{name}.md").is_file():
            return Path(f, f"{name}.md").read_text(encoding="utf-8")
    raise LookupError(f"no template {name}")


def fingerprint(files: list[str]) -> str:
    """One digest of names and bytes of the files that are there; empty if none is."""
    h, n = hashlib.sha256(), 0
    for f in files:
        if Path(f).is_file():
            h.update(Path(f).name.encode() + b"\0" + Path(f).read_bytes() + b"\0")
            n += 1
    return h.hexdigest() if n else ""


def bundle_counts(documents: DataFrame) -> DataFrame:
    """documents(name, document), JSON texts of a bundle's parts -> name, n: how many files each lists; none where it is no object or lists none."""
    files = F.try_variant_get(F.try_parse_json("document"), "$.files", "variant")
    keys = F.json_object_keys(F.when(F.schema_of_variant(files).startswith("OBJECT"), F.to_json(files)))
    return documents.select("name", F.coalesce(F.size(keys), F.lit(0)).alias("n"))


def changed_files(spark: SparkSession, root: str) -> DataFrame | None:
    """path of files that differ from the last commit; None without git."""
    try:
        got = subprocess.run(["git", "-C", root, "diff", "--name-only", "HEAD"], capture_output=True, text=True, timeout=60, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return spark.createDataFrame([(p,) for p in got.stdout.splitlines() if p], "path string")


Enricher = Callable[[pd.DataFrame], pd.DataFrame]


def first_comment(rows: pd.DataFrame) -> pd.DataFrame:
    """The enricher that is always there: a file's first line of prose."""
    def said(content: str | None) -> str:
        for line in (content or "").splitlines()[:40]:
            bare = line.strip().strip("#/*\"' -")
            if line.strip()[:1] in "#/*\"'" and len(bare) > 3 and not line.startswith("#!"):
                return bare[:200]
        return ""

    return pd.DataFrame({"path": rows["path"], "desc": [said(c) for c in rows["content"]]})


def enrich(contents: DataFrame, enricher: Enricher = first_comment, schema: str = "path string, desc string", at_once: int | None = None) -> DataFrame:
    """contents(path, content) through an enricher, batch by batch. ``at_once`` bounds how many run side by side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield enricher(b)

    rows = contents.select("path", "content")
    return (rows.repartition(at_once) if at_once else rows).mapInPandas(run, schema)
