"""python -m gneiss.cli COMMAND ROOT ...: the index of a source tree on the command line."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from gneiss import api
from gneiss.operators.rank import tag_order
from gneiss.sources import snapshots
from gneiss.sources.cache_store import CacheStore


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gneiss", description=__doc__)
    p.add_argument("command", choices=["overview", "expand", "search", "stats", "rules", "rank", "navigate", "tree", "prompt", "context", "snippets", "snapshot", "snapshots", "diff", "map", "tags", "calls", "changed", "clear"])
    p.add_argument("root")
    p.add_argument("words", nargs="*", help="a target, a pattern, focus files or a request, by command")
    p.add_argument("--tags", nargs="*")
    p.add_argument("--tokens", type=int, default=4000)
    p.add_argument("--level", type=int, default=2)
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--archive", default="snapshots")
    p.add_argument("--method", default="graph", choices=["graph", "heuristic", "symbol"])
    p.add_argument("--tier", default="B")
    p.add_argument("--hops", type=int, default=1)
    p.add_argument("--cache", default="cache")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("gneiss").getOrCreate()
    said = " ".join(a.words)
    if a.command == "snapshots":
        for r in snapshots.listed(spark, a.archive).limit(a.limit).collect():
            print(json.dumps(r.asDict(), default=str, ensure_ascii=False))
        return
    if a.command == "clear":
        CacheStore(spark, a.cache).clear()
        return
    if a.command == "changed":
        for r in api.changed(spark, a.root, a.cache).orderBy("path").limit(a.limit).collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
        return
    index = api.build(spark, a.root)
    if a.command == "map":
        print(api.project_map(index, Path(a.root).name, a.tokens))
    elif a.command == "calls":
        for name, df in api.calls(index, said, a.hops).items():
            print(name, json.dumps([r.asDict() for r in df.collect()], ensure_ascii=False))
    elif a.command == "tags":
        for r in api.ranked_tags(index, a.words).orderBy(*tag_order()).limit(a.limit).collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    elif a.command in ("overview", "expand"):
        print((api.overview(index, a.tokens) if a.command == "overview" else api.expand(index, said, a.level, a.tokens))["content"])
    elif a.command in ("prompt", "context"):
        print(api.prompt(index, a.tokens, said) if a.command == "prompt" else api.context(index, a.tier))
    elif a.command == "diff":
        old = {name: snapshots.load(spark, a.archive, name, said or "latest") for name in ("files", "modules")}
        for name, df in api.diff(old, index).items():
            print(name, json.dumps([r.asDict(recursive=True) for r in df.limit(a.limit).collect()], ensure_ascii=False))
    elif a.command == "stats":
        for name, df in api.statistics(index).items():
            print(name, json.dumps([r.asDict() for r in df.limit(a.limit).collect()], ensure_ascii=False))
    elif a.command == "snapshot":
        print(snapshots.save(spark, {k: v for k, v in index.items() if k != "contents"}, a.archive, said))
    else:
        df = {"search": lambda: api.search(index, a.tags, said or None, a.limit), "rules": lambda: api.findings(index), "rank": lambda: api.rank(index, a.words, method=a.method), "snippets": lambda: api.snippets(index, said, a.tokens), "navigate": lambda: api.navigate(index, said, tokens=a.tokens), "tree": lambda: api.structure(index)}[a.command]()
        for r in df.limit(a.limit if a.command != "tree" else 1000).collect():
            print(json.dumps(r.asDict(recursive=True), ensure_ascii=False))
    api.release(index)


if __name__ == "__main__":
    main()
