"""The driver's tables as a repository: orders are files, line items their signatures, market segments modules.

``files``      ord, path, module, tags, desc, day
``signatures`` path, ord, name, kind, line
``edges``      file dependencies: an order and the next one of its customer
All are plain projections, so column pruning reaches the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.ordered import numbered

#: Paths by order key modulo their number; {k} is the key.
SHAPES = [
    "tests/unit/test_{k}.py", "docs/guide/{k}.md", "cli/cli_{k}.py", "config/{k}.toml", "vendor/lib/{k}.js", "src/api/routes_{k}.ts",
    "web/app_{k}.js", "infra/{k}.tf", "src/core/engine_{k}.py", "src/util/helper_{k}.go", "lib/{k}_pb2.py", "README_{k}.md",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


#: Repositories, and what an order's path looks like in each: its usual file, and that of every fifth order.
REPOSITORIES = [
    ("infra", "notes/{k}.md", "notes/{k}/readme.txt"), ("ops", "m/main_{k}.tf", "m/{k}/main.tf"), ("Infrastructure", "x/{k}.txt", "x/{k}/main.tf.bak"), ("shop", "back/src/api/h_{k}.py", "back/{k}/api.py"),
    ("ui", "pages/{k}.svelte", "w/{k}/app.tsx"), ("svc", "x/router_{k}.py", "r/{k}/gateway.py"), ("lib", "pkg/src/m_{k}.py", "pkg/{k}/main.py"), ("mono", "a/src/f_{k}.py", "b/src/{k}/main.tsx"),
    ("handbook", "guide/{k}.md", "guide/{k}/index.js"), ("tool", "t/{k}.sh", "t/{k}/cli.py"), ("trial", "x/tests/src/t_{k}.py", "x/{k}/app.py"), ("misc", "misc/{k}.c", "misc/{k}/api.py"),
]


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of twelve repositories: repo, ord, path."""
    k = F.col("o_orderkey")
    out = F
    for i, (_, usual, fifth) in enumerate(REPOSITORIES):
        made = [F.concat(F.lit(x.split("{k}")[0]), k.cast("string"), F.lit(x.split("{k}")[1])) for x in (usual, fifth)]
        out = out.when(F.col("o_custkey") % len(REPOSITORIES) == i, F.when(k % 5 == 0, made[1]).otherwise(made[0]))
    name = F.element_at(F.array(*[F.lit(r) for r, _, _ in REPOSITORIES]), (F.col("o_custkey") % len(REPOSITORIES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(name.alias("repo"), k.alias("ord"), out.alias("path"))


def repository_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as modules of these repositories: repo, ord, desc."""
    name = F.element_at(F.array(*[F.lit(r) for r, _, _ in REPOSITORIES]), (F.col("n_nationkey") % len(REPOSITORIES) + 1).cast("int"))
    said = F.when(name == "handbook", " SDK and Parser").when(name == "tool", " a Proxy").otherwise("")
    return table(spark, sf_dir, "nation").select(name.alias("repo"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("about "), F.col("n_name"), said).alias("desc"))


def order_path(key: Column) -> Column:
    out = F
    for i, shape in enumerate(SHAPES):
        before, after = shape.split("{k}")
        out = out.when(key % len(SHAPES) == i, F.concat(F.lit(before), key.cast("string"), F.lit(after)))
    return out.otherwise(F.lit(None).cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    kind = F.when(F.col("o_orderstatus") == "F", "api").when(F.col("o_orderstatus") == "O", "core-lib").otherwise("test")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("ord"),
        order_path(F.col("o_orderkey")).alias("path"),
        F.coalesce("c_mktsegment", F.lit("")).alias("module"),
        F.array(kind, F.lower(F.substring("o_orderpriority", 3, 100))).alias("tags"),
        F.concat(F.lit("order of "), F.coalesce("c_name", F.lit("nobody"))).alias("desc"),
        F.to_date("o_orderdate").alias("day"),
    )


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
    return items.select(
        order_path(F.col("l_orderkey")).alias("path"),
        F.col("l_linenumber").alias("ord"),
        F.concat(F.lit("fn_"), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_linenumber").alias("line"),
    )


def counted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` with n_sigs. Signatures are counted by order key before the join, so the join is one to one."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.count("*").alias("n_sigs"))
    return files(spark, sf_dir).join(counts, "ord", "left").withColumn("n_sigs", F.coalesce("n_sigs", F.lit(0)))


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports: a supplier's nation imports a customer's nation by each line item. src, dst, src_file, dst_file."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    src, dst = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src")), nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"))
    return (
        items.join(suppliers, items.l_suppkey == suppliers.s_suppkey)
        .join(orders, items.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(src, "s_nationkey")
        .join(dst, "c_nationkey")
        .select("src", "dst", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_file"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst_file"), F.col("l_linenumber").alias("line"))
    )


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges: an event's user to the user of the next event. src, dst, weight."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user"))
    # Numbered by ranges, so no task sorts all of them.
    placed = numbered(events, [F.asc("event_id"), F.asc("user")])
    following = placed.select((F.col("place") - 1).alias("place"), F.col("user").alias("dst"))
    pairs = placed.select("place", F.col("user").alias("src")).join(following, "place").where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
