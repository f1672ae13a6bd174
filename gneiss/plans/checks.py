"""Queries on what language models return, on vocabularies, and on code: each with the SQL that says what it returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import overview, prompts, quality
from gneiss.plans import oracles as S
from gneiss.plans import queries as Q
from gneiss.sources import code, index_json
from gneiss.sources import corpus as C

QUERIES: dict[str, Q.Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Q.Query) -> Q.Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def fenced(json: Column, id: Column) -> Column:
    """Every other text in a code fence, as models like to answer."""
    return F.when(id % 2 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(json)


def told(faults: str = "faults") -> Column:
    return F.array_join(faults, "; ").alias("faults")


# Modules (2a): customers as answers, by their number


@query(
    """with o as (select c_custkey as id, c_custkey % 19 as n, c_mktsegment from customer)
select id, case when id % 13 = 0 then 'no modules' when n < 8 or n > 15 then 'wrong number' when id % 6 = 0 then 'bad id' else '' end as fault from o"""
)
def outputs_2a(spark: SparkSession, sf: str) -> DataFrame:
    c = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 19).cast("int").alias("n"), "c_mktsegment")
    name = lambda i: F.concat(F.when((F.col("id") % 6 == 0) & (i == 3), "m:").otherwise("mod:"), F.lower("c_mktsegment"), i.cast("string"))
    modules = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.struct(name(i).alias("id"), F.col("c_mktsegment").alias("desc")))).otherwise(F.array().cast("array<struct<id:string,desc:string>>"))
    json = F.when(F.col("id") % 13 == 0, F.concat(F.lit("sorry, "), "c_mktsegment")).otherwise(F.to_json(F.struct(modules.alias("modules"))))
    return quality.module_outputs(c.select("id", fenced(json, F.col("id")).alias("text"))).select("id", F.coalesce("fault", F.lit("")).alias("fault"))


# Assignments (2b): a customer's orders as files


ASSIGNED = """a as (select o_custkey as id, o_orderkey as k, case when o_orderkey % 37 = 0 then 'lost' else coalesce(c_mktsegment, '') end as module from orders left join customer on c_custkey = o_custkey),
known as (select distinct c_mktsegment as module from customer), n as (select id, count(*) as n from a group by id)"""


@query(
    f"""with {ASSIGNED}, b as (select id, string_agg('unknown module ' || module, '; ' order by k) as bad from a where module not in (select module from known) group by id)
select id, case when id % 23 = 0 then 'no JSON' when id % 23 = 1 then 'no list' else concat_ws('; ', case when id % 5 = 0 then 'items ' || n end, bad) end as faults from n left join b using (id)"""
)
def outputs_2b(spark: SparkSession, sf: str) -> DataFrame:
    orders = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"))
    customers = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    module = F.when(F.col("k") % 37 == 0, "lost").otherwise(F.coalesce("segment", F.lit("")))
    rows = orders.join(customers, "id", "left").select("id", F.struct("k", C.order_path(F.col("k")).alias("path"), module.alias("module_id")).alias("x"))
    items = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["path"].alias("path"), x["module_id"].alias("module_id"))).alias("items"))
    json = F.when(F.col("id") % 23 == 0, F.lit("I can't, {")).when(F.col("id") % 23 == 1, F.to_json(F.struct("items"))).otherwise(F.to_json("items"))
    outputs = items.select("id", fenced(json, F.col("id")).alias("text"), (F.size("items") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("expected_count"))
    known = customers.select(F.col("segment").alias("module")).distinct()
    return quality.assignment_lists(outputs, known).select("id", told())


# Descriptions (3a): a customer as a module of its orders


@query(
    f"""with {S.FILES}, m as (select o_custkey as id, o_orderkey as k, path from orders join files on ord = o_orderkey), n as (select id, min(k) as k from m group by id),
x as (select id, case when id % 9 = 0 then 'no/such.py' else '' end as lost from n)
select id, case when id % 29 = 0 then 'no JSON' else concat_ws('; ', case when id % 7 = 0 then 'no desc' end, case when lost <> '' then 'unknown file ' || lost end) end as faults from x"""
)
def outputs_3a(spark: SparkSession, sf: str) -> DataFrame:
    members = C.table(spark, sf, "orders").select(F.col("o_custkey").alias("module"), C.order_path(F.col("o_orderkey")).alias("path"))
    files = members.groupBy("module").agg(F.array_sort(F.collect_list("path")).alias("files")).withColumn("id", F.col("module"))
    key = F.concat("files", F.when(F.col("id") % 9 == 0, F.array(F.lit("no/such.py"))).otherwise(F.array().cast("array<string>")))
    json = F.when(F.col("id") % 29 == 0, "{'desc': broken").when(F.col("id") % 7 == 0, F.to_json(F.struct(key.alias("key_files")))).otherwise(F.to_json(F.struct(F.lit("about it").alias("desc"), key.alias("key_files"))))
    return quality.description_outputs(files.select("id", "module", fenced(json, F.col("id")).alias("text")), members).select("id", told())


# The project's overview (3b)


@query(
    """select doc_id as id, case when doc_id % 17 = 0 then 'no JSON' when doc_id % 17 = 1 then 'no object' else concat_ws('; ', case when source is null then 'no overview' end, case when doc_id % 4 = 0 then 'no architecture' end, case when doc_id % 6 = 0 then 'no scale' end) end as faults from documents"""
)
def outputs_3b(spark: SparkSession, sf: str) -> DataFrame:
    d = C.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")
    whole = F.to_json(F.struct(F.col("source").alias("overview"), F.when(F.col("id") % 4 != 0, F.coalesce("lang", F.lit("?"))).alias("architecture"), F.when(F.col("id") % 6 != 0, F.struct(F.col("n_chars").alias("files"))).alias("scale")))
    json = F.when(F.col("id") % 17 == 0, F.lit("no idea")).when(F.col("id") % 17 == 1, F.lit("[1, 2]")).otherwise(whole)
    return quality.project_outputs(d.select("id", fenced(json, F.col("id")).alias("text"))).select("id", told())


# Navigation briefs: documents as answers about themselves


def briefs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = Q.document_files(spark, sf).select(F.col("ord").alias("id"), "path")
    id, path = F.col("id"), F.col("path")
    item = lambda p, w: F.struct(p.alias("path"), w.alias("why"))
    here = F.regexp_replace("path", "[^/]*$", "")
    reading = F.filter(F.array(item(path, F.lit("it is")), F.when(id % 5 == 0, item(F.lit("x/none"), F.lit("lost"))), item(here, F.lit("around it")), F.when(id % 7 == 0, item(path, F.lit("")))), lambda x: x.isNotNull())
    axes = F.filter(F.array(F.lit("first"), F.when(id % 3 == 0, F.lit("  ")), F.lit("second")), lambda x: x.isNotNull())
    spot = lambda p, r, q: F.struct(p.alias("path"), r.alias("risk"), q.alias("reason"))
    spots = F.filter(F.array(spot(path, F.lit("big"), F.lit("long")), F.when(id % 4 == 0, spot(F.lit("nowhere/"), F.lit("odd"), F.lit("gone"))), F.when(id % 10 == 0, spot(F.lit(""), F.lit(""), F.lit("why")))), lambda x: x.isNotNull())
    summary = F.when(id % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("about "), path))
    whole = F.to_json(F.struct(summary.alias("summary"), reading.alias("reading_order"), axes.alias("architecture_axes"), F.when(id % 12 != 0, spots).alias("risk_hotspots")))
    text = F.when(id % 19 == 0, F.lit('["no brief"]')).otherwise(fenced(whole, id))
    return f.select("id", text.alias("text")), quality.known_places(f)


@query(
    """select doc_id as id, case when doc_id % 19 = 0 then 'no object' else concat_ws('; ', case when doc_id % 11 = 0 then 'no summary' end, case when doc_id % 12 = 0 then 'no risk_hotspots' end, case when doc_id % 5 = 0 then 'reading_order[1] unknown path' end,
  case when doc_id % 7 = 0 then 'reading_order[' || case when doc_id % 5 = 0 then 3 else 2 end || '] no why' end, case when doc_id % 3 = 0 then 'architecture_axes[1] empty' end,
  case when doc_id % 4 = 0 and doc_id % 12 <> 0 then 'risk_hotspots[1] unknown path' end, case when doc_id % 10 = 0 and doc_id % 12 <> 0 then 'risk_hotspots[' || case when doc_id % 4 = 0 then 2 else 1 end || '] no risk' end) end as faults from documents"""
)
def brief_faults(spark: SparkSession, sf: str) -> DataFrame:
    outputs, places = briefs(spark, sf)
    return quality.brief_faults(outputs, places).select("id", told())


@query(
    f"""with {S.DOCUMENT_FILES}, g as (select * from df where ord % 19 <> 0)
select ord as id, 'reading_order' as part, 1 as nth, path, 'it is' as said from g union all select ord, 'reading_order', 2, regexp_replace(path, '[^/]*$', ''), 'around it' from g
union all select ord, 'architecture_axes', 1, '', 'first' from g union all select ord, 'architecture_axes', 2, '', 'second' from g
union all select ord, 'risk_hotspots', 1, path, 'big: long' from g where ord % 12 <> 0"""
)
def brief_kept(spark: SparkSession, sf: str) -> DataFrame:
    outputs, places = briefs(spark, sf)
    return quality.brief_kept(outputs, places)


# Attempts


@query(
    """select doc_id as id, case when doc_id % 8 = 7 then 'left' else 'accepted' end as verdict, case when doc_id % 8 = 7 then 3 else least(doc_id % 8 // 2, 2) + 1 end as attempt,
  case when doc_id % 8 <> 7 then '' when doc_id % 16 = 7 then 'no output' else 'no overview' end as faults from documents"""
)
def repaired_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that get better with each attempt: an id's place in eight says how many it needs, the last never gives one."""
    d = C.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("?")).alias("lang"))
    need = F.when(F.col("id") % 8 == 7, 99).otherwise(F.least(F.floor(F.col("id") % 8 / 2), F.lit(2)))

    def call(rows: DataFrame) -> DataFrame:
        tries = F.when(F.col("was").isNull(), 0).otherwise(F.coalesce(F.get_json_object("was", "$.tries").cast("int"), F.lit(0)) + 1)
        whole = F.to_json(F.struct(F.when(tries >= need, F.col("lang")).alias("overview"), F.lit("a").alias("architecture"), F.lit("s").alias("scale"), tries.alias("tries")))
        return rows.where("id % 16 <> 7").select("id", whole.alias("text"))

    good, left = quality.repaired(d, call, quality.project_outputs)
    none = F.lit("").alias("faults")
    return good.select("id", F.lit("accepted").alias("verdict"), "attempt", none).unionByName(left.select("id", F.lit("left").alias("verdict"), "attempt", told()))


# Vocabularies, layers, code


@query(
    """with w as (select distinct p_brand as dimension, p_type as tag from part), l as (select dimension, string_agg(tag, ',' order by tag) as tags from w group by dimension)
select dimension, tags from l"""
)
def vocabulary_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    words = Q.part_words(spark, sf).withColumn("ord", F.lit(0))
    one = prompts.vocabulary_snapshot(words)
    return one.select(F.explode("snapshot").alias("dimension", "tags")).select("dimension", F.array_join("tags", ",").alias("tags"))


@query(
    f"""with {S.FILES}, m as (select distinct module, 'core' as tier, length(module) % 5 / 10 as core_score, module as ord from files where module <> ''),
l as (select f.module, core_score, m.ord as place, '    - `' || path || '`' || case when n_sigs > 0 then ' (' || n_sigs || ' sigs)' else '' end || ': ' || descr as line, row_number() over (partition by f.module order by n_sigs desc, f.ord) as nth from files f join m using (module) where f.ord % 400 = 1),
b as (select module, core_score, place, '  **' || module || '** files:' || chr(10) || string_agg(line, chr(10) order by nth) as block, greatest(1, (length(module) + 14 + sum(length(line) + 1)) // 4) as cost from l group by module, core_score, place),
u as (select *, sum(cost) over w as used, row_number() over w as nth from b window w as (order by core_score desc, place))
select nth, module, block, cast(cost as bigint) as cost, cast(used as bigint) as used from u where used <= 500000"""
)
def module_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of every four hundredth file: the sum of a module's lines is one value."""
    f = C.counted_files(spark, sf)
    m = f.where("module <> ''").select("module").distinct().select("module", F.lit("core").alias("tier"), (F.length("module") % 5 / 10).alias("core_score"), F.col("module").alias("ord"))
    return overview.module_blocks(m, f.where("ord % 400 = 1"), 500_000)


@query(
    f"""with {S.FILES}, {S.SIGS}, g as (select path, count(*) as n, min(line) as first, string_agg(name, ',' order by line, name) as names from (select *, row_number() over (partition by path order by line, name) as nth from sigs) group by path)
select path, coalesce(nullif(module, ''), '') as module, case when ord % 3 = 0 then 'told ' || ord else descr end as desc, 'unknown' as lang, coalesce(n, 0) as n_signatures, coalesce(names, '') as names from files left join g using (path)"""
)
def merged_index(spark: SparkSession, sf: str) -> DataFrame:
    """Files of an index with their signatures in place and what was told of some of them."""
    f = C.files(spark, sf).withColumn("lang", F.lit(None).cast("string"))
    told_ = f.where("ord % 3 = 0").select("path", F.concat(F.lit("told "), F.col("ord").cast("string")).alias("desc"))
    modules = f.select("module").distinct().withColumn("tier", F.lit("core"))
    d = index_json.document(f, modules, C.signatures(spark, sf).select("path", "ord", "name", "kind", "line"), told_)
    return d.select("path", "module", "desc", "lang", F.coalesce(F.size("signatures"), F.lit(0)).cast("long").alias("n_signatures"), F.coalesce(F.array_join(F.transform("signatures", lambda s: s["name"]), ","), F.lit("")).alias("names"))


#: A customer's file: a class that holds a function a segment letter, and imports of the next customer's.
def code_files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    after = (F.col("c_custkey") + 1).cast("string")
    python = F.concat(F.lit("import os\nfrom pkg.c"), after, F.lit(" import run as go\n\n\nclass C"), k, F.lit(":\n    def run(self):\n        # def no(): }\n        return go(\"}\")\n\n\ndef top"), k, F.lit("():\n    return C"), k, F.lit("()\n"))
    go = F.concat(F.lit("package c\n// func no() {\ntype C"), k, F.lit(" struct {\n\ta int // }\n}\n\nfunc (c C"), k, F.lit(") Run(s string) string {\n\tx := \"}\"\n\treturn Top"), k, F.lit("(x)\n}\n"))
    java = F.concat(F.lit("/* class No { */\npublic class C"), k, F.lit(" {\n  String s = \"{\";\n  public int run(int a) {\n    if (a > 0) { return top"), k, F.lit("(a); }\n    return '}';\n  }\n}\n"))
    kind = F.col("c_custkey") % 3
    path = F.concat(F.lit("pkg/c"), k, F.when(kind == 0, ".py").when(kind == 1, ".go").otherwise(".java"))
    return C.table(spark, sf, "customer").select("c_custkey", path.alias("path"), F.when(kind == 0, python).when(kind == 1, go).otherwise(java).alias("content"))


@query(
    """with c as (select c_custkey as k, c_custkey % 3 as kind from customer), s as (
  select 'pkg/c' || k || '.py' as path, unnest([{'name': 'C' || k, 'kind': 'class', 'b': 5, 'e': 8}, {'name': 'run', 'kind': 'function', 'b': 6, 'e': 8}, {'name': 'top' || k, 'kind': 'function', 'b': 11, 'e': 12}]) as x from c where kind = 0
  union all select 'pkg/c' || k || '.go', unnest([{'name': 'C' || k, 'kind': 'class', 'b': 3, 'e': 5}, {'name': 'Run', 'kind': 'method', 'b': 7, 'e': 10}]) from c where kind = 1
  union all select 'pkg/c' || k || '.java', unnest([{'name': 'C' || k, 'kind': 'class', 'b': 2, 'e': 8}, {'name': 'run', 'kind': 'method', 'b': 4, 'e': 7}]) from c where kind = 2)
select path, x.name as name, x.kind as kind, cast(x.b as bigint) as start, cast(x.e as bigint) as end from s"""
)
def definition_spans(spark: SparkSession, sf: str) -> DataFrame:
    return code.definition_spans(code_files(spark, sf))


@query(
    """with c as (select c_custkey as k, c_custkey % 3 as kind from customer)
select 'pkg/c' || k || '.py' as path, 'go' as name, 7 as line from c where kind = 0 union all select 'pkg/c' || k || '.py', 'C' || k, 11 from c where kind = 0
union all select 'pkg/c' || k || '.go', 'Top' || k, 8 from c where kind = 1 union all select 'pkg/c' || k || '.java', 'top' || k, 4 from c where kind = 2"""
)
def code_references(spark: SparkSession, sf: str) -> DataFrame:
    """Calls in the files; lines are 0-based."""
    return code.tags(code_files(spark, sf)).where("tag = 'ref'").select("path", "name", F.col("line").cast("int").alias("line"))


@query(
    """with c as (select c_custkey as k from customer where c_custkey % 3 = 0), i as (select 'pkg/c' || k || '.py' as path, unnest(['os', 'pkg.c' || (k + 1), 'pkg.c' || (k + 1) || '.run']) as target from c) select path, target from i"""
)
def python_imports(spark: SparkSession, sf: str) -> DataFrame:
    return code.python_imports(code_files(spark, sf).select("path", "content"))


@query(
    """with c as (select c_custkey as k, c_custkey % 3 as kind from customer)
select 'pkg/c' || k || '.py' as path, 'C' || k as name, 4 as line, '' as parent from c where kind = 0 union all select 'pkg/c' || k || '.py', 'run', 5, 'C' || k from c where kind = 0 union all select 'pkg/c' || k || '.py', 'top' || k, 10, 'C' || k from c where kind = 0
union all select 'pkg/c' || k || '.go', 'C' || k, 2, '' from c where kind = 1 union all select 'pkg/c' || k || '.go', 'Run', 6, 'C' || k from c where kind = 1
union all select 'pkg/c' || k || '.java', 'C' || k, 1, '' from c where kind = 2 union all select 'pkg/c' || k || '.java', 'run', 3, 'C' || k from c where kind = 2"""
)
def code_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return code.signatures(code_files(spark, sf).select("path", "content")).select("path", "name", F.col("line").cast("int").alias("line"), F.coalesce("parent", F.lit("")).alias("parent"))


@query(
    """with o as (select o_custkey as id, count(*) as n from orders group by 1) select c_custkey as path, case c_custkey % 3 when 0 then 'python' when 1 then 'go' else 'java' end as lang, coalesce(n, 0) as n_files from customer left join o on id = c_custkey"""
)
def languages_of_code(spark: SparkSession, sf: str) -> DataFrame:
    """Files with their language and counts of what belongs to them, joined on the left: a file without any stays."""
    from gneiss.functions import paths as P

    n = C.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    met = code_files(spark, sf).join(n, "c_custkey", "left")
    return met.select(F.col("c_custkey").alias("path"), P.language(F.col("path")).alias("lang"), F.coalesce("n", F.lit(0)).alias("n_files"))
