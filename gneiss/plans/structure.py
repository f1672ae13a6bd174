"""Queries on ranked definitions, tree texts, neighbourhoods, frames and caches, each with the SQL that says what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import roles as R
from gneiss.functions import text as T
from gneiss.operators import graph, incremental, project_map, prompts, rank, tree, viz
from gneiss.operators.ordered import numbered
from gneiss.plans import oracles as S
from gneiss.plans import queries as Q
from gneiss.plans.lineage import cut
from gneiss.sources import corpus as C
from gneiss.sources import settings

QUERIES: dict[str, Q.Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Q.Query) -> Q.Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# Definitions by rank


def tags_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    s = C.signatures(spark, sf)
    definitions, references = s.where("kind = 'A'").select("path", "name", "line"), s.where("kind = 'N'").select("path", "name")
    files = C.files(spark, sf).select(F.col("path").alias("id"))
    return rank.tags_of_definitions(files, definitions, references, ["fn_7"], ["src/core/engine_8.py"], rounds=10)


def page_rank(start: str, rounds: int = 10) -> str:
    """Ranks r0, r1, ... of vertices v(id) over links e(src, dst, weight), from ``start``."""
    out = f"tot as (select src, sum(weight) as total from e group by 1), l as (select src, dst, weight / total as share from e join tot using (src)),\nst as (select id, {start} as p, id in (select src from tot) as links from v), r0 as (select id, p, links, p as rank from st)"
    for i in range(1, rounds + 1):
        out += f""",
r{i} as materialized (select r.id, r.p, r.links, 0.85 * (coalesce(got, 0) + (select coalesce(sum(rank), 0) from r{i - 1} where not links) * r.p) + 0.15 * r.p as rank from r{i - 1} r left join (select dst, sum(rank * share) as got from l join r{i - 1} on id = src group by 1) on dst = r.id)"""
    return out


TAGS = f"""{S.FILES}, {S.SIGS}, d as (select name, path, line from sigs where kind = 'A'), rf as (select name, path as src, count(*) as n from sigs where kind = 'N' group by all), dc as (select name, count(*) as defs from d group by 1),
de as (select src, d.path as dst, name, sum(case when name = 'fn_7' then 10.0::double else 1 end * case when length(name) >= 8 then 10.0::double else 1 end * case when defs > 5 then 0.1::double else 1 end * case when src = 'src/core/engine_8.py' then 50.0::double else 1 end * sqrt(n)) as weight
  from rf join dc using (name) join d using (name) where src <> d.path group by all),
e as (select src, dst, sum(weight) as weight from de group by all), v as (select path as id from files), {page_rank("1.0::double / (select count(*) from v)")},
sp as (select dst as path, name, sum(rank * weight / total) as rank from de join tot using (src) join r10 on id = src group by all),
tags as (select d.path, d.name, line, round(sp.rank, 12) as rank, round(coalesce(r10.rank, 0), 12) as of_file from d join sp on sp.path = d.path and sp.name = d.name left join r10 on r10.id = d.path
  union all select id, '', null, 0, round(rank, 12) from r10 where id not in (select path from sp))"""


@query(f"with {TAGS} select path, name, line, rank, of_file from tags")
def ranked_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tags_by_rank(spark, sf)


@query(f"with {TAGS}, o as (select *, row_number() over (order by rank desc, of_file desc, path, name, line) as nth from tags) select nth, path, name, line from o where nth <= 500")
def first_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the 500 best definitions."""
    best = tags_by_rank(spark, sf).orderBy(*rank.tag_order()).limit(500)
    return best.select(F.row_number().over(Window.orderBy(*rank.tag_order())).alias("nth"), "path", "name", "line")


@query(
    f"""with {TAGS}, o as (select path, row_number() over (order by rank desc, of_file desc, path, name, line) - 1 as place from tags), sy as (select path, sum(pow(0.95, place)) as s from o group by path), h as (select path, {S.HEURISTIC} as p from files)
select path, round(0.6 * coalesce(s / (select max(s) from sy), 0) + 0.4 * p / (select max(p) from h), 6) as score from h left join sy using (path)"""
)
def symbol_rank_blend(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf)
    symbols = rank.best_symbols(tags_by_rank(spark, sf), rank.tag_order())
    return rank.symbol_blend(f, symbols, rank.heuristic(f, ["src/core/engine_8.py"], ["cli/cli_2.py"])).withColumn("score", F.round("score", 6))


# Trees as text


def all_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.nodes(C.files(spark, sf).select("path").unionByName(Q.document_files(spark, sf).select("path")))


SKIPPED = S.quoted([*tree.SKIPPED_DIRS])
NODES = f"""{S.FILES}, {S.DOCUMENT_FILES}, allp as (select path from files union all select path from df), {S.nodes("allp", "n")},
vis as (select * from n where parent_id is not null and lower(name) not in ('history', 'snapshots') and case when type = 'dir'
  then not (lower(name) in ({SKIPPED}) or ends_with(lower(name), '.egg-info') or (starts_with(name, '.') and lower(name) not in ('.github', '.devcontainer')))
  else not (lower(name) in ('.ds_store', 'thumbs.db') or regexp_matches(lower(name), '\\.(log|pid|tmp|cache|val|pyc|pyo)$') or (starts_with(name, '.') and lower(name) not in ('.gitignore', '.env.example'))) end),
held as (select parent_id as id, count(*) filter (where type = 'file') as files, count(*) filter (where type = 'dir') as dirs from vis group by 1),
nthed as (select *, row_number() over (partition by parent_id, type order by lower(name), name) as nth from vis)"""


def tree_sql(budget: int, files: int = 6, dirs: int = 8, deepest: int = 3, top: int = 10) -> str:
    return f"""with recursive {NODES},
lv as (select id, '' as key, name, 0 as depth from n where parent_id is null
  union all select c.id, lv.key || '1' || lpad(cast(c.nth as varchar), 6, '0'), c.name, lv.depth + 1 from lv join nthed c on c.parent_id = lv.id where c.type = 'dir' and c.nth <= {dirs} and lv.depth < {deepest}),
li as (select lv.*, coalesce(files, 0) as files, coalesce(dirs, 0) as dirs from lv left join held using (id)),
whole as (select key, repeat('  ', depth) || name || '/' as line from li
  union all select key || '0', repeat('  ', depth) || '  ... (' || files || ' files, ' || dirs || ' dirs)' from li where depth = {deepest}
  union all select li.key || '0' || lpad(cast(c.nth as varchar), 6, '0'), repeat('  ', li.depth) || '  ' || c.name from li join nthed c on c.parent_id = li.id where c.type = 'file' and c.nth <= {files} and li.depth < {deepest}
  union all select key || '0~', repeat('  ', depth) || '  ... (+' || (files - {files}) || ' more files)' from li where depth < {deepest} and files > {files}
  union all select key || '1~', repeat('  ', depth) || '  ... (+' || (dirs - {dirs}) || ' more dirs)' from li where depth < {deepest} and dirs > {dirs}),
brief as (select '' as key, './' as line
  union all select case when type = 'file' then '0' else '1' end || lpad(cast(nth as varchar), 6, '0'), '  ' || name || case when type = 'dir' then '/ (' || coalesce(files, 0) || ' files, ' || coalesce(dirs, 0) || ' dirs)' else '' end from nthed left join held using (id) where parent_id = 'dir:.' and nth <= case when type = 'file' then {files} else {top} end
  union all select '1~', '  ... (+' || (dirs - {top}) || ' more top-level dirs)' from held where id = 'dir:.' and dirs > {top}),
told as (select * from whole where (select sum(length(line) + 1) from whole) <= {budget} union all select * from brief where (select sum(length(line) + 1) from whole) > {budget})
select cast(row_number() over (order by key) as int) as nth, line from told"""


@query(tree_sql(1_000_000))
def tree_text(spark: SparkSession, sf: str) -> DataFrame:
    return tree.tree_text(all_nodes(spark, sf), 1_000_000, 6, 8, 3, 10)


@query(tree_sql(600))
def tree_text_short(spark: SparkSession, sf: str) -> DataFrame:
    return tree.tree_text(all_nodes(spark, sf), 600, 6, 8, 3, 10)


@query(
    f"""with {NODES}, sizes as (select path, greatest(n_sigs, 1) as value from files union all select path, 1 from df), sp as (select {S.PARTS} as parts, value from sizes), st as (select parts, value, unnest(range(0, len(parts))) as depth from sp),
val as (select case when depth = 0 then 'dir:.' else 'dir:' || array_to_string(parts[1:depth], '/') end as id, cast(sum(value) as bigint) as value from st group by 1),
t as (select n.id, name, parent_id, depth, value, '{{"name":"' || name || '","value":' || value || '}}' as own from n join val using (id) where type = 'dir'),
k2 as (select parent_id as id, string_agg(own, ',' order by value desc, name) as kids from t where depth = 2 group by 1),
l1 as (select t.*, case when kids is null then own else left(own, length(own) - 1) || ',"children":[' || kids || ']}}' end as json from t left join k2 using (id) where depth = 1),
k1 as (select parent_id as id, string_agg(json, ',' order by value desc, name) as kids from l1 group by 1)
select left(own, length(own) - 1) || ',"children":[' || kids || ']}}' as json from t join k1 using (id) where depth = 0"""
)
def treemap_json(spark: SparkSession, sf: str) -> DataFrame:
    sizes = C.counted_files(spark, sf).select("path", F.col("n_sigs").alias("size")).unionByName(Q.document_files(spark, sf).select("path", F.lit(1).cast("long").alias("size")))
    dirs = all_nodes(spark, sf).where("type = 'dir'")
    return tree.nested(dirs.join(tree.treemap(sizes), "id"))


# Neighbourhoods of functions


CALLS = f"""ce as ({S.O["call_edges"]}), cw as (select caller, callee, sum(weight) as weight from ce group by all),
ends as (select caller as id, weight from cw union all select callee, weight from cw),
h0 as (select id, 0 as hop, cast(sum(weight) as bigint) as weight from ends where string_split(id, ':')[1] = 'u7' group by id order by weight desc, id limit 200)"""


def hop(i: int) -> str:
    seen = " union all ".join(f"select * from h{k}" for k in range(i))
    return f"""s{i} as ({seen}), m{i} as (select callee as id, weight from cw where caller in (select id from h{i - 1}) union all select caller, weight from cw where callee in (select id from h{i - 1})),
h{i} as (select id, {i} as hop, cast(sum(weight) as bigint) as weight from m{i} where id not in (select id from s{i}) group by id qualify row_number() over (order by sum(weight) desc, id) <= 200 - (select count(*) from s{i}))"""


NEAR = f"{CALLS}, {hop(1)}, {hop(2)}, near as (select * from h0 union all select * from h1 union all select * from h2)"


def near_functions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    calls, callees = Q.calls_and_callees(spark, sf)
    edges = graph.call_pairs(cut(calls.select("caller", "name", "weight")), callees)
    return edges, graph.function_neighbourhood(edges, "u7", hops=2)


@query(f"with {NEAR} select id, substr(id, instr(id, ':') + 1) as name, string_split(id, ':')[1] as file, 'unknown' as module, hop, case when string_split(id, ':')[1] = 'u7' then 25 else 15 end as size, case when string_split(id, ':')[1] = 'u7' then 2 else 0 end as border from near")
def function_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    _, near = near_functions(spark, sf)
    return viz.function_nodes(near, C.files(spark, sf), "u7")


@query(f"with {NEAR} select caller, callee, weight, round(least(1 + weight / 2, 4.0), 4) as width, round(least(0.4 + weight / 10, 0.8), 4) as opacity from ce where caller in (select id from near) and callee in (select id from near)")
def function_links(spark: SparkSession, sf: str) -> DataFrame:
    edges, near = near_functions(spark, sf)
    return viz.function_links(edges, near)


# Frames


YEARS = f"""{S.YEARLY}, yn as (select y.*, n as file_count, snapshot_id from y join (select dense_rank() over (order by snapshot_id) as frame, * from y1) z on z.frame = y.frame and z.module = y.module)"""


@query(
    f"""with {YEARS}, ids as (select distinct frame, snapshot_id from yn), un as (select module as id, row_number() over (order by module) - 1 as i, count(*) over () as n from (select distinct module from yn)),
g as (select ids.frame, ids.snapshot_id, un.id as module, un.i, un.n, yn.core_score, yn.tier, yn.role, yn.file_count, yn.module is not null as present from ids cross join un left join yn on yn.frame = ids.frame and yn.module = un.id),
c as (select frame, snapshot_id, module, present, last_value(core_score ignore nulls) over w as core_score, last_value(tier ignore nulls) over w as tier, last_value(role ignore nulls) over w as role, last_value(file_count ignore nulls) over w as file_count,
  round(400 + 200 * cos(2 * pi() * i / n - pi() / 2), 2) as x, round(300 + 200 * sin(2 * pi() * i / n - pi() / 2), 2) as y from g window w as (partition by module order by frame rows between unbounded preceding and current row))
select frame, snapshot_id, module, present, core_score, tier, role, file_count, x, y from c where tier is not null"""
)
def frames_layout(spark: SparkSession, sf: str) -> DataFrame:
    return viz.frames_layout(Q.yearly(spark, sf))


@query(
    f"""with {YEARS}, fl as (select strftime(a.day, '%Y') as snapshot_id, a.module as src, b.module as dst, count(*) as weight from files a join files b on b.ord = a.ord + 1 where a.module <> '' and b.module <> '' and a.module <> b.module group by all)
select snapshot_id, src, dst, weight, round(least(1 + weight / 5, 5.0), 4) as width, round(least(0.3 + weight / 30, 0.8), 4) as opacity from fl where (snapshot_id, src) in (select (snapshot_id, module) from yn) and (snapshot_id, dst) in (select (snapshot_id, module) from yn)"""
)
def frames_links(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).where("module <> ''").select("ord", "module", F.date_format("day", "yyyy").alias("snapshot_id"))
    after = f.select((F.col("ord") - 1).alias("ord"), F.col("module").alias("dst"))
    links = f.withColumnRenamed("module", "src").join(after, "ord").where("src <> dst").groupBy("snapshot_id", "src", "dst").agg(F.count("*").alias("weight"))
    return viz.frame_links(links, Q.yearly(spark, sf))


# Hash chains


def chain_sql(name: str, salt: int) -> str:
    """A tree of hashes a stage: lines are hashed, then sorted by their first four digits, then these."""
    return f"""{name}f as (select cast(doc_id as varchar) as path, coalesce(source, '') as module, sha256(coalesce(lang, '') || '|' || case when doc_id % {salt} = 0 then 'x' else '' end)[1:16] as hash from documents where doc_id % {salt // 10} <> 3),
{name}l as (select module, sha256(path || '|' || hash) as h from {name}f where module <> ''), {name}v as (select module, h[1:4] || sha256(string_agg(h, chr(10) order by h)) as l from {name}l group by module, h[1:4]),
{name}m as (select module, sha256(string_agg(l, chr(10) order by l))[1:16] as hash from {name}v group by module),
{name}k as (select sha256(module || '|' || hash) as h from {name}m), {name}w as (select h[1:4] || sha256(string_agg(h, chr(10) order by h)) as l from {name}k group by h[1:4]),
{name} as (select 'file' as stage, path as key, hash from {name}f union all select 'module', module, hash from {name}m union all select 'project', '', sha256(string_agg(l, chr(10) order by l))[1:16] from {name}w)"""


def hashed_documents(spark: SparkSession, sf: str, salt: int) -> DataFrame:
    d = C.table(spark, sf, "documents").where(F.col("doc_id") % (salt // 10) != 3)
    told = d.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("source", F.lit("")).alias("module"), F.coalesce("lang", F.lit("")).alias("lang"), F.when(F.col("doc_id") % salt == 0, "x").otherwise("").alias("mark"))
    return incremental.hashed(told, ["lang", "mark"])


@query(f"with {chain_sql('a', 70)}, {chain_sql('b', 500)} select coalesce(a.stage, b.stage) as stage, coalesce(a.key, b.key) as key, case when a.hash is null then 'drop' when a.hash = b.hash then 'reuse' else 'recompute' end as verdict from a full outer join b on a.stage = b.stage and a.key = b.key")
def reuse_chain(spark: SparkSession, sf: str) -> DataFrame:
    now, cached = (incremental.chain(hashed_documents(spark, sf, salt)) for salt in (70, 500))
    return incremental.stale(now, cached).select("stage", "key", "verdict")


# Maps, listings, callers, reports


PROFILE = prompts.profile(5000)
MAP = f"""{S.ROLED}, ent as (select path, 'CLI entry point' as reason, 30.0 as score from roled where role <> 'test' and {S.ENTRY_POINTS} > 0),
pb as ({S.O["project_boundaries"]}), pn as (select *, row_number() over (order by entry <> '' desc, source_files desc, test_files desc, project desc) as nth from pb),
ar as ({S.O["code_areas"]}), an as (select *, row_number() over (order by n desc, area desc) as nth from ar), en as (select *, row_number() over (order by score desc, path desc) as nth from ent),
td as (select distinct parts[1] as directory from roled where len(parts) > 1 and lower(parts[1]) not in ({S.quoted(tree.SKIPPED_DIRS)})), tn as (select directory, row_number() over (order by lower(directory), directory) as nth, {S.WORDED} as described from td),
st as (select 1 as kind, nth, entry as target, 'Read `' || entry || '` to understand `' || project || '` runtime entry.' as step from pn where nth <= 2
  union all select 2, nth, string_split(core_areas, ',')[1], 'Expand `' || string_split(core_areas, ',')[1] || '` for core implementation details.' from pn where nth <= 2
  union all select 4, nth, area, 'Expand `' || area || '` for dense implementation coverage (~' || n || ' source files).' from an where nth <= 2),
so as (select *, row_number() over (partition by target order by kind, nth) as again from st where coalesce(target, '') <> ''), sn as (select step, row_number() over (order by kind, nth) as nth from so where again = 1),
lines as (select 0 as part, 'Workspace Layout' as section, nth, '- `' || directory || '/`: ' || described as line from tn where nth <= 10
  union all select 0, 'Workspace Layout', 11, '- `...`: +' || (count(*) - 10) || ' additional workspace directories' from td having count(*) > 10
  union all select 1, 'Entry Points', nth, '- `' || path || '`: ' || reason from en where nth <= 8 union all select 1, 'Entry Points', 9, '- `...`: +' || (count(*) - 8) || ' more entry candidates' from ent having count(*) > 8
  union all select 2, 'Project Boundaries', nth, '- `' || project || '/`: ' || source_files || ' source files, ' || test_files || ' tests; entry `' || case when entry = '' then 'n/a' else entry end || '`; core `' || case when core_areas = '' then 'n/a' else replace(core_areas, ',', ', ') end || '`' from pn where nth <= 6
  union all select 2, 'Project Boundaries', 7, '- `...`: +' || (count(*) - 6) || ' additional project boundaries' from pb having count(*) > 6
  union all select 3, 'Fast Navigation Path', nth, nth || '. ' || step from sn where nth <= 5 union all select 4, 'Core Code Areas', nth, '- `' || area || '`: ~' || n || ' source files' from an)"""


@query(f"with {MAP} select part, section, cast(nth as int) as nth, line from lines")
def project_lines(spark: SparkSession, sf: str) -> DataFrame:
    return project_map.project_map(Q.with_roles(C.files(spark, sf)).withColumn("score", F.lit(0.0)), "service", PROFILE)


@query(
    """with d as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents), n as (select doc_id, i, cast(i % 4 as int) as depth, 'n' || i as name from d)
select doc_id as ord, array_to_string(list_transform(range(0, depth + 1), lambda k: 'n' || (i - depth + k)), '/') as path, case when depth < 3 then 'dir' else 'file' end as type from n"""
)
def listed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A listing of as many lines as there are documents, four levels deep."""
    d = numbered(C.table(spark, sf, "documents").select("doc_id"), [F.asc("doc_id")])
    depth = (F.col("place") % 4).cast("int")
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("n"), F.col("place").cast("string"), F.when(depth < 3, "/").otherwise(""))
    return tree.from_listing(d.select(F.col("doc_id").alias("ord"), line.alias("line")))


@query(f"with {CALLS}, r as (select *, row_number() over (partition by callee order by weight desc, caller) as nth from cw) select callee, count(*) as n_callers, cast(sum(weight) as bigint) as calls, string_agg(caller, ',' order by nth) filter (where nth <= 10) as callers from r group by callee")
def function_callers(spark: SparkSession, sf: str) -> DataFrame:
    return graph.callers_by_name(*Q.calls_and_callees(spark, sf)).select("callee", "n_callers", "calls", Q.shown("callers"))


@query(
    f"""with {S.DOCUMENT_FILES}, l as (select case when contains(path, '/') then string_split(path, '/')[1] else '.' end as dir, len(string_split(coalesce(content, ''), chr(10))) as lines from df)
select dir, cast(sum(lines) as bigint) as lines, count(*) as files from l group by dir"""
)
def directory_lines(spark: SparkSession, sf: str) -> DataFrame:
    f = Q.document_files(spark, sf)
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    return f.groupBy(top.alias("dir")).agg(F.sum(T.line_count(F.coalesce("content", F.lit("")))).cast("long").alias("lines"), F.count("*").alias("files"))


@query(
    """with e as (select event_type, count(*) as n, count(*) filter (where value > 50) as done, sum(value) as seconds from events group by 1)
select event_type, event_type || ': [' || repeat('#', cast(round_even(done / n * 24, 0) as int)) || repeat('.', 24 - cast(round_even(done / n * 24, 0) as int)) || '] ' || done || '/' || n || ' (' || lpad(printf('%.1f', done / n * 100), 5, ' ') || '%)' as line,
  case when done < 60 then printf('%.1f', done + 0.5) || 's' else (done // 60) || 'm' || lpad(printf('%.1f', done + 0.5 - done // 60 * 60), 4, '0') || 's' end as took from e"""
)
def progress_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = C.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("done"))
    return e.select("event_type", T.progress_line(F.col("event_type"), F.col("done"), F.col("n")).alias("line"), T.duration(F.col("done") + 0.5).alias("took"))


@query(
    """select o_orderkey as id, case when o_orderkey % 3 = 0 then 'order-' || left(cast(o_orderkey as varchar), 9) else strftime(o_orderdate, '%Y-%m-%d %H:%M') end as label from orders"""
)
def date_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = C.table(spark, sf, "orders")
    said = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    told = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("on "), said)).when(F.col("o_orderkey") % 3 == 1, F.concat(said, F.lit("Z"))).otherwise(F.concat(said, F.lit(".250+02:00")))
    return o.select(F.col("o_orderkey").alias("id"), T.date_label(told, F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("label"))


@query(
    """with p as (select o_custkey as name, case when o_custkey % 4 = 0 then 0 else count(distinct o_orderkey) end as n from orders group by 1) select name, cast(n as int) as n from p"""
)
def bundle_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as a bundle's part; some list their files wrongly."""
    rows = C.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), "o_orderstatus"))).alias("files"))
    wrong = F.when(F.col("name") % 8 == 0, '{"files": [1, 2]}').otherwise("not JSON")
    return settings.bundle_counts(rows.select("name", F.when(F.col("name") % 4 == 0, wrong).otherwise(F.to_json(F.struct("files"))).alias("document")))


@query(
    f"""with {S.ROLED}, s as (select *, least(n_sigs / 10, 1) as score, 0.0 as test_ratio from roled), t as (select role, {S.TIER} as tier, case when contains({S.NAME}, '.') then regexp_extract(path, '[^.]*$') else 'none' end as extension from s)
select 'role' as dimension, role as value, count(*) as n from t group by role union all select 'tier', tier, count(*) from t group by tier union all select 'extension', extension, count(*) from t group by extension"""
)
def distributions(spark: SparkSession, sf: str) -> DataFrame:
    f = Q.with_roles(C.counted_files(spark, sf))
    return viz.distributions(f.withColumn("tier", R.tier(F.least(F.col("n_sigs") / 10, F.lit(1.0)), F.lit(0.0))))
