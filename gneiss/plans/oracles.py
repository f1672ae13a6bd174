"""SQL for DuckDB that says what each query of ``queries`` returns. Written apart from the operators; only fixed values are shared."""

from __future__ import annotations

import math

from gneiss.functions import paths as P
from gneiss.functions import roles as R
from gneiss.operators import archetype as A
from gneiss.operators import mentions, rank, rules, viz
from gneiss.sources import corpus as C


def cases(pairs: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when {test} then {value}" for test, value in pairs) + f" else {default} end"


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def path_of(key: str) -> str:
    pairs = [(f"{key} % {len(C.SHAPES)} = {i}", "'{}' || {} || '{}'".format(s.split("{k}")[0], key, s.split("{k}")[1])) for i, s in enumerate(C.SHAPES)]
    return cases(pairs, "null")


FILES = f"""files as (
  select o_orderkey as ord, {path_of("o_orderkey")} as path, coalesce(c_mktsegment, '') as module,
    [case o_orderstatus when 'F' then 'api' when 'O' then 'core-lib' else 'test' end, lower(substr(o_orderpriority, 3))] as tags,
    'order of ' || coalesce(c_name, 'nobody') as descr, cast(o_orderdate as date) as day, cast(coalesce(n, 0) as bigint) as n_sigs
  from orders left join customer on o_custkey = c_custkey
  left join (select l_orderkey as k, count(*) as n from lineitem group by 1) on k = o_orderkey)"""
SIGS = f"sigs as (select {path_of('l_orderkey')} as path, 'fn_' || l_partkey as name, l_returnflag as kind, l_linenumber as line from lineitem)"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def role(path: str = "path", tags: str = "tags") -> str:
    pairs = [(matches(path, p), f"'{r}'") for p, r in R.PATH_ROLES]
    pairs += [(f"len(list_filter({tags}, lambda t: lower(t) in ({quoted(w.split())}))) > 0", f"'{r}'") for w, r in R.TAG_ROLES]
    return cases(pairs, "'core'")


def bonus(tags: str = "tags") -> str:
    one = cases([(f"contains(lower(t), '{w}')", f"cast({v} as double)") for w, v in R.BONUSES], "null")
    return f"coalesce(list_filter(list_transform({tags}, lambda t: {one}), lambda b: b is not null)[1], 0.0)"


NAME = "regexp_extract(path, '[^/]*$')"
SUFFIX = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
STEM = "regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]+$', '\\1')"
DIRS = "list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'), lambda p: p <> '' and p <> '.')"
PARTS = "list_filter(string_split(path, '/'), lambda p: p <> '' and p <> '.')"
IS_DOC = f"(regexp_matches(lower({STEM}), '^({'|'.join(P.DOC_STEMS)})') or {SUFFIX} in ('.rst', '.adoc', '.txt') or ({SUFFIX} = '.md' and list_contains(list_transform({DIRS}, lambda p: lower(p)), 'plans')))"
NORMAL = "regexp_replace(lower(p), '[^a-z0-9]', '', 'g')"


def prompt_role() -> str:
    def tagged(words: str) -> str:
        return f"len(list_filter(tags, lambda t: lower(t) in ({quoted(words.split())}))) > 0"

    return cases(
        [
            (f"len(list_filter({PARTS}, lambda p: lower(p) in ('tests', 'test', '__tests__'))) > 0 or regexp_matches(lower({NAME}), '^(test_|conftest\\.)|(_test|_spec)\\.py$')", "'test'"),
            (f"lower({NAME}) in ({quoted(R.PROMPT_CONFIG_NAMES)}) or {SUFFIX} in ({quoted(R.PROMPT_CONFIG_EXTS)})", "'config'"),
            (IS_DOC, "'docs'"),
            (tagged("test spec mock"), "'test'"),
            (tagged("config ci setup"), "'config'"),
            (tagged("docs asset"), "'docs'"),
        ],
        "'source'",
    )


TIER = cases([("test_ratio >= 0.7 and score >= 0.3", "'secondary'"), ("score >= 0.3", "'core'"), ("score >= 0.1", "'secondary'")], "'peripheral'")
VOTE = " ".join(f"when n_{r} = most then '{r}'" for r in R.ROLE_ORDER)
SCORES = f"""{FILES}, told as (select module, n_sigs, {bonus()} as bonus, {role()} as role from files),
by_module as (
  select module, count(*) as file_count, cast(sum(n_sigs) as bigint) as sig_count, avg(bonus) as bonus, {", ".join(f"count(*) filter (where role = '{r}') as n_{r}" for r in R.ROLE_ORDER)}
  from told group by module),
raw as (
  select *, least(1.0, 0.45 * sig_count / nullif((select sum(n_sigs) from told), 0) + 0.10 * file_count / (select count(*) from told) + 0.45 * bonus) as score,
    n_test / file_count as test_ratio, greatest({", ".join(f"n_{r}" for r in R.ROLE_ORDER)}) as most
  from by_module where module <> ''),
scores as (select module, file_count, sig_count, round(score, 4) as core_score, {TIER} as tier, case {VOTE} end as role, round(test_ratio, 6) as test_ratio from raw)"""

ORACLES: dict[str, str] = {}
O = ORACLES
O["module_scores"] = f"with {SCORES} select * from scores"
O["file_roles"] = f"with {FILES} select {role()} as role, {prompt_role()} as prompt_role, {bonus()} as bonus, count(*) as n from files group by all"
O["file_priors"] = f"with {SCORES}, w as (select path, coalesce(core_score, 1.0) as weight from files left join scores using (module)) select path, round(weight / (select sum(weight) from w), 9) as prior from w"
O["module_distribution"] = f"with {SCORES} select row_number() over (order by module) as ord, module, tier, file_count, sig_count from scores"
O["module_bars"] = f"""with {FILES}, n as (select module, count(*) as c from files where module <> '' group by 1), f as (select *, cast(round_even(c / (select max(c) from n) * 30, 0) as int) as k from n)
select module, '  ' || rpad(module, 20, ' ') || ' ' || repeat('█', k) || repeat('░', 30 - k) || ' ' || c as line from f"""
O["tag_frequency"] = f"with {FILES}, t as (select ord, unnest(tags) as tag from files) select tag, count(*) as n, min(ord) as first from t group by 1"
O["tier_histogram"] = f"with {SCORES} select t.tier, count(s.tier) as n from (values ('core'), ('secondary'), ('peripheral')) t(tier) left join scores s on s.tier = t.tier group by 1"
O["top_files"] = f"with {FILES} select path, n_sigs as sig_count, module from files order by n_sigs desc, path limit 5"
TOTALS = "select count(*) as total_files, count(distinct nullif(module, '')) as total_modules, cast(coalesce(sum(n_sigs), 0) as bigint) as total_signatures from"
O["index_totals"] = f"with {FILES} {TOTALS} files"
LANGUAGE = cases([(f"{SUFFIX} = '{e}'", f"'{v}'") for e, v in P.LANGUAGES.items()], "null")
O["primary_language"] = f"with {FILES}, l as (select {LANGUAGE} as lang, ord from files) select lang as primary_lang from l where lang is not null group by 1 order by count(*) desc, min(ord) limit 1"
MONTHS = f"{FILES}, months as (select strftime(day, '%Y-%m') as snapshot_id, count(*) as total_files from files group by 1)"
CELL = "substr('▁▂▃▄▅▆▇█', cast(case when hi > lo then floor((total_files - lo) / (hi - lo) * 7) else 4 end as int) + 1, 1)"
SERIES = f"{MONTHS}, r as (select *, min(total_files) over () as lo, max(total_files) over () as hi from months)"
ENDS = "(select total_files from months order by snapshot_id limit 1) as first, (select total_files from months order by snapshot_id desc limit 1) as last"
O["stats_history"] = f"with {SERIES} select snapshot_id, total_files, {CELL} as cell, {ENDS} from r"
O["sparkline"] = f"with {SERIES} select count(*) as n, case when count(*) >= 2 then string_agg({CELL}, '' order by snapshot_id) else '' end as line, {ENDS} from r"
TAGS = "array_to_string(tags, ',') as tags"
O["search_tags"] = f"with {FILES} select path, len(list_intersect(tags, ['api', 'urgent', 'missing'])) / 3 as score, module, {TAGS} from files where len(list_intersect(tags, ['api', 'urgent', 'missing'])) > 0 order by score desc, path limit 25"
O["search_pattern"] = f"""with {FILES}, {SIGS}, s as (select path, case when contains(lower(path), 'fn_1') then 1.0 when contains(lower(descr), 'fn_1') then 0.7 when path in (select path from sigs where contains(lower(name), 'fn_1')) then 0.5 else 0.0 end as score, module, {TAGS} from files)
select path, cast(score as double) as score, module, tags from s where score > 0 order by score desc, path limit 40"""
O["search_combined"] = f"""with {FILES}, {SIGS}, s as (select path, module, 0.6 * len(list_intersect(tags, ['core-lib', 'high'])) / 2 + 0.4 * case when contains(lower(path), 'routes_1') then 1.0 when contains(lower(descr), 'routes_1') then 0.7 when path in (select path from sigs where contains(lower(name), 'routes_1')) then 0.5 else 0.0 end as score from files)
select path, round(cast(score as double), 6) as score, module from s where score > 0 order by s.score desc, path limit 30"""

EXCLUDED = f"list_filter(list_transform({DIRS}, lambda p: lower(p)), lambda p: p in ({quoted([*P.VIRTUAL_ENVS, *P.EXCLUDED_DIRS])}) or {NORMAL} in ({quoted(P.EXCLUDED_DIRS)}))[1]"


def any_dir(words: list[str]) -> str:
    return f"len(list_filter({DIRS}, lambda p: {NORMAL} in ({quoted(words)}))) > 0"


IS_CODE = f"{LANGUAGE} is not null or lower({NAME}) in ({quoted(P.SOURCE_NAMES)})"
GENERATED = f"regexp_matches(lower({NAME}), '\\.min\\.js$|\\.bundle\\.js$|\\.pb\\.go$|\\.generated\\.|\\.gen\\.|_generated\\.|_pb2\\.py|_pb2_grpc\\.py')"
TESTS = f"(len(list_filter({DIRS}, lambda p: {NORMAL} in ({quoted(P.TEST_DIRS)}) or regexp_matches({NORMAL}, '(tests|specs)$'))) > 0 or regexp_matches(lower({NAME}), '^(test_|spec_)|_test\\.(py|go|rb|dart)$|_spec\\.(py|rb)$|\\.test\\.|\\.spec\\.|test\\.php$'))"
HIDDEN = f"len(list_filter({PARTS}, lambda p: starts_with(p, '.'))) > 0"
ARTIFACT = f"(len(list_filter({PARTS}, lambda p: p in ({quoted(P.ARTIFACT_DIRS)}))) > 0 or {NAME} in ({quoted(P.ARTIFACT_NAMES)}) or ends_with({NAME}, '-viz.html'))"


def classified(ignored: str) -> str:
    kinds = [(ignored, "'excluded'"), (HIDDEN, "'hidden'"), (ARTIFACT, "'runtime_artifact'"), (f"{EXCLUDED} is not null", "'excluded'"), (IS_DOC, "'doc'"), (any_dir(P.FIXTURE_DIRS), "'fixture'"), (f"{SUFFIX} in ('.tf', '.hcl') or {any_dir(P.INFRA_DIRS)}", "'infra'"), (GENERATED, "'generated'"), (TESTS, "'test'"), (f"not ({IS_CODE})", "'ignored'")]
    return cases(kinds, "'source'")


REASON = f"case kind when 'excluded' then case when {SUFFIX} = '.toml' then 'architecture_rules' else coalesce({EXCLUDED}, '') end when 'doc' then 'documentation' when 'infra' then 'infrastructure' when 'ignored' then 'unsupported' when 'source' then '' else kind end"
O["classify_paths"] = f"with {FILES}, k as (select path, {classified(f"{SUFFIX} in ('.toml', '.xyz') or path = 'web/generated' or starts_with(path, 'web/generated/')")} as kind from files) select kind, {REASON} as reason, kind = 'source' as in_architecture, kind = 'test' as in_test_support, count(*) as n from k group by all"
O["manifest"] = f"with {FILES}, k as (select path, coalesce({LANGUAGE}, '') as language, {classified('false')} as kind from files) select * from k where kind not in ('ignored', 'hidden', 'runtime_artifact', 'excluded', 'doc', 'fixture')"
IN_TREE = f"not ({HIDDEN}) and not {ARTIFACT} and not {IS_DOC} and len(list_filter({PARTS}, lambda p: lower(p) in ({quoted([*P.VIRTUAL_ENVS, *P.EXCLUDED_DIRS])}) or {NORMAL} in ({quoted([*P.EXCLUDED_DIRS, *P.FIXTURE_DIRS, *P.INFRA_DIRS, 'docs', *P.TEST_DIRS])}) or regexp_matches({NORMAL}, '(tests|specs)$'))) = 0 and ({SUFFIX} = '' or {classified('false')} = 'source')"
NOISE = f"(len(list_filter({PARTS}, lambda p: lower(p) in ({quoted(P.NOISE_SEGMENTS)}))) > 0 or regexp_matches(lower({NAME}), '\\.(log|pid|tmp|cache|val|pyc|pyo)$') or lower({NAME}) in ('.ds_store', 'thumbs.db'))"
O["visible_paths"] = f"with {FILES} select {IN_TREE} as in_tree, {NOISE} as noise, count(*) as n from files group by all"
O["languages"] = f"with {FILES} select coalesce({LANGUAGE}, '') as language, count(*) as n from files group by all"
O["url_parts"] = f"with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') as path from pages) select page_id, {NAME} as name, {SUFFIX} as suffix, len({PARTS}) as depth from p"
O["known_paths"] = f"with {FILES} select ord, path as found from files where ord % 3 <> 2"

O["token_estimate"] = "select doc_id, greatest(1, length(text) // 4) as tokens, length(text) // 4 as file_tokens, len(string_split(text, chr(10))) as lines, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10 as meaningful from documents"
O["truncate_lines"] = """with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
e as (select doc_id, text, lines, unnest(range(1, len(lines) + 1)) as i from l),
r as (select *, sum(length(lines[i]) + 1) over (partition by doc_id order by i) as used from e),
k as (select doc_id, any_value(text) as text, any_value(lines) as lines, count(*) filter (where used <= 400) as kept from r group by doc_id)
select doc_id, sha256(case when length(text) <= 400 then text else array_to_string(list_append(lines[1:kept], '... (truncated, ' || (len(lines) - kept) || ' lines omitted)'), chr(10)) end) as cut from k"""
O["content_hashes"] = "select doc_id, sha256(text)[1:16] as hash from documents"

OLD_NEW = f"""{FILES}, old as (select * from files where ord % 10 <> 0),
new as (select ord, path, case when ord % 4 = 0 then 'split-' else 'new-' end || module as module, case when ord % 3 = 0 then [tags[1], 'changed'] else tags end as tags, n_sigs from files where ord % 10 <> 1)"""
LIKE = f"""{OLD_NEW}, shared as (select o.module as old_id, n.module as new_id, count(*) as shared from old o join new n using (path) where o.module <> '' group by all),
so as (select module as old_id, count(*) as a from old group by 1), sn as (select module as new_id, count(*) as b from new group by 1),
jac as (select old_id, new_id, shared, shared / (a + b - shared) as jaccard from shared join so using (old_id) join sn using (new_id))"""
# Here no two old modules want the same new one, so the best pair of each is what the choice in order finds.
MATCH = f"{LIKE}, matched as (select old_id, new_id, round(jaccard, 3) as jaccard from (select *, row_number() over (partition by old_id order by jaccard desc, new_id) as r from jac where jaccard >= 0.3) where r = 1)"
CHANGED = "changes as (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' when coalesce(m.new_id, o.module) <> n.module then 'moved' end as change, coalesce(o.module, '') as old_module, coalesce(n.module, '') as new_module from old o full outer join new n on o.path = n.path left join matched m on m.old_id = o.module)"
TAGGED = "tagged as (select o.path, list_sort(list_filter(n.tags, lambda t: not list_contains(o.tags, t))) as added, list_sort(list_filter(o.tags, lambda t: not list_contains(n.tags, t))) as removed from old o join new n using (path))"
MODULES = "mods as (select module, 'removed' as change from (select distinct module from old where module <> '') where module not in (select old_id from matched) union all select module, 'added' from (select distinct module from new) where module not in (select new_id from matched))"
O["diff_files"] = f"with {MATCH}, {CHANGED} select * from changes where change is not null"
O["diff_tags"] = f"with {OLD_NEW}, {TAGGED} select path, array_to_string(added, ',') as added, array_to_string(removed, ',') as removed from tagged where len(added) + len(removed) > 0"
O["module_jaccard"] = f"with {LIKE} select old_id, new_id, shared, round(jaccard, 6) as jaccard from jac"
O["module_matches"] = f"with {MATCH} select * from matched"
O["module_changes"] = f"with {MATCH}, {MODULES} select * from mods"
O["stats_delta"] = f"with {OLD_NEW}, a as ({TOTALS} old), b as ({TOTALS} new) select b.total_files - a.total_files as total_files, b.total_modules - a.total_modules as total_modules, b.total_signatures - a.total_signatures as total_signatures from a, b"
O["change_magnitude"] = f"with {MATCH}, {CHANGED}, {TAGGED}, {MODULES} select (select count(*) from changes where change is not null) + (select count(*) from tagged where len(added) + len(removed) > 0) + (select count(*) from mods) as change_magnitude"


def nodes(source: str, name: str) -> str:
    return f"""{name}_p as (select {PARTS} as parts from {source}), {name}_s as (select parts, unnest(range(0, len(parts) + 1)) as depth from {name}_p),
{name} as (select distinct case when depth = len(parts) then 'file:' else 'dir:' end || case when depth = 0 then '.' else array_to_string(parts[1:depth], '/') end as id,
  case when depth = len(parts) then 'file' else 'dir' end as type, case when depth = 0 then '.' else parts[depth] end as name,
  case when depth = 0 then null when depth = 1 then 'dir:.' else 'dir:' || array_to_string(parts[1:depth - 1], '/') end as parent_id, depth from {name}_s)"""


O["tree_nodes"] = f"with {FILES}, {nodes('files', 'n')} select id, type, name, coalesce(parent_id, '') as parent_id, depth from n"
O["tree_diff"] = f"""with {OLD_NEW}, {nodes('old', 'a')}, {nodes('new', 'b')},
ac as (select parent_id as id, list_sort(list(id)) as kids from a where parent_id is not null group by 1), bc as (select parent_id as id, list_sort(list(id)) as kids from b where parent_id is not null group by 1)
select coalesce(a.id, b.id) as id, coalesce(b.type, a.type) as type, coalesce(b.name, a.name) as name,
  case when b.id is null then 'removed' when a.id is null then 'added' else 'modified' end as change
from a full outer join b on a.id = b.id left join ac on ac.id = a.id left join bc on bc.id = b.id where a.id is null or b.id is null or ac.kids is distinct from bc.kids"""
O["tree_topn"] = f"""with {FILES}, {nodes('files', 'n')}, r as (select *, row_number() over (partition by parent_id, type order by lower(name), name) as nth, greatest(count(*) over (partition by parent_id, type) - 5, 0) as hidden from n where depth <= 2 and parent_id is not null)
select id, type, name, parent_id, depth, nth, hidden from r where nth <= 5"""
O["treemap"] = f"""with {FILES}, p as (select {PARTS} as parts, greatest(n_sigs, 1) as value from files), s as (select parts, value, unnest(range(0, len(parts) + 1)) as depth from p)
select case when depth = len(parts) then 'file:' || array_to_string(parts, '/') when depth = 0 then 'dir:.' else 'dir:' || array_to_string(parts[1:depth], '/') end as id, cast(sum(value) as bigint) as value from s group by 1"""
ROLED = f"{FILES}, roled as (select *, {prompt_role()} as role, {PARTS} as parts from files)"
O["code_areas"] = f"with {ROLED}, a as (select unnest([parts[1], array_to_string(parts[1:2], '/')]) as area from roled where role = 'source' and len(parts) >= 2) select area, count(*) as n from a group by 1 having count(*) >= 2 order by n desc, area desc limit 8"
LOW = f"lower({NAME})"
ENTRY_POINTS = cases([(matches(LOW, "^main\\.(py|ts|js)$"), "4"), (matches(LOW, "^app\\.(py|ts|js)$"), "4"), (matches(LOW, "^server\\.(py|ts|js)$"), "4"), (f"{matches(LOW, '^index\\.(ts|js)$')} and len({PARTS}) <= 2", "3"), (f"contains({LOW}, 'cli')", "3")], "0")
O["project_boundaries"] = f"""with {ROLED}, entries as (select parts[1] as project, min(path) as entry from roled where role <> 'test' and {ENTRY_POINTS} > 0 group by 1),
b as (select parts[1] as project, count(*) filter (where role = 'source') as source_files, count(*) filter (where role = 'test') as test_files, list_sort(list(distinct case when role = 'source' and len(parts) >= 2 then array_to_string(parts[1:2], '/') end)) as areas from roled group by 1)
select project, source_files, test_files, coalesce(entry, '') as entry, array_to_string(list_filter(areas, lambda a: a is not null)[1:2], ',') as core_areas from b left join entries using (project) where source_files > 0 order by coalesce(entry, '') <> '' desc, source_files desc, test_files desc, project desc limit 8"""

COSTED = "costed as (select doc_id, lang, source, greatest(1, length(text) // 4) as cost, round(1 / (1 + doc_id % 97), 6) as score, cast(doc_id % 3 + 1 as int) as tier from documents)"
O["overview_budget"] = f"with {COSTED}, r as (select lang, doc_id, cost, cast(sum(cost) over w as bigint) as used, row_number() over w as nth from costed window w as (partition by lang order by score desc, doc_id)) select * from r where used <= 20000"


def greedy(source: str, budget: str, by: str, key: str) -> str:
    """A walk in order that skips what doesn't fit, for each group."""
    return f"""ordered as (select *, row_number() over (partition by {by} order by {key} desc, doc_id) as i from {source}),
walk as (select {by} as g, cast(0 as bigint) as i, cast(0 as bigint) as used, false as taken, cast(null as bigint) as doc_id, 0 as rank from (select distinct {by} from ordered)
  union all select w.g, o.i, case when w.used + o.cost <= {budget} then w.used + o.cost else w.used end, w.used + o.cost <= {budget}, o.doc_id, case when w.used + o.cost <= {budget} then w.rank + 1 else w.rank end
  from walk w join ordered o on o.{by} = w.g and o.i = w.i + 1)"""


HYBRID = "keyed as (select doc_id, cost, 0 as one, round(0.7 * score + 0.3 * least(score / greatest(cost, 1) / 0.01, 1.0), 9) as key from costed)"
O["trim_greedy"] = f"with recursive {COSTED}, {HYBRID}, {greedy('keyed', '10000', 'one', 'key')} select w.doc_id, k.cost, k.key, w.rank from walk w join keyed k using (doc_id) where taken"
O["tier_budget_select"] = f"with recursive {COSTED}, {greedy('costed', 'case w.g when 1 then 5000 when 2 then 4000 else 1000 end', 'tier', 'score')} select w.doc_id, c.tier, c.cost, w.rank from walk w join costed c using (doc_id) where taken"
O["batch_pack"] = f"""with recursive {COSTED}, q as (select doc_id % 40 as queue, doc_id, cost, row_number() over (partition by doc_id % 40 order by doc_id) as i from costed),
walk as (select queue, doc_id, cost, i, 0 as batch, 1 as n, cost as used from q where i = 1
  union all select q.queue, q.doc_id, q.cost, q.i, case when w.n >= 32 or w.used + q.cost > 8000 then w.batch + 1 else w.batch end, case when w.n >= 32 or w.used + q.cost > 8000 then 1 else w.n + 1 end, case when w.n >= 32 or w.used + q.cost > 8000 then q.cost else w.used + q.cost end
  from walk w join q on q.queue = w.queue and q.i = w.i + 1)
select queue, doc_id, cost, batch from walk"""


def factor(test: str, value: float) -> str:
    return f"(case when {test} then {value} else 1.0 end)"


TESTISH = "contains(lower(path), 'test')"
PROSE = "(ends_with(path, '.md') or ends_with(path, '.txt'))"
HEURISTIC = " * ".join(
    f"cast({x} as double)"
    for x in [
        factor("path = 'src/core/engine_8.py'", 50.0),
        factor("path = 'cli/cli_2.py'", 10.0),
        factor(PROSE, 0.3),
        factor(f"not {PROSE} and (starts_with(path, 'src/') or starts_with(path, 'lib/'))", 2.0),
        factor("contains(path, '/tools/') or starts_with(path, 'tools/')", 2.5),
        factor("ends_with(path, '__init__.py')", 0.5),
        factor(f"not ends_with(path, '__init__.py') and ends_with(path, '.py') and not {TESTISH}", 1.5),
        factor(" or ".join(f"contains(path, '{n}')" for n in rank.CORE_NAMES), 3.0),
        factor(f"{TESTISH} or contains(lower(path), 'spec')", 0.2),
        factor("starts_with(path, 'plans/') or starts_with(path, 'docs/')", 0.4),
    ]
)
O["heuristic_rank"] = f"with {FILES} select path, round({HEURISTIC}, 6) as score from files"
KEY_BONUS = cases([(f"{LOW} = '{k}'", str(v)) for k, v in rank.KEY_FILES.items()], "0")
MARKED = " or ".join(f"contains(lower(path), '{m}')" for m in rank.PATH_MARKS)
SOURCE_SCORE = f"""(case when contains(lower(path), '/src/') or starts_with(lower(path), 'src/') then 6.0 else 0 end + case when {MARKED} then 3.0 else 0 end + {KEY_BONUS} + case when contains({LOW}, 'config') then 2.0 else 0 end
  + coalesce(core_score, 0) * 5.0 + 1.5 + least(n_sigs, 40) * 0.25 - case when contains({LOW}, 'test') or len(list_filter(parts, lambda p: lower(p) in ('tests', 'test', '__tests__'))) > 0 then 12.0 else 0 end)"""
O["source_rank"] = f"with {SCORES}, roled as (select *, {prompt_role()} as role, {PARTS} as parts from files), s as (select path, round(cast({SOURCE_SCORE} as double), 6) as score, n_sigs from roled left join (select module, core_score from scores) using (module) where role = 'source' and not {NOISE}) select * from s where score > 0"
O["test_rank"] = f"with {ROLED} select path, n_sigs from roled where role = 'test' and not {NOISE} and not (contains(lower(path), '/vendor/') or starts_with(lower(path), 'vendor/'))"
O["snippet_tags"] = f"with {SIGS}, r as (select path, name, line, row_number() over (partition by path order by case when name in ('fn_1', 'fn_10') then 0 else 1 end, case when starts_with(name, '_') then 1 else 0 end, line, name) as nth from sigs) select * from r where nth <= 2"
O["symbol_scores"] = f"with {SIGS}, r as (select path, row_number() over (order by name desc, path, line) - 1 as place from sigs) select path, round(sum(pow(0.95, place)), 9) as score from r group by path"
O["rank_cascade"] = f"""with {FILES}, h as (select path, ord, {HEURISTIC.replace("path = 'src/core/engine_8.py'", "false").replace("path = 'cli/cli_2.py'", "false")} as s from files),
first as (select path from (select path from h order by s desc, path limit 50) union select path from h where ord in (1, 2, 3)), f as (select path, round(1 / (1 + ord % 89), 6) as score from h where path in (select path from first))
select path, score, case when score > 0.5 then 1 when score > 0.2 then 2 else 3 end as tier from f order by score desc, path limit 20"""

# Each content names one module twice; its candidate is a file if that key's order exists.
IMPORTS = f"{FILES}, imports as (select f.path as src, g.path as dst, f.module as src_module, g.module as dst_module from files f join files g on g.ord = f.ord - f.ord % 12 + 8 where f.ord <> g.ord)"
O["import_edges"] = f"with {IMPORTS} select src, dst, cast(2 as double) as weight from imports"
EDGES = "edges as (select sn.n_name as src, cn.n_name as dst, 's' || l_suppkey as src_file, 'c' || o_custkey as dst_file, l_linenumber as line from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey)"
TOP10 = f"{EDGES}, pairs as (select distinct src, dst, src_file, dst_file from edges where src <> dst), w as (select src, dst, count(*) as weight from pairs group by all), ranked as (select *, row_number() over (partition by src order by weight desc, dst) as rank from w)"
O["module_deps_top10"] = f"""with {TOP10}, f as (select src, dst, string_agg(src_file || '>' || dst_file, ',' order by nth) as files from (select *, row_number() over (partition by src, dst order by src_file, dst_file) as nth from pairs) where nth <= 5 group by all)
select src, dst, weight, rank, files from ranked join f using (src, dst) where rank <= 10"""
O["module_calls"] = f"with {EDGES}, r as (select src as caller, dst as callee, line, row_number() over (partition by src, dst order by line) as nth from edges where src <> dst) select caller, callee, count(*) as weight, string_agg(line, ',' order by line) filter (where nth <= 5) as lines from r group by all"
O["symbol_tables"] = f"with {SIGS} select name, coalesce(string_agg(distinct path, ',' order by path) filter (where kind = 'A'), '') as definitions, count(*) filter (where kind = 'N') as references from sigs group by name"
O["fan_in"] = f"with {IMPORTS} select dst as path, count(*) as fan_in from imports group by 1"
O["fan_out"] = f"with {TOP10} select src as subject, 'info' as severity, count(*) as n from ranked where rank <= 10 group by src having count(*) >= 6"
SPANS = "ev as (select 'u' || (user_id % 50) as path, event_id, cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as bigint) as line from events)"
O["enclosing_interval"] = f"""with {SPANS}, s as (select path, cast(event_id as varchar) as name, line as start, line + 60 + event_id % 1000 as stop from ev where event_id % 5 = 0),
m as (select e.path, e.event_id, e.line, s.name, row_number() over (partition by e.event_id order by s.start, s.stop desc, s.name) as r from ev e join s on s.path = e.path and e.line between s.start and s.stop where e.event_id % 5 <> 0)
select path, event_id, line, name as enclosing from m where r = 1"""
O["call_edges"] = f"""with {SPANS}, s as (select path, cast(event_id as varchar) as name, line as start, line + 60 + event_id % 1000 as stop from ev where event_id % 5 = 0),
d as (select distinct 'f' || (event_id // 7 % 40) as name, path as def_path from ev where event_id % 5 = 0),
m as (select e.path, e.event_id, e.line, s.name as around, row_number() over (partition by e.event_id order by s.start, s.stop desc, s.name) as r from ev e join s on s.path = e.path and e.line between s.start and s.stop where e.event_id % 5 <> 0),
c as (select path || ':' || around as caller, def_path || ':' || name as callee, line from m join d on d.name = 'f' || (event_id // 7 % 40) where r = 1),
n as (select *, row_number() over (partition by caller, callee order by line) as nth from c where caller <> callee)
select caller, callee, count(*) as weight, string_agg(line, ',' order by line) filter (where nth <= 5) as lines from n group by all"""
O["asof_parent"] = f"""with {SPANS}, c as (select path, event_id, line from ev where event_id % 7 = 0),
m as (select e.event_id, c.event_id as parent, row_number() over (partition by e.event_id order by c.line desc, c.event_id) as r from ev e join c on c.path = e.path and c.line < e.line where e.event_id % 7 <> 0)
select e.event_id as ord, coalesce('n' || m.parent, '') as parent from ev e left join m on m.event_id = e.event_id and m.r = 1"""
O["suffix_join"] = f"""with {FILES} select {NAME} as suffix, path from files
union all select 'core/engine_20.py', path from files where path = 'core/engine_20.py' or ends_with(path, '/core/engine_20.py')"""
O["cross_module_edges"] = f"with {IMPORTS} select src_module, dst_module, src_module <> dst_module as crosses, count(*) as n from imports group by all"
O["reference_edges"] = f"""with {SIGS}, d as (select name, path from sigs where kind = 'A'), r as (select name, path as src, count(*) as n from sigs where kind = 'N' group by all), c as (select name, count(*) as defs from d group by 1)
select src, d.path as dst, round(sum(case when name = 'fn_7' then 10.0::double else 1 end * case when length(name) >= 8 then 10.0::double else 1 end * case when defs > 5 then 0.1::double else 1 end * case when src = 'src/core/engine_8.py' then 50.0::double else 1 end * sqrt(n)), 6) as weight
from r join c using (name) join d using (name) where src <> d.path group by all"""

USERS = "ue as (select src, dst, cast(count(*) as double) as weight from (select user_id as src, lead(user_id) over (order by event_id, user_id) as dst from events) where dst is not null and src <> dst group by all), v as (select distinct user_id as id from events where user_id is not null)"


def ranked(edges: str, start: str, rounds: int = 10) -> str:
    out = f"""{USERS}, g as (select * from ue {edges}), tot as (select src, sum(weight) as total from g group by 1), l as (select src, dst, weight / total as share from g join tot using (src)),
st as (select id, {start} as p, id in (select src from tot) as links from v), r0 as (select id, p, links, p as rank from st)"""
    for i in range(1, rounds + 1):
        out += f""",
r{i} as materialized (select r.id, r.p, r.links, 0.85 * (coalesce(got, 0) + (select coalesce(sum(rank), 0) from r{i - 1} where not links) * r.p) + 0.15 * r.p as rank from r{i - 1} r left join (select dst, sum(rank * share) as got from l join r{i - 1} on id = src group by 1) on dst = r.id)"""
    return out


EVEN, FOCUS = "1.0::double / (select count(*) from v)", "(case when id in (3, 5) then 500.0::double when id = 7 then 100 else 0 end) / 1100"
O["pagerank"] = f"with {ranked('', EVEN)} select id, round(rank, 9) as rank from r10"
O["pagerank_personalized"] = f"with {ranked('', FOCUS)} select id, round(rank, 9) as rank from r10"
O["graph_rank_blend"] = f"with {ranked('', EVEN)} select id, round(0.4 * rank / (select max(rank) from r10) + 0.6 * (1 / (1 + id % 17)), 7) as score from r10"
O["tiered_rank"] = f"with {ranked('', FOCUS)} select id, round(case when id in (3, 5, 7) then 1 when rank > 0.004 then rank else 1 / (1 + id % 17) end, 7) as rank, case when id in (3, 5, 7) then 1 when rank > 0.004 then 2 else 3 end as tier from r10"
O["graph_density"] = f"with {USERS} select (select count(*) from v) as nodes, count(*) as edges, round(count(*) / (select count(*) from v), 6) as density, count(*) / (select count(*) from v) < 0.05 as too_sparse from ue"
O["neighbourhood"] = f"with {USERS}, w as (select dst as id, 1 as way from ue where src = 3 union select src, 2 from ue where dst = 3) select id, case sum(way) when 1 then 'out' when 2 then 'in' else 'both' end as direction, id * 7 % 31 as weight from w where id <> 3 group by id order by weight desc, id limit 19"
O["subgraph"] = f"with {USERS} select * from ue where src % 5 = 0 and dst % 5 = 0"
NATIONS = "ne as (select a.n_name as src, b.n_name as dst from nation a join nation b on b.n_nationkey in ((a.n_nationkey * 2 + 1) % 25, (a.n_nationkey + 5) % 25) where a.n_name <> b.n_name)"
O["cycles_within_three"] = f"""with {NATIONS} select a.src || '>' || a.dst as cycle from ne a join ne b on b.src = a.dst and b.dst = a.src where a.src < a.dst
union all select a.src || '>' || a.dst || '>' || b.dst from ne a join ne b on b.src = a.dst join ne c on c.src = b.dst and c.dst = a.src where a.src < a.dst and a.src < b.dst and b.dst <> a.dst"""

# A depth-first walk, a step a row: take the smallest edge not yet taken from the path's end, go back without one, begin anew with the smallest vertex not seen.
DFS = f"""{NATIONS}, walk as (
  select 0 as i, []::varchar[] as path, []::varchar[] as seen, []::varchar[] as took, null::varchar[] as ring
  union all
  select i + 1, case when root is not null then [root] when step is null then path[:-2] when list_contains(path, step) or list_contains(seen, step) then path else list_append(path, step) end,
    case when root is not null then list_append(seen, root) when step is null or list_contains(seen, step) then seen else list_append(seen, step) end,
    case when step is null then took else list_append(took, path[-1] || '>' || step) end,
    case when step is not null and list_contains(path, step) then path[list_position(path, step):] end
  from (select *, case when len(path) = 0 then (select min(n) from (select src as n from ne union select dst from ne) where not list_contains(seen, n)) end as root,
      case when len(path) > 0 then (select min(dst) from ne where src = path[-1] and not list_contains(took, src || '>' || dst)) end as step from walk)
  where len(path) > 0 or root is not null),
rings as (select distinct array_to_string(list_concat(ring[list_position(ring, list_min(ring)):], ring[:list_position(ring, list_min(ring)) - 1]), '>') as cycle from walk where ring is not null)"""
O["cycles"] = f"with recursive {DFS} select cycle from rings"
O["rule_circular"] = f"with recursive {DFS} select 'circular-dependency' as rule_id, 'warning' as severity, cycle as subject from rings"

RULE_TABLES = f"""{IMPORTS}, {NATIONS}, m as (select n_name as module, ['core', 'secondary', 'peripheral'][n_nationkey % 3 + 1] as tier, case when n_nationkey % 4 = 0 then 'interface' else 'core' end as role, n_nationkey % 5 / 10 as core_score, n_nationkey * n_nationkey as file_count from nation),
rf as (select path, coalesce(n_name, '') as module from files left join nation on n_nationkey = ord % 26), fi as (select dst as path, count(*) as fan_in from imports group by 1),
lv as (select src from ne join m a on a.module = src join m b on b.module = dst where a.tier = 'core' and a.role <> 'interface' and b.tier = 'peripheral'),
si as (select module from m where file_count >= greatest((select median(file_count) from m) * 3, 15))"""
ZOMBIE = f"{SUFFIX} <> '' and {SUFFIX} not in ({quoted(rules.NON_CODE)}) and {NAME} not in ({quoted(rules.RUN_DIRECTLY)}) and not starts_with({NAME}, 'test_') and not ends_with({NAME}, '_test.py')"
O["rule_findings"] = f"""with {RULE_TABLES}
select 'layer-violation' as rule_id, 'critical' as severity, src as subject from lv
union all select 'core-score-anomaly', 'warning', path from fi join rf using (path) join m using (module) where fan_in >= 5 and tier = 'peripheral'
union all select 'high-fan-out', 'info', src from ne group by src having count(*) >= 6
union all select 'orphan-files', 'info', cast(count(*) as varchar) from rf where module = '' having count(*) > 0
union all select 'size-imbalance', 'warning', module from si
union all select 'zombie-code', 'info', cast(count(*) as varchar) from rf left join m using (module) where {ZOMBIE} and path not in (select path from fi) and coalesce(core_score, 0) < 0.1 having count(*) > 0"""
O["architecture_score"] = f"with {RULE_TABLES} select greatest(0, 100 - 20 * (select count(*) from lv) - 5 * (select count(*) from si)) as score"

STEMS = "(values ('thing', 'src/thing.py'), ('er', 'src/er.py'), ('er', 'lib/er.py'), ('reth', 'lib/reth.py'), ('anly', 'docs/anly.md'), ('edti', 'edti'), ('in_at', 'src/in_at.py'), ('onre', 'onre.go')) f(stem, path)"
SAID = f"words as (select distinct conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) as stem from conversations), said as (select conv_id, turn, path from words join {STEMS} using (stem))"
O["mentioned_identifiers"] = f"""with w as (select distinct conv_id, turn, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+')) as ident from conversations)
select ident, count(*) as n from w where regexp_matches(ident, '^([A-Z][a-zA-Z0-9_]*|[a-z_][a-z0-9_]+)$') and (lower(ident) in ('er', 'ondst', 'that') or lower(ident) not in ({quoted(mentions.STOP_WORDS)}) and length(ident) >= 3 and (regexp_matches(ident, '^[A-Z]') or length(ident) > 5)) group by 1"""
O["mentioned_stems"] = f"with {SAID} select conv_id * 1000 + turn as id, path from said"
O["mentioned_files"] = """with w as (select distinct conv_id * 1000 + turn as id, regexp_replace(regexp_replace(unnest(regexp_split_to_array(text, '\\s+')), '[,.!;:?]+$', ''), '^["''`*_]+|["''`*_]+$', '', 'g') as word from conversations)
select id, word as path from w where word in ('er', 'src/er-or', 'a_b', 'thing') union select id, 'src/er-or' from w where word = 'er-or'"""
MEMORY = f"{SAID}, t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations), top as (select conv_id, max(n) as now from t group by 1), mem as (select conv_id, path, pow(0.8, any_value(now) - max(n)) as weight from said join t using (conv_id, turn) join top using (conv_id) group by all)"
O["working_memory"] = f"with {MEMORY} select conv_id, path, round(weight, 6) as weight from mem where weight >= 0.01"
O["active_files"] = f"with {MEMORY} select conv_id, path from mem where round(weight, 6) >= 0.5"
O["context_text"] = "select conv_id, sha256(string_agg(text, chr(10) order by turn)) as text from (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= 3 group by 1"


def hashes(salt: int) -> str:
    return f"select doc_id as path, sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || case when doc_id % {salt} = 0 then 'x' else '' end)[1:16] as hash from documents"


O["phase_delta"] = f"with a as ({hashes(50)} where doc_id % 13 <> 0), b as ({hashes(70)} where doc_id % 11 <> 0) select coalesce(a.path, b.path) as path, case when b.path is null then 'added' when a.path is null then 'removed' when a.hash <> b.hash then 'changed' else 'same' end as change from a full outer join b on a.path = b.path"
O["recompute_plan"] = f"with a as ({hashes(500)}), b as ({hashes(10_000_000)}), d as (select count(*) as files, count(*) filter (where a.hash <> b.hash) as delta from a join b using (path)) select files, delta, 0 as removed, case when delta = 0 then 'reuse' when delta / files < 0.3 and delta < 100 then 'partial' else 'full' end as mode from d"
O["cache_reuse"] = f"with a as ({hashes(50)}), b as ({hashes(70)} where doc_id % 11 <> 0) select a.path, case when b.hash = a.hash then 'cached' else 'new' end as result from a left join b on a.path = b.path"
O["input_hashes"] = """with lines as (select source, sha256(doc_id || '|' || coalesce(lang, '')) as h from documents),
leaves as (select source, h[1:4] || sha256(string_agg(h, chr(10) order by h)) as l from lines group by source, h[1:4])
select coalesce(source, '') as source, sha256(string_agg(l, chr(10) order by l))[1:16] as hash from leaves group by source"""

YEARLY = f"""{FILES}, y0 as (select strftime(day, '%Y') as snapshot_id, module, count(*) as n, cast(sum(n_sigs) as bigint) as sigs from files where module <> '' group by all), y1 as (select *, round(n % 50 / 50, 4) as score, 0.0 as test_ratio from y0 where (n + sigs) % 7 <> 0),
y as (select dense_rank() over (order by snapshot_id) as frame, module, score as core_score, {TIER} as tier, case when sigs % 2 = 0 then 'core' else 'infra' end as role from y1)"""
O["frame_diff"] = f"""with {YEARLY}, a as (select * from y where frame > 1), b as (select frame + 1 as frame, module, core_score, tier, role from y where frame < (select max(frame) from y)),
d as (select coalesce(a.frame, b.frame) as frame, coalesce(a.module, b.module) as module, case when b.module is null then 'added' when a.module is null then 'removed' when abs(a.core_score - b.core_score) > 0.01 or a.tier <> b.tier or a.role <> b.role then 'changed' end as change from a full outer join b on a.frame = b.frame and a.module = b.module)
select * from d where change is not null"""
O["snapshot_refs"] = f"with {MONTHS} select snapshot_id, case when back = 0 then 'latest' else 'latest~' || back end as ref from (select snapshot_id, row_number() over (order by snapshot_id desc) - 1 as back from months)"

DRAWN = f"nm as (select n_name as id, ['core', 'secondary', 'peripheral'][n_nationkey % 3 + 1] as tier, [{quoted(R.ROLE_ORDER)}][length(n_name) % 5 + 1] as role, n_nationkey % 5 / 10 as core_score, n_nationkey * n_nationkey as file_count from nation)"
COLOUR = cases([(f"role = '{r}'", f"'{c}'") for r, c in viz.ROLE_COLOURS.items()], "'#94A3B8'")
O["viz_nodes"] = f"with {DRAWN} select id, id as name, round(28 + sqrt(core_score) * 36, 4) as size, {COLOUR} as colour, 28 + sqrt(core_score) * 36 >= 60 as large, file_count from nm"
O["viz_links"] = f"with {TOP10} select src, dst, weight % 40 as weight, round(least(1 + weight % 40 / 5, 5.0::double), 4) as width, round(least(0.3::double + weight % 40 / 30, 0.8::double), 4) as opacity from ranked where rank <= 10"
TIER_COLOUR = cases([(f"tier = '{r}'", f"'{c}'") for r, c in viz.TIER_COLOURS.items()], "'#D97706'")
O["viz_file_nodes"] = f"with {SCORES} select path as id, 15 + least(2 * n_sigs, 30) as size, {TIER_COLOUR} as colour from files left join scores using (module)"


def at(angle: str, radius: str) -> str:
    return f"round(400 + ({radius}) * cos({angle}), 2) as x, round(300 + ({radius}) * sin({angle}), 2) as y"


CIRCLE = "2 * pi() * i / n - pi() / 2"
O["ring_positions"] = f"with {DRAWN}, r as (select id, row_number() over (order by id) - 1 as i, count(*) over () as n from nm) select id, {at(CIRCLE, '200')} from r"
O["tier_positions"] = f"with {DRAWN}, r as (select id, tier, row_number() over (partition by tier order by id) - 1 as i, count(*) over (partition by tier) as n from nm) select id, {at(CIRCLE, cases([(f"tier = '{t}'", str(v)) for t, v in viz.TIER_RADII.items()], '280'))} from r"
ARC = cases([(f"role = '{r}'", f"{math.radians(a) - math.pi / 2!r} + {math.radians(b - a)!r} * (i + 0.5) / n") for r, (a, b) in viz.ROLE_ARCS.items()], CIRCLE)
O["role_positions"] = f"with {DRAWN}, r as (select id, role, row_number() over (partition by role order by id) - 1 as i, count(*) over (partition by role) as n from nm) select id, {at(ARC, "case when role = 'core' then 80 else 220 end")} from r"
O["extension_pie"] = f"with {FILES} select case when contains({NAME}, '.') then regexp_extract(path, '[^.]*$') else 'none' end as extension, count(*) as n from files group by all"
O["vocabulary_check"] = "with t as (select lower(string_split(p_name, ' ')[1]) as tag from part union select p_brand from part) select tag, case when tag in ('red', 'small') then 'known' when regexp_matches(tag, '^[a-z][a-z0-9-]{0,14}$') then 'new' else 'invalid' end as verdict from t"
O["output_faults"] = "select event_id, case event_id % 4 when 0 then '' when 1 then 'bad tag' when 2 then 'no tags' else 'no desc' end as fault from events"

# Prompts: lines are numbered first, and what fits is a running sum of their costs.
RANKED_SOURCES = f"{SCORES}, roled as (select *, {prompt_role()} as role, {PARTS} as parts from files), s as (select path, round(cast({SOURCE_SCORE} as double), 6) as score, n_sigs, descr from roled left join (select module, core_score from scores) using (module) where role = 'source' and not {NOISE})"
BEST = "row_number() over (order by score desc, n_sigs desc, path desc) as nth"


def fitting(lines: str, budget: int, cap: int) -> str:
    return f"c as (select *, greatest(1, (length(line) + 1) // 4) as cost from {lines} where nth <= {cap}), u as (select *, cast(sum(cost) over (order by nth) as bigint) as used from c) select nth, path, line, cost, used from u where used <= {budget}"


O["key_file_lines"] = f"""with {RANKED_SOURCES}, l as (select path, '- `' || path || '`' || case when descr <> '' then ': ' || descr else '' end || case when n_sigs > 0 then ' (' || n_sigs || ' symbols)' else '' end as line, {BEST} from s where score > 0), {fitting('l', 800, 56)}"""
O["signature_lines"] = f"""with {RANKED_SOURCES}, {SIGS}, g as (select path, string_agg(kind || ' ' || name, ', ' order by nth) as said from (select *, row_number() over (partition by path order by line, name) as nth from sigs) where nth <= 3 group by path),
l as (select path, '- `' || path || '`: ' || said as line, {BEST} from s join g using (path) where score > 0), {fitting('l', 400, 40)}"""
O["key_files"] = f"with {ROLED}, r as (select path, descr as \"desc\", row_number() over (order by ord % 7 / 10 desc, ord) as nth from roled where role = 'source') select * from r where nth <= 24"
DOCUMENT_FILES = "df as (select doc_id as ord, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), doc_id) as path, text as content from documents)"
O["directory_trim"] = f"""with recursive {DOCUMENT_FILES}, f as (select ord, path, string_split(path, '/')[1] as dir, greatest(1, length(content) // 4) as cost, len(string_split(content, chr(10))) as lines from df),
d as (select dir, sum(lines) as dir_lines, min(ord) as dir_first from f group by dir),
ordered as (select path, dir, cost, row_number() over (order by dir_lines desc, dir_first, ord, path) as i from f join d using (dir)),
walk as (select cast(0 as bigint) as i, cast(0 as bigint) as used, false as taken, 0 as rank, '' as path, '' as dir, cast(0 as bigint) as cost
  union all select o.i, case when w.used + o.cost <= 20000 then w.used + o.cost else w.used end, w.used + o.cost <= 20000, case when w.used + o.cost <= 20000 then w.rank + 1 else w.rank end, o.path, o.dir, o.cost from walk w join ordered o on o.i = w.i + 1)
select path, dir, cost, rank from walk where taken"""
CHANGES = f"td as ({O['tree_diff']}), ch as (select *, regexp_replace(id, '^[^:]*:', '') as path from td), sc as (select * from ch where not (path <> '' and {NOISE}))"
O["change_counts"] = f"with {CHANGES} select change, count(*) as n from sc group by change"
O["change_lines"] = f"with {CHANGES}, r as (select '- [' || change || '] ' || name as line, row_number() over (order by id) as nth from sc) select nth, line from r where nth <= 40"
O["tag_report"] = f"with {SIGS}, r as (select *, row_number() over (order by name, path, line) as rank from sigs) select cast(rank as int) as rank, printf('%-6d %-40s %-6d %-30s %-10s', rank, path, line, name, kind) as said from r where rank <= 30"
O["reading_steps"] = """with r as (select r_regionkey + 1 as nth, r_name as project, lower(r_name) as low from region),
every as (select 1 as kind, nth, low || '/main.py' as target, 'Read `' || low || '/main.py` to understand `' || project || '` runtime entry.' as step from r where nth <= 2
  union all select 2, nth, low || '/core', 'Expand `' || low || '/core` for core implementation details.' from r where nth = 1
  union all select 4, nth, low || '/core', 'Expand `' || low || '/core` for dense implementation coverage (~' || nth * 3 || ' source files).' from r where nth <= 2),
once as (select *, row_number() over (partition by target order by kind, nth) as again from every)
select cast(row_number() over (order by kind, nth) as int) as nth, target, step from once where again = 1"""
O["candidate_paths"] = f"with {FILES} select path from files where ord % 4 = 0 union select path from files where ord % 6 = 0 union select module from files where module <> ''"
O["merged_focus"] = f"with {FILES}, m as (select path, min(struct_pack(s := case when ord % 2 = 0 then 0 else 1 end, n := ord)) as spot from files where ord % 2 = 0 or ord % 3 = 0 group by path) select row_number() over (order by spot, path) as place, path from m"
O["local_results"] = f"""with {FILES}, {SIGS}, b as (select path from files where ord % 3 = 0 union select path from sigs)
select starts_with({NAME}, 'cli') as cli, '' as desc, '' as tags, count(*) as n, min(path) as first from b where {classified('false')} = 'source' group by all"""
SNIPPETS = f"""{DOCUMENT_FILES}, tg as (select path, round(1 / (1 + ord % 97), 6) as score, content, unnest([1, 4, 9]) as line from df),
tn as (select *, case when line = 1 then '_' else '' end || 'fn' || line as name from tg),
tr as (select *, row_number() over (partition by path order by case when name = 'fn9' then 0 else 1 end, case when starts_with(name, '_') then 1 else 0 end, line) as nth, string_split(content, chr(10)) as ls from tn),
sh as (select path, score, nth, name, line, ls[greatest(line - 2, 1):line + 9] as sl from tr where nth <= 2 and len(ls) >= greatest(line - 2, 1)),
sw as (select *, array_to_string(sl, chr(10)) as shown from sh where regexp_matches(array_to_string(sl, chr(10)), '[^ \\t\\n\\x0b\\f\\r]')),
ln as (select path, nth, unnest(sl) as l, unnest(range(1, len(sl) + 1)) as i from sw),
ru as (select *, sum(greatest(1, length(l) // 4)) over (partition by path, nth order by i) as run from ln),
ct as (select path, nth, string_agg(l, chr(10) order by i) as cut, cast(max(run) as bigint) as used from ru where run <= 60 group by path, nth),
sn as (select path, score, nth, name, line, case when greatest(1, length(shown) // 4) <= 60 then shown else coalesce(cut, '') end as content, case when greatest(1, length(shown) // 4) <= 60 then greatest(1, length(shown) // 4) else coalesce(used, 0) end as cost from sw left join ct using (path, nth))"""
O["ranked_snippets"] = f"with {SNIPPETS} select path, cast(nth as int) as nth, name, line, sha256(content) as content, cost from sn"
O["packed_snippets"] = f"""with recursive {SNIPPETS}, fl as (select path, score, max(case when nth = 1 then greatest(cost, 1) end) as c1, max(case when nth = 2 then greatest(cost, 1) end) as c2, row_number() over (order by score desc, path) as i from sn group by path, score),
fx as (select path, i, coalesce(c1, c2) as a, case when c1 is not null then c2 end as b, case when c1 is not null then 1 else 2 end as na from fl),
walk as (select cast(0 as bigint) as i, cast(2500 as bigint) as left_, '' as path, 0 as n, 0 as na
  union all select f.i, w.left_ - case when f.a <= w.left_ then f.a + case when f.b <= w.left_ - f.a then f.b else 0 end else 0 end, f.path, case when f.a <= w.left_ then 1 + case when f.b <= w.left_ - f.a then 1 else 0 end else 0 end, f.na
  from walk w join fx f on f.i = w.i + 1),
tk as (select path, i, unnest(range(0, n)) as k, na from walk where n > 0)
select sn.path, cast(sn.nth as int) as nth, name, cost, cast(row_number() over (order by tk.i, tk.k) as int) as place from tk join sn on sn.path = tk.path and sn.nth = tk.na + tk.k"""
O["headers_left"] = f"""with {FILES}, l as (select ord, path, case when ord % 2 = 0 then '## ' when ord % 3 = 0 then '# see ' else '- ' end as mark from files),
k as (select ord, mark || path as line from l where not (mark <> '- ' and (path in ('src/core/engine_8.py', 'cli/cli_2.py') or ends_with(path, '/src/core/engine_8.py') or contains(' ' || path, ' src/core/engine_8.py') or contains(' ' || path, ' cli/cli_2.py') or contains(path, '/engine_20.py'))))
select line[1:4] as mark, count(*) as n, cast(sum(ord) as bigint) as ords from k group by 1"""
O["context_lines"] = f"with {DRAWN} select id as ord, '- ' || id || ' [' || tier || '/' || role || '] files=' || file_count || ' — ' || repeat(id, 20)[1:120] as line from nm"
O["dependency_lines"] = f"with {TOP10} select src, '  ' || src || ' → ' || string_agg(dst, ', ' order by rank) as line from ranked where rank <= 5 group by src"
O["detail_lines"] = f"""with {FILES}, {SIGS}, f as (select ord, path, descr, tags, row_number() over (order by ord) as nth from files), g as (select path, string_agg(name, ', ' order by nth) as names from (select *, row_number() over (partition by path order by line, name) as nth from sigs) where nth <= 5 group by path)
select ord, '- ' || path || ': ' || descr[1:80] || ' [' || array_to_string(tags, ', ') || ']' || coalesce(' sigs: ' || names, '') as line from f left join g using (path) where nth <= 50"""
O["language_hints"] = "with t as (select (repeat('中', cast(doc_id % 400 as int)) || coalesce(text, ''))[1:500] as h from documents) select case when length(regexp_replace(h, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) / greatest(length(h), 1) > 0.3 then 'zh' else 'en' end as hint, count(*) as n from t group by 1"
WORD_LINES = "wl as (select p_brand as dimension, '  ' || p_brand || ': ' || string_agg(distinct p_type, ', ' order by p_type) as line from part group by p_brand)"
O["vocabulary_lines"] = f"with {WORD_LINES} select dimension, line from wl"
O["vocabulary_hash"] = """with v as (select p_brand as dimension, string_agg(distinct '"' || p_type || '"', ', ' order by '"' || p_type || '"') as tags from part group by p_brand)
select sha256('{' || string_agg('"' || dimension || '": [' || tags || ']', ', ' order by dimension) || '}')[1:16] as hash from v"""
# The path kinds as SQL of their own, written out.
KINDS = """count(*) filter (where regexp_matches(low, '\\.(tsx|jsx|vue|svelte|css|scss)$') or contains(low, 'vite.config') or contains(low, 'next.config')) as frontend,
count(*) filter (where regexp_matches(low, '\\.(tf|hcl)$|docker-compose\\.ya?ml$') or contains(low, '/k8s/') or contains(low, '/helm/')) as infra,
count(*) filter (where contains(low, '/server') or contains(low, '/gateway') or contains(low, '/api/') or contains(low, 'http') or contains(low, 'router')) as service,
count(*) filter (where contains(low, '/src/') and not contains(low, '/tests/') and not contains(low, '/test/')) as library"""


def kind_of(paths: str) -> str:
    """Per grp of paths(grp, path): counts and the archetype that they make."""
    return f"""pl as (select grp, path, lower(path) as low, string_split(path, '/') as parts from {paths}),
pt as (select grp, parts[1] as top, count(*) as n, count(*) filter (where regexp_extract(low, '[^/]*$') in ('pyproject.toml', 'package.json', 'go.mod', 'cargo.toml', 'pom.xml', 'build.gradle') or list_contains(list_transform(parts[2:], lambda p: lower(p)), 'src')) as marks from pl group by all),
pk as (select grp, count(*) as files, {KINDS} from pl group by grp),
kinds as (select pk.*, (select count(*) from pt where pt.grp = pk.grp and n >= 8 and marks >= 1) as projects from pk),
told_kinds as (select *, case when projects >= 2 then 'monorepo' when frontend >= 8 then 'frontend' when infra >= 6 then 'infra' when service >= 6 then 'service' when library >= 10 then 'library' else 'generic' end as archetype from kinds)"""


O["repository_kind"] = f"with {FILES}, one as (select 1 as grp, path from files), {kind_of('one')} select files, projects, frontend, infra, service, library, archetype from told_kinds"
NAMES = quoted([r for r, _, _ in C.REPOSITORIES])
REPO_PATH = cases([(f"o_custkey % {len(C.REPOSITORIES)} = {i} and o_orderkey % 5 {sign} 0", "'{}' || o_orderkey || '{}'".format(*shape.split("{k}"))) for i, (_, usual, fifth) in enumerate(C.REPOSITORIES) for sign, shape in (("<>", usual), ("=", fifth))], "null")
REPOS = f"""rp as (select [{NAMES}][o_custkey % {len(C.REPOSITORIES)} + 1] as grp, o_orderkey as ord, {REPO_PATH} as path from orders), {kind_of("rp")},
rm as (select [{NAMES}][n_nationkey % {len(C.REPOSITORIES)} + 1] as grp, n_nationkey as ord, lower(n_name) as name from nation),
rw as (select grp, string_agg('about ' || name || case grp when 'handbook' then ' sdk and parser' when 'tool' then ' a proxy' else '' end, ' ') as said from (select *, row_number() over (partition by grp order by ord) as nth from rm) where nth <= 16 group by grp),
rk as (select grp, case when archetype <> 'generic' then archetype when regexp_matches(coalesce(said, ''), 'gateway|proxy|router|server') then 'service' when regexp_matches(coalesce(said, ''), 'indexing|parser|library|sdk') then 'library' when lower(grp) in ('infra', 'infrastructure', 'ops') then 'infra' else 'generic' end as archetype from told_kinds left join rw using (grp))"""
O["repository_kinds"] = f"with {REPOS} select grp as repo, archetype from rk"
# The names as the archetypes have them, written out.
ENTRY_WHY = """case when name = 'main.py' then 'Main process entry' when name = 'cli.py' then 'Command-line entry'
  when archetype in ('service', 'monorepo') and name = 'api.py' then 'API entry/handler surface' when archetype in ('service', 'monorepo') and name = 'gateway.py' then 'Gateway or edge orchestration'
  when archetype in ('frontend', 'monorepo') and name in ('app.tsx', 'main.tsx') then 'Frontend application entry' when archetype = 'infra' and name = 'main.tf' then 'Infrastructure root module entry' end"""
O["entry_rank"] = f"""with {REPOS}, rf as (select grp as repo, ord, path, []::varchar[] as tags, {PARTS} as parts from rp), rr as (select *, {prompt_role()} as role, {NAME} as name from rf),
rt as (select rr.*, archetype, {ENTRY_WHY} as known from rr join rk on grp = repo where role <> 'test'),
rs as (select *, coalesce(known, case when name = 'app.py' then 'application bootstrap' when contains(lower(name), 'cli') then 'CLI entry point' else '' end) as reason,
  case when known is not null then 5 when name = 'app.py' then 4 when contains(lower(name), 'cli') then 3 else 0 end as points from rt)
select repo, path, reason, round(points * 10 + ord % 7 / 10, 6) as score from rs where points > 0"""
WORDED = cases([*[(f"lower(directory) = '{d}'", f"'{said}'") for d, said in A.DIRECTORIES.items()], *[(f"regexp_matches(lower(directory), '{'|'.join(w.split())}')", f"'{said}'") for w, said in A.DIRECTORY_WORDS]], "'Service component'")
O["directory_descriptions"] = f"with {FILES}, d as (select distinct {PARTS}[1] as directory from files where not ends_with({PARTS}[1], '.md') union all select unnest(['DataLoader', 'my_plots', 'whatever'])) select directory, {WORDED} as desc from d"
O["modules_in_order"] = f"with {RULE_TABLES} select cast(row_number() over (order by case when tier = 'core' then 0 else 1 end, case when contains(lower(module), 'test') or length(module) % 3 = 0 then 1 else 0 end, core_score desc, module) as int) as nth, module, tier, core_score from m"
O["expanded_target"] = f"with {FILES} select 'module' as target, path, module from files where module in ('mod:BUILDING', 'BUILDING') union all select 'path', path, module from files where starts_with(path, 'src/core')"
O["module_report"] = f"""with {DRAWN}, l as (select id as module, '- **' || id || '** [' || tier || '] (score=' || printf('%.2f', core_score) || ', ' || file_count || ' files): about ' || id as line, row_number() over (order by core_score desc, id) as nth from nm),
c as (select *, greatest(1, (length(line) + 1) // 4) as cost from l), u as (select *, cast(sum(cost) over (order by nth) as bigint) as used from c) select nth, module, line, cost, used from u where used <= 150"""
O["probed_languages"] = "select doc_id % 8 as k, ['python', '', 'php', 'python', '', '', 'ruby', 'rust'][doc_id % 8 + 1] as language, [true, true, true, true, false, false, true, true][doc_id % 8 + 1] as is_code, count(*) as n from documents group by all"
