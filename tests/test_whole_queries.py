"""Queries over all of their input: small tables against brute force."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date

import pytest

from gneiss.plans.queries import QUERIES
from gneiss.sources import corpus as C


def path(key):
    return C.SHAPES[key % len(C.SHAPES)].replace("{k}", str(key))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at, r = tmp_path_factory.mktemp("tables"), random.Random(3)

    def put(name, rows, kind):
        spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{at}/{name}.parquet")

    put("orders", [(k, k % 5, "F", "1-URGENT", date(2020, 1, 1)) for k in range(240)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date")
    put("customer", [(k, "BUILDING", f"c{k}") for k in range(5)], "c_custkey long, c_mktsegment string, c_name string")
    put("lineitem", [(k, r.randrange(90), "A", n) for k in range(240) for n in range(3)], "l_orderkey long, l_partkey long, l_returnflag string, l_linenumber int")
    put("events", [(7 * i if i < 1500 else 7 * i + 5000, r.randrange(450)) for i in range(3000)], "event_id long, user_id long")
    return str(at)


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_symbol_scores_take_all_signatures(spark, sf):
    items = [tuple(x) for x in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber").collect()]
    ranked = sorted(sorted((path(k), n, f"fn_{p}") for p, k, n in items), key=lambda x: x[2], reverse=True)
    want = {}
    for place, (p, _, _) in enumerate(ranked):
        want[p] = want.get(p, 0) + 0.95**place
    got = {x["path"]: x["score"] for x in rows(spark, sf, "symbol_scores")}
    assert len(want) == 240 and got == {p: pytest.approx(s, abs=2e-9) for p, s in want.items()}


def test_suffix_join_asks_for_all_names(spark, sf):
    paths = [path(k) for k in range(240)]
    wanted = {p.rsplit("/", 1)[-1] for p in paths} | {"core/engine_20.py"}
    want = sorted((w, p) for w in wanted for p in paths if p == w or p.endswith("/" + w))
    assert sorted((x["suffix"], x["path"]) for x in rows(spark, sf, "suffix_join")) == want and len(want) > 240


def test_graphs_have_all_users_and_all_edges(spark, sf):
    users = [x["user_id"] for x in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect()]
    edges = Counter((a, b) for a, b in zip(users, users[1:]) if a != b)
    got = {(x["src"], x["dst"]): x["weight"] for x in C.user_edges(spark, sf).collect()}
    assert got == dict(edges)
    density = rows(spark, sf, "graph_density")[0]
    assert (density["nodes"], density["edges"]) == (len(set(users)), len(edges)) and len(set(users)) > 200
    few = {(x["src"], x["dst"]): x["weight"] for x in rows(spark, sf, "subgraph")}
    assert few == {(a, b): n for (a, b), n in edges.items() if a % 5 == 0 and b % 5 == 0}
    near = {b for a, b in edges if a == 3} | {a for a, b in edges if b == 3}
    assert {x["id"] for x in rows(spark, sf, "neighbourhood")} == set(sorted(near, key=lambda i: (-(i * 7 % 31), i))[:19])

    def walk(p):
        total = Counter()
        for (a, _), n in edges.items():
            total[a] += n
        rank = dict(p)
        for _ in range(10):
            loose = sum(x for i, x in rank.items() if i not in total)
            new = {i: 0.85 * loose * p[i] + 0.15 * p[i] for i in p}
            for (a, b), n in edges.items():
                new[b] += 0.85 * rank[a] * n / total[a]
            rank = new
        return rank

    even, focus = walk({i: 1 / len(set(users)) for i in users}), walk({i: {3: 500, 5: 500, 7: 100}.get(i, 0) / 1100 for i in users})
    assert {x["id"]: x["rank"] for x in rows(spark, sf, "pagerank")} == {i: pytest.approx(x, abs=2e-9) for i, x in even.items()}
    assert {x["id"]: x["rank"] for x in rows(spark, sf, "pagerank_personalized")} == {i: pytest.approx(x, abs=2e-9) for i, x in focus.items()}
    top = max(even.values())
    assert {x["id"]: x["score"] for x in rows(spark, sf, "graph_rank_blend")} == {i: pytest.approx(0.4 * x / top + 0.6 / (1 + i % 17), abs=2e-7) for i, x in even.items()}
    assert {x["id"]: x["tier"] for x in rows(spark, sf, "tiered_rank")} == {i: 1 if i in (3, 5, 7) else 2 if x > 0.004 else 3 for i, x in focus.items()}


def test_heuristic_rank_keeps_all_files(spark, sf):
    got = {x["path"]: x["score"] for x in rows(spark, sf, "heuristic_rank")}
    assert set(got) == {path(k) for k in range(240)}
    assert got["src/core/engine_8.py"] == 50 * 2 * 1.5 and got["docs/guide/1.md"] == 0.3 * 0.4
