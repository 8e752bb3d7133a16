"""Plans against plain Python on random inputs."""

import random

import pytest
from codeloom.operators import resolve, traverse
from codeloom.plans.explain import ordered_steps
from codeloom.plans.impact import seed_rank
from codeloom.sources import store


def graph(seed, n=9, m=22):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.randrange(4), rng.randrange(2), True) for _ in range(m)]


CALLS = "src_id string, dst_id string, line long, column long, is_resolved boolean"


def bfs(seeds, edges, depth, near, far, allowed=None):
    frontier, visited, met = set(seeds), set(seeds), set()
    for _ in range(depth):
        found = {e for e in edges if e[near] in frontier and (allowed is None or e[far] in allowed)}
        met |= found
        frontier = {e[far] for e in found} - visited
        visited |= frontier
    return {e[far] for e in met}, met


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("cut", [True, False])
def test_search(spark, seed, cut):
    edges = graph(seed)
    df = spark.createDataFrame(edges, CALLS)
    start = spark.createDataFrame([("n0",), ("n1",)], "id string")
    allowed = [f"n{i}" for i in range(0, 9, 2)]
    for depth, some in ((1, None), (3, None), (3, allowed)):
        limit = None if some is None else spark.createDataFrame([(x,) for x in some], "id string")
        got = traverse.search(start, df, "dst_id", "src_id", depth, limit, cut)
        nodes, met = bfs(["n0", "n1"], edges, depth, 1, 0, some)
        assert {r[0] for r in got.nodes.collect()} == nodes
        assert sorted(map(tuple, got.edges.collect())) == sorted(met)


@pytest.mark.parametrize("seed", range(3))
def test_first_callers(spark, seed):
    edges = graph(seed)
    seeds = [("n2", "f", 5, "k", "b"), ("n0", "f", 1, "k", "a")]
    df = spark.createDataFrame(seeds, "id string, file_path string, start_line long, kind string, qualified_name string")
    got = traverse.first_callers(df, spark.createDataFrame(edges, CALLS), 3, seed_rank())
    visited, frontier, expected = {"n0", "n2"}, ["n0", "n2"], []
    for _ in range(3):
        fresh = []
        for target in frontier:
            for e in sorted((e for e in edges if e[1] == target), key=lambda e: (e[2], e[3])):
                if e[0] not in visited:
                    visited.add(e[0])
                    fresh.append(e[0])
                    expected.append((e[0], e[1], e[2], e[3], True))
        frontier = sorted(fresh)
    assert sorted(map(tuple, got.edges.select("src_id", "dst_id", "line", "column", "is_resolved").collect())) == sorted(expected)


@pytest.mark.parametrize("seed", range(2))
def test_call_paths(spark, seed):
    edges = graph(seed, 6, 12)
    got = traverse.call_paths(spark.createDataFrame([("n0",)], "id string"), spark.createDataFrame(edges, CALLS), 3)
    expected = []

    def walk(at, path, trail):
        if len(trail) == 3:
            return
        for e in edges:
            if e[0] == at:
                step = (*trail, (e[2], e[3], e[1]))
                expected.append((len(step), step))
                if e[1] not in path:
                    walk(e[1], path | {e[1]}, step)

    walk("n0", {"n0"}, ())
    assert sorted((r["depth"], tuple(map(tuple, r["trail"]))) for r in got.collect()) == sorted(expected)


def test_dependents_from_each_file(spark):
    edges = [("b", "a", "m", True), ("a", "b", "m", True), ("c", "b", "m", True), ("x", "x", "u", False)]
    files, met = traverse.dependents(spark.createDataFrame([("a",), ("b",), ("x",)], "path string"), spark.createDataFrame(edges, "src_path string, dst_path string, module_name string, is_resolved boolean"), 2)
    assert sorted(r[0] for r in files.collect()) == ["a", "b", "c"] and met.count() == 3


def test_enclosing_scope(spark):
    rng = random.Random(5)
    scopes = []
    for i in range(60):
        start = rng.randrange(1, 200)
        scopes.append((f"f{rng.randrange(2)}", rng.choice(["function", "method", "class"]), f"s{i}", f"q{i}", start, start + rng.choice([0, 1, 3, 30, 150]), rng.randrange(3)))
    sites = [(f"f{rng.randrange(2)}", i, rng.randrange(1, 250)) for i in range(300)]
    got = resolve.enclosing_scopes(spark.createDataFrame(sites, "file_path string, site long, line long"), spark.createDataFrame(scopes, "file_path string, kind string, id string, qualified_name string, start_line long, end_line long, start_column long"))
    expected = {}
    for f, i, line in sites:
        inside = [s for s in scopes if s[0] == f and s[1] != "class" and s[4] <= line <= s[5]]
        if inside:
            expected[(f, i)] = min(inside, key=lambda s: (s[5] - s[4], -s[4], s[6], s[2]))[2]
    assert {(r["file_path"], r["site"]): r["src_id"] for r in got.collect()} == expected


def test_ordered_steps(spark):
    rows = [("m", i, "assignment", i + 1, f"a{i}") for i in range(20)] + [("m", 0, "return", 30, "late"), ("m", 2, "assignment", 1, "a0")]
    got = ordered_steps(spark.createDataFrame(rows, "k string, seq long, source string, line long, label string"), ("k",)).orderBy("order").collect()
    assert len(got) == 16 and got[-1]["label"] == "late" and got[0]["label"] == "a0" and got[1]["label"] == "a1"


def test_upsert_and_last(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v long")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert store.last_by_key(old.unionByName(new), ["k"], ["v"]).where("k = 'b'").first()["v"] == 3
