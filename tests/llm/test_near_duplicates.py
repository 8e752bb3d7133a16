import random

import numpy as np
import pytest
import xxhash
from codeloom.llm import simhash
from codeloom.llm.components import connected_components
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, EMPTY, documents, kept_whole


def slow_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.lists(st.sampled_from(["Aa", "b", "Ü", "c\x1cd", "\n", "e\x85", "F."]), max_size=20).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def labels(fps, tau=4):
    fps = np.array(sorted(set(fps)), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= tau
    out = np.arange(len(fps))
    while True:
        new = np.array([out[n].min() for n in near])
        if (new == out).all():
            return {int(f): int(i) for f, i in zip(fps, out)}
        out = new


def fingerprints(n, seed):
    """Random values, chains of near ones, and a dense crowd."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for base in out[:20]:
        x = base
        for _ in range(5):
            for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                x ^= 1 << b
            out.append(x)
    center = rng.getrandbits(64)
    out += [center ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(60)]
    return sorted(set(out))


@pytest.mark.parametrize("crowd", [128, 2])
def test_links_connect_what_is_near(spark, crowd):
    fps = fingerprints(150, 7)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in connected_components(simhash.links(df, crowd)).collect()}
    expected = labels(fps)
    groups = {}
    for f, i in expected.items():
        groups.setdefault(i, set()).add(f)
    for members in groups.values():
        found = {roots.get(m, ("alone", m)) for m in members}
        assert len(found) == 1
    assert len({roots.get(f, ("alone", f)) for f in fps}) == len(groups)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40) - 20, rng.randrange(40) - 20) for _ in range(30)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_hub_of_most_edges(spark):
    """More than a thousand edges of one node, which spread_join takes for hot."""
    edges = [(0, i) for i in range(1, 3000)] + [(i, -i) for i in range(1, 3000, 7)] + [(i, i + 1) for i in range(5000, 5040)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    hub = set(range(3000)) | {-i for i in range(1, 3000, 7)}
    assert got == {x: min(hub) for x in hub} | {x: 5000 for x in range(5000, 5041)}


@pytest.mark.parametrize("hub", [-1, 1500, 10**6])
def test_hubs_of_either_end(spark, hub):
    """Least, in the middle and greatest of more than a thousand neighbours, which meet further ones."""
    rng = random.Random(hub)
    edges = [(hub, i) for i in range(3000) if i != hub] + [(i, i + 5000) for i in range(0, 3000, 3)] + [(i + 5000, 20_000 - i) for i in range(0, 3000, 9)]
    edges += [(rng.randrange(30_000, 30_060), rng.randrange(30_000, 30_060)) for _ in range(50)]
    edges = [rng.choice([(u, v), (v, u)]) for u, v in edges] + edges[:500]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    around = {}
    for u, v in edges:
        if u != v:
            around.setdefault(u, set()).add(v)
            around.setdefault(v, set()).add(u)
    roots = {}
    for start in sorted(around):
        left = [] if start in roots else [start]
        while left:
            x = left.pop()
            if x not in roots:
                roots[x] = start
                left += around[x]
    assert got == roots


def stages(spark, run):
    """Stages that run() has had run; the driver keeps a record of each of their tasks."""
    sc = spark.sparkContext
    group = f"stages-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    ids = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum((info := tracker.getStageInfo(s)) is not None and info.numCompletedTasks > 0 for s in ids)


def test_few_stages(spark):
    """The driver's memory grows with them: no round runs a star again to count or spread it."""
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3]))) for _ in range(1500)}
    edges = simhash.checkpointed(simhash.links(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long"), 8))
    assert stages(spark, lambda: connected_components(edges).count()) <= 45


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fp"] == by[1]["fp"] == by[2]["fp"] == 0 and by[2]["component_id"] == 0
    assert by[5]["component_id"] == 4
    kept = simhash.deduplicate(docs)
    assert kept_whole(docs, kept) == 6
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 3, 4, 6, 7]
    assert kept.where("doc_id is null").count() == 1  # the unnamed text is alone in its component
    assert simhash.near_duplicates(documents(spark, EMPTY)).count() == simhash.deduplicate(documents(spark, EMPTY)).count() == 0
    twice = simhash.deduplicate(documents(spark, [(1, "a b c d"), (1, "a b c d"), (1, "e f g h i")]))
    assert sorted(r["text"] for r in twice.collect()) == ["a b c d", "e f g h i"]


def test_a_crowd_is_linked_whole(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    near = {center ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3]))) for _ in range(700)}
    # Some are only reached over others.
    for x in list(near)[:40]:
        near.add(x ^ sum(1 << b for b in rng.sample(range(64), 4)))
    fps = sorted(near | {rng.getrandbits(64) for _ in range(50)})
    expected = labels(fps)
    for crowd in (8, 10_000):
        edges = simhash.links(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long"), crowd)
        roots = {r["node"] % (1 << 64): r["root"] for r in connected_components(edges).collect()}
        groups = {}
        for f, i in expected.items():
            groups.setdefault(i, set()).add(roots.get(f, ("alone", f)))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    expected = labels([r["fp"] % (1 << 64) for r in rows])
    least = {}
    for r in rows:
        g = expected[r["fp"] % (1 << 64)]
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least[expected[r["fp"] % (1 << 64)]] for r in rows)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["fp"] % (1 << 64) == slow_fingerprint(text[r["doc_id"]]) for r in rows[:40])
    kept = simhash.deduplicate(docs.withColumn("extra", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
