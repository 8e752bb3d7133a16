import random
import zlib
from collections import Counter

import pytest
from codeloom.llm import sharding

from tests.llm.frames import AWKWARD, EMPTY, documents


def test_differencing_balances():
    rng = random.Random(1)
    weights = [rng.randrange(9, 5000) for _ in range(2000)]
    bins = [x[0] for x in sharding.difference([[w] for w in weights], 24)]
    sums = Counter()
    for w, b in zip(weights, bins):
        sums[b] += w
    assert max(sums.values()) - min(sums.values()) <= 2 and set(bins) == set(range(24))
    assert sharding.difference([], 24) == [] and sharding.difference([[5]], 3) == [[0]]


def test_differencing_by_hand():
    # 8 7 6 5 4 in two bins: differencing gives 16 and 14.
    bins = sharding.difference([[w] for w in (8, 7, 6, 5, 4)], 2)
    sums = [sum(w for w, b in zip((8, 7, 6, 5, 4), bins) if b[0] == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]


def test_combining_units_keeps_bins_apart():
    rng = random.Random(2)
    units = [[rng.randrange(1000, 1100) for _ in range(6)] for _ in range(9)]
    out = sharding.difference(units, 6)
    assert all(sorted(bins) == list(range(6)) for bins in out)


def check(rows, shards, k=24):
    assert len(shards) == len(rows)
    slots = {}
    for r in shards:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(k))
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in shards) == expected
    where = {}
    for r in shards:
        assert where.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]


@pytest.mark.parametrize("unit, parts", [(50_000, 2000), (7, 3)])
def test_groups_and_slots(spark, monkeypatch, unit, parts):
    monkeypatch.setattr(sharding, "UNIT_GROUPS", unit)
    monkeypatch.setattr(sharding, "UNIT_PARTS", parts)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 5)
    rng = random.Random(3)
    rows = [(i, "copy" * 3 if i % 3 == 0 else "".join(rng.choices("abc é", k=rng.randrange(400)))) for i in range(600)]
    check(rows, sharding.shards(documents(spark, rows)).collect())


def test_repeated_rows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 5)
    rows = [(None, "same")] * 200 + [(7, "same")] * 33 + [(i, f"text {i}") for i in range(100)]
    check(rows, sharding.shards(documents(spark, rows)).collect())


def test_levels_balance_like_differencing_at_once(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(1, 3000) + str(i)) for i in range(1500)]
    spread = lambda sums: max(sums) - min(sums)
    weights = [len(t) + 8 for _, t in rows]
    whole = Counter()
    for w, b in zip(weights, sharding.difference([[w] for w in weights], 24)):
        whole[b[0]] += w
    for unit, parts in ((50_000, 2000), (100, 3)):
        monkeypatch.setattr(sharding, "UNIT_GROUPS", unit)
        monkeypatch.setattr(sharding, "UNIT_PARTS", parts)
        found = sharding.shards(documents(spark, rows)).collect()
        check(rows, found)
        sums = Counter()
        for r in found:
            sums[r["shard"]] += r["size"]
        assert spread(sums.values()) <= spread(whole.values()) + 3000 * (unit < 1500) / 10


def test_awkward_rows(spark):
    check(AWKWARD, sharding.shards(documents(spark, AWKWARD)).collect())
    assert sharding.shards(documents(spark, EMPTY)).count() == 0


def test_balance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = sharding.shards(docs).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], found)
    sums = Counter()
    for r in found:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.001 * sum(sums.values())
