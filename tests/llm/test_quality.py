import random
import re
import weakref

import numpy as np
import pyarrow as pa
from codeloom.llm import quality_classifier as qc
from codeloom.llm import quality_rules as qr
from codeloom.llm import trees
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, EMPTY, LONG, documents, kept_whole
from tests.oracle import connection, same

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(covered)}


@given(st.lists(st.sampled_from(["a", "b", "ü€", "#|", "A!", "\n", "x\x1cy", "\x0b", "c "]), max_size=40).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_base_counts(text):
    assert qr.Text(text.encode()).stats == brute(text)


def test_awkward_rows(spark):
    got = qr.judge(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_words"] == 0 and by[0]["base_failed"] and not by[0]["kept"]
    assert by[3]["n_words"] == 160_000 and by[3]["base_failed"]
    assert qr.judge(documents(spark, EMPTY)).count() == 0
    kept = qr.keep(documents(spark, AWKWARD))
    assert kept_whole(documents(spark, AWKWARD), kept) == sum(r["kept"] for r in got)


def test_order_is_learnt_and_does_not_change_verdicts(spark):
    rules = {"dear": lambda t: t.stats["n_words"] % 2 == 0, "cheap": lambda t: t.stats["n_words"] % 3 == 0, "never": lambda t: False, "unseen": lambda t: False}
    found = qr.by_gain(rules, {"dear": (20, 200.0), "cheap": (13, 39.0), "never": (0, 3.9)})
    assert list(found) == ["cheap", "dear", "never", "unseen"]
    calls = []

    def seen(name):
        def run(t):
            calls.append(name)
            return rules[name](t)

        return run

    texts = [qr.Text(b"w " * n) for n in range(1, 40)]
    for order in (list(rules), list(found), list(found)[::-1]):
        calls.clear()
        verdicts = [qr.first_rejection(t, {name: seen(name) for name in order}) is not None for t in texts]
        assert verdicts == [n % 2 == 0 or n % 3 == 0 for n in range(1, 40)]
        assert len(calls) < 4 * 39
    first = lambda t: t.raw.startswith(b"symbols")
    last = lambda t: not first(t)
    body = " ".join(f"w{j}" for j in range(60))
    # A table sorted by what the rules look for: the sample is of all of it.
    docs = spark.createDataFrame([(i, f"{'symbols' if i < 400 else 'plain'} {body} {i}") for i in range(4000)], "doc_id long, text string").repartitionByRange(4, "doc_id")
    rows = {r["rule"]: r for r in qr.profile(docs, {"first": first, "last": last}, rows=500).collect()}
    assert 350 < rows["first"]["met"] < 650 and 20 < rows["first"]["rejected"] < 90
    assert rows["first"]["rejected"] + rows["last"]["rejected"] == rows["last"]["met"]
    assert list(qr.cascade(docs, {"first": first, "last": last}, 500))[0] == "last"


def test_profile(spark):
    rows = [(i, f"word{i} " * 5 + " ".join(f"w{j}" for j in range(60)) + " ##" * (i % 2 * 40)) for i in range(20)]
    found = {r["rule"]: r for r in qr.profile(documents(spark, rows)).collect()}
    assert found["symbols"]["met"] > 0 and set(found) == set(qr.RULES)
    assert list(qr.cascade(documents(spark, EMPTY))) == list(qr.RULES)


def test_a_batch_holds_the_words_of_one_text_at_a_time(monkeypatch):
    alive, most = weakref.WeakSet(), []

    class Watched(qr.Text):
        def __post_init__(self):
            super().__post_init__()
            alive.add(self)
            most.append(len(alive))

        __hash__ = object.__hash__

    monkeypatch.setattr(qr, "Text", Watched)
    texts = [None, "", *[f"w{i} " * 60 + " ".join(f"x{j}" for j in range(90)) for i in range(30)]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    ((_, stats, failed, by),) = qr.score_batches(iter([batch]), qr.RULES)
    assert max(most) == 1 and len(most) == len(texts)
    assert stats == [brute(t) for t in texts] and failed[:3] == [True, True, False] and by == [None, None] + ["one_word"] * 30


def test_op1_equals_sql(spark):
    from codeloom.llm.queries import oracle_sql, queries

    same(spark, connection(), queries()["op1_quality_rules"], oracle_sql()["op1_quality_rules"])


def test_trees_learn_and_name_paths():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    model = trees.fit(x, y, trees=20)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.99
    for path in trees.paths(model.trees[0]):
        assert all(0 <= c < 3 for c, _, _ in path)
    assert trees.fit(x[:0], y[:0]).probability(x[:2]).tolist() == [0.5, 0.5]
    assert (trees.fit(x, np.ones(400)).probability(x) > 0.9).all()


def test_compiled_column_equals_rules(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "AND!!", "a|b", "###", "word."]) if i % 2 else "clean" + str(rng.randrange(99)) for _ in range(rng.randrange(5, 80)))) for i in range(120)]
    x = np.array([qc.statistics(t.encode()) for _, t in rows])
    y = np.array([float(i % 2 == 0) for i, _ in rows])
    model = qc.fit(x, y)
    assert 0 < len(model.rules) < 80
    margin = np.array([model.bias + sum(w for w, tests in model.rules if all((v[s] <= c) == low for s, low, c in tests)) for v in x])
    expected = dict(zip(range(120), 1 / (1 + np.exp(-margin))))
    got = {r["doc_id"]: r["score"] for r in qc.score(documents(spark, rows), model).collect()}
    assert all(abs(got[i] - expected[i]) < 1e-9 for i in expected)
    assert ((np.array([got[i] for i in range(120)]) >= 0.3) == y).mean() > 0.95


def test_classifier_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0, None), (3, 1, 0), (4, None, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = qc.train(documents(spark, AWKWARD), labels)
    got = qc.score(documents(spark, AWKWARD), model)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == len(AWKWARD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    none = qc.train(documents(spark, EMPTY), labels.limit(0))
    assert none == qc.RuleEnsemble() and qc.score(documents(spark, EMPTY), none).count() == 0
    assert kept_whole(documents(spark, AWKWARD), qc.keep(documents(spark, AWKWARD), none)) == len(AWKWARD)
    assert len(qc.statistics(LONG.encode())) == len(qc.STATISTICS)


def test_held_out_accuracy(spark):
    import zlib

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r["doc_id"]: r for r in qc.score(docs, qc.train(docs, labels)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    test = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert len(test) > 20 and sum(p == q for p, q in test) / len(test) >= 0.95


def test_least_keys_are_those_of_all_however_often_they_repeat(spark):
    from codeloom.llm.common import least_keys
    from pyspark.sql import functions as F

    for repeats in (1, 40):
        ids = spark.range(2_000 * repeats).select((F.col("id") % 2_000).alias("id")).unionByName(spark.createDataFrame([(None,)], "id long"))
        keys = {r[0] for r in least_keys(ids, "id", 300).collect()}
        top = {r[0] for r in ids.dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(300).collect()}
        assert keys == top and least_keys(ids, "id", 300).count() == 300 * repeats
        assert least_keys(ids, "id", 10_000).count() == 2_000 * repeats and least_keys(ids.limit(0), "id", 5).count() == 0


def test_training_reads_one_text_an_id(spark):
    good, bad = "clean words stand here in a row. " * 3, "### ||| %%% !!! " * 3
    rows = [(i % 50, good if i % 2 else bad) for i in range(1000)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 30, "doc_id long, quality int")
    model = qc.train(docs, labels, rows=40)
    assert model == qc.train(docs.orderBy(F.rand(3)), labels.repartition(7), rows=40)
    found = {r["doc_id"]: r["predicted"] for r in qc.score(docs, model).collect()}
    assert all(p == i % 2 for i, p in found.items())


def test_spread_join(spark):
    from codeloom.llm.common import spread_join
    from pyspark.sql import functions as F

    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    values = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    for r, v, c in ((rows, values, counts), (rows.where("k > 0"), values, counts.where("k > 0")), (rows.limit(0), values, counts.limit(0))):
        got = spread_join(r, v, ["k"], c).select("id", "k", "v")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, r.join(v, "k").select("id", "k", "v").collect()))
