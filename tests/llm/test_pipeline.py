"""The pipeline's rows against its rules applied by hand."""

import corpus_pipeline
from codeloom.llm import decontam, quality_rules
from codeloom.llm import quality_classifier as qc

from tests.llm.frames import AWKWARD, EMPTY, documents, kept_whole
from tests.llm.test_near_duplicates import labels, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in qc.score(docs, qc.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]]]
    passed = []
    for i, text in left:
        t = quality_rules.Text(text.encode())
        if not quality_rules.base_failed(t.stats) and not any(rule(t) for rule in quality_rules.RULES.values()):
            passed.append((i, text))
    prints = {i: slow_fingerprint(t) for i, t in passed}
    groups, least = labels(prints.values()), {}
    for i, f in prints.items():
        least[groups[f]] = min(i, least.get(groups[f], i))
    bench = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = dict(passed)

    def leaks(text):
        words = " ".join(decontam.words_of(text))
        return any(" ".join(b) in words for b in bench)

    expected = {i for i in least.values() if not leaks(texts[i])}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == expected and len(rows) == len(expected) > 50


def test_stages_keep_columns_and_take_awkward_rows(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for rows in (AWKWARD, EMPTY):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = documents(spark, rows)
            out = stage(spark, docs, SF)
            assert kept_whole(docs, out) <= len(rows), name
        assert corpus_pipeline.STAGES[-1][1](spark, documents(spark, rows), SF).count() == len(rows)


def test_registered(spark):
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
