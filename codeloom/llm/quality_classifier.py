"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Boosted trees over text statistics are fitted to a bounded sample of labelled documents.
Every path from a root is a conjunctive rule; a logistic regression with an L1 penalty
over all of them keeps a few with weights. The score of a document is one column
expression over its statistics: 1 / (1 + exp(-(bias + sum of the weights of true rules))).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import trees
from codeloom.llm.common import free_prefix, least_keys, over_texts, prepare, quoted
from codeloom.llm.quality_rules import Text, capital_words, lettered_words

#: Labelled documents that training reads at most: those of the least hashed ids.
TRAIN_ROWS = 6000
#: A document with at least this score is of quality.
THRESHOLD = 0.3
#: Weight of the L1 penalty, and of rules below which they go.
PENALTY, LEAST_WEIGHT = 0.002, 1e-3

#: What columns of statistics start with, unless the documents have such columns.
PREFIX = "__stat_"
STATISTICS = ("log_words", "mean_word", "symbol_rate", "pipe_rate", "capital_rate", "exclaim_rate", "dup_line_rate", "repeat_rate", "letter_rate", "digit_rate", "line_words", "distinct_rate", "top_word_rate", "stop_line_rate", "log_longest")


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one whole text, none of which knows its language or source."""
    t = Text(text or b"")
    n = max(1, len(t.words))
    raw, lines = t.raw, max(1, len(t.lines))
    counts = Counter(t.words)
    return [
        float(np.log1p(len(t.words))),
        t.stats["word_chars"] / n,
        t.stats["n_symbols"] / n,
        raw.count(b"|") / n,
        capital_words(t.words) / n,
        raw.count(b"!") / n,
        t.stats["n_dup_lines"] / lines,
        t.stats["n_repeat_words"] / n,
        lettered_words(t.words) / n,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / max(1, len(raw)),
        len(t.words) / lines,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(x.rstrip()[-1:] in b".!?" for x in t.lines) / lines,
        float(np.log1p(max(map(len, t.words), default=0))),
    ]


def _named(prefix: str) -> list[str]:
    return [f"{prefix}{s}" for s in STATISTICS]


def with_statistics(docs: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """All columns of docs and the statistics of its text."""
    prepare(docs.sparkSession)
    names = _named(prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(x) for x in batch.column("text").cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found.T)], [*batch.schema.names, *names])

    return over_texts(docs, run, tuple(T.StructField(n, T.DoubleType()) for n in names))


@dataclass(frozen=True)
class RuleEnsemble:
    """rules: (weight, tests), a test being (statistic, at most, cut)."""

    bias: float = 0.0
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...] = ()

    def column(self, prefix: str = PREFIX) -> Column:
        """The score as a column expression over the statistics."""
        margin = F.lit(self.bias)
        for weight, tests in self.rules:
            holds = F.lit(True)
            for s, low, cut in tests:
                at = F.col(f"{prefix}{STATISTICS[s]}")
                holds = holds & (at <= cut if low else at > cut)
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _holds(tests: tuple[tuple[int, bool, float], ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, low, cut in tests:
        out &= (x[:, s] <= cut) == low
    return out


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 20, depth: int = 3, penalty: float = PENALTY, rounds: int = 400) -> RuleEnsemble:
    """Trees, their paths as rules, and L1 logistic weights by accelerated proximal steps."""
    model = trees.fit(x, y, trees=n_trees, depth=depth)
    rules = list(dict.fromkeys(p for t in model.trees for p in trees.paths(t)))
    if not rules:
        return RuleEnsemble(model.bias)
    a = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float64)
    _, once = np.unique(a, axis=1, return_index=True)  # rules that hold for the same rows are one
    rules = [rules[i] for i in sorted(once)]
    a = a[:, sorted(once)]
    a1 = np.concatenate([a, np.ones((len(y), 1))], axis=1)
    v = np.ones(a1.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = a1.T @ (a1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / max(1e-9, float(np.linalg.norm(a1 @ v) ** 2) * 1.1)
    w = np.zeros(a1.shape[1])
    w[-1] = model.bias
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a1 @ z, -30, 30)))
        new = z - step * (a1.T @ (p - y) / len(y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / after * (new - w)
        w, t = new, after
    return RuleEnsemble(float(w[-1]), tuple((float(c), r) for c, r in zip(w[:-1], rules) if abs(c) >= LEAST_WEIGHT))


def held_out(doc_id: Column) -> Column:
    """Documents of the test fold: crc32 of the id as text divides by five. Null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Learn from labels(doc_id, quality) outside the test fold, at most rows documents: those
    of the least hashed ids.

    Null labels and ids don't count; of several labels of a document the majority does, ties
    are quality; of several texts of an id the one with the least statistics does. Without
    labelled documents every score is one half.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).dropna().where(~held_out(F.col("id")))
    votes = least_keys(known, "id", rows).groupBy("id").agg((F.avg("quality") >= 0.5).cast("int").alias("__quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One row a chosen id at most, so the broadcast is bounded whatever the tables hold.
    found = with_statistics(texts.join(F.broadcast(votes), F.col("doc_id") == F.col("id")).select("doc_id", "text", "__quality"))
    # Of rows with one id the least statistics count, so at most one row an id reaches the driver.
    once = found.groupBy("doc_id").agg(F.min(F.struct(*_named(PREFIX), "__quality")).alias("row")).select("doc_id", "row.*")
    got = sorted(tuple(r) for r in once.collect())
    x = np.array([r[1:-1] for r in got], np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r[-1] for r in got], np.float64))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, score, predicted).

    Null and empty texts have all statistics zero and are scored like any. Row for row:
    repeated rows and null ids stay; an empty table gives an empty one; other columns are
    ignored.
    """
    found = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    scored = found.select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns and values.

    Null and empty texts are scored like any; repeated rows and null ids stay or go each for
    itself; an empty table gives an empty one; no column's name or value is touched.
    """
    prefix = free_prefix(docs, PREFIX)
    found = with_statistics(docs, prefix)
    return found.where(model.column(prefix) >= threshold).select(*[F.col(quoted(c)) for c in docs.columns])
