"""Quality rules as a short-circuit cascade.

Base counts are made for every document. Documents that the base rule lets through go
through further rules, one after another, until one rejects. Their order is learnt: a
random sample of the whole table meets all rules, which gives each rule's cost (seconds a
document) and selectivity (part rejected); all documents then meet them by rejections per
second, falling, in one order everywhere. A verdict is a conjunction, so it doesn't depend
on the order.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import over_texts, prepare

#: Documents that meet all rules first, about: a random sample of the whole table.
SAMPLE_ROWS = 2000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def window_repeats(words: list[bytes], size: int = 3) -> int:
    """Words in windows of size words that occur twice or more, the first included."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key = ids[: n - size + 1]
    for j in range(1, size):
        key = np.unique(key * len(seen) + ids[j : n - size + 1 + j], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


@dataclass
class Text:
    """A document's text, and what several rules need of it, made once when first asked for."""

    raw: bytes
    words: list[bytes] = field(init=False)
    stats: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        raw = self.raw
        self.words = raw.split()
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        joined = b"".join(self.words)
        self.stats = {
            "n_words": len(self.words),
            "word_chars": len(joined.decode("utf-8", "replace")),
            "n_symbols": len(joined) - len(joined.translate(None, b"#*$%&|<>")),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": window_repeats(self.words),
        }
        self.lines = lines


def base_failed(stats: dict[str, int]) -> bool:
    return stats["n_words"] < 50 or 100 * stats["n_repeat_words"] > 50 * stats["n_words"]


def _mean_word(t: Text) -> bool:
    """Mean word length of 2 to 15 characters."""
    return not 2 * t.stats["n_words"] <= t.stats["word_chars"] <= 15 * t.stats["n_words"]


def _symbols(t: Text) -> bool:
    """At most one symbol of a set of eight for ten words."""
    return 10 * t.stats["n_symbols"] > t.stats["n_words"]


def _dup_lines(t: Text) -> bool:
    """At most half of the lines repeat an earlier one."""
    return 2 * t.stats["n_dup_lines"] > len(t.lines)


def _shouting(t: Text) -> bool:
    """At most three words of ten are all capitals, two letters at least."""
    return 10 * capital_words(t.words) > 3 * len(t.words)


def capital_words(words: list[bytes]) -> int:
    return sum([len(w) > 1 for w in filter(bytes.isupper, words)])


def _one_word(t: Text) -> bool:
    """No word makes up over three tenths of the text."""
    return bool(t.words) and 10 * max(Counter(t.words).values()) > 3 * len(t.words)


def _lettered(t: Text) -> bool:
    """Six words of ten at least have a letter."""
    return 10 * lettered_words(t.words) < 6 * len(t.words)


_NO_LETTERS = bytes(c for c in range(128) if c != 32 and not chr(c).isalpha())


def lettered_words(words: list[bytes]) -> int:
    """Words with an ASCII letter or a character beyond ASCII."""
    return len(b" ".join(words).translate(None, _NO_LETTERS).split())


def _bullets(t: Text) -> bool:
    """At most nine lines of ten start with a bullet."""
    return 10 * sum(x.lstrip()[:1] in (b"-", b"*") or x.lstrip()[:3] == "•".encode() for x in t.lines) > 9 * len(t.lines)


#: A rule says whether it rejects a text.
RULES: dict[str, Callable[[Text], bool]] = {
    "mean_word": _mean_word,
    "symbols": _symbols,
    "dup_lines": _dup_lines,
    "shouting": _shouting,
    "one_word": _one_word,
    "lettered": _lettered,
    "bullets": _bullets,
}


Rules = dict[str, Callable[[Text], bool]]


def first_rejection(text: Text, rules: Rules) -> str | None:
    """The name of the first rule that rejects the text; those after it are never run."""
    return next((name for name, rule in rules.items() if rule(text)), None)


def profile(docs: DataFrame, rules: Rules | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """What a random sample of about rows documents of the whole table says of each rule:
    (rule, met, rejected, seconds). Documents that fail the base rule aren't met."""
    prepare(docs.sparkSession)
    use = RULES if rules is None else rules
    texts = docs.select(F.col("text").cast("string"))
    share = rows / max(1, docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, rejected, seconds = 0, Counter(), Counter()
        for batch in batches:
            for x in batch.column("text").cast(pa.binary()).to_pylist():
                if base_failed((t := Text(x or b"")).stats):
                    continue
                met += 1
                for name, rule in use.items():
                    began = time.perf_counter()
                    rejected[name] += rule(t)
                    seconds[name] += time.perf_counter() - began
        names = list(use)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([met] * len(names), pa.int64()), pa.array([rejected[n] for n in names], pa.int64()), pa.array([float(seconds[n]) for n in names], pa.float64())], ["rule", "met", "rejected", "seconds"])

    found = (texts.sample(share, seed=1) if share < 1 else texts).mapInArrow(run, "rule string, met long, rejected long, seconds double")
    return found.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("met", "rejected", "seconds")])


def by_gain(rules: Rules, profiled: dict[str, tuple[int, float]]) -> Rules:
    """Rules by rejections per second, falling; those that never rejected by cheapness, after the others.

    profiled: of each rule the rejections and seconds on the sample; without any, the order stays."""
    gain = lambda name: (profiled[name][0] + 1e-3) / max(profiled[name][1], 1e-9) if name in profiled else 0.0
    return {name: rules[name] for name in sorted(rules, key=gain, reverse=True)}


def cascade(docs: DataFrame, rules: Rules | None = None, sample: int = SAMPLE_ROWS) -> Rules:
    """The rules in the order that a sample of docs gives them."""
    use = RULES if rules is None else rules
    return by_gain(use, {r["rule"]: (r["rejected"], r["seconds"]) for r in profile(docs, use, sample).collect()})


def score_batches(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[tuple[pa.RecordBatch, list[dict[str, int]], list[bool], list[str | None]]]:
    """Of each batch the counts, what the base rule says and the first rejection. The words of
    one text live at a time, never those of a batch."""

    def verdict(x: pa.Scalar) -> tuple[dict[str, int], bool, str | None]:
        t = Text(x.as_py() or b"")
        failed = base_failed(t.stats)
        return t.stats, failed, None if failed else first_rejection(t, rules)

    for batch in batches:
        found = [verdict(x) for x in batch.column("text").cast(pa.binary())]
        yield batch, [s for s, _, _ in found], [f for _, f, _ in found], [by for _, _, by in found]


def judge(docs: DataFrame, rules: Rules | None = None, sample: int = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    Null and empty texts have no words and fail the base rule. Row for row: repeated rows
    and null ids stay; an empty table gives an empty one; other columns are ignored. A
    text's memory is a small multiple of its length.
    """
    prepare(docs.sparkSession)
    use = cascade(docs, rules, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stats, failed, by in score_batches(batches, use):
            kept = [not f and r is None for f, r in zip(failed, by)]
            counts = [pa.array([s[k] for s in stats], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], ["doc_id", *BASE, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def keep(docs: DataFrame, rules: Rules | None = None, sample: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns and values.

    Null and empty texts go; repeated rows and null ids stay or go each for itself; an empty
    table gives an empty one; no column's name or value is touched.
    """
    prepare(docs.sparkSession)
    use = cascade(docs, rules, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, failed, by in score_batches(batches, use):
            yield batch.filter(pa.array([not f and r is None for f, r in zip(failed, by)], pa.bool_()))

    return over_texts(docs, run)
