"""URL filters: longest matching rule, else boosted trees on lexical features.

Rules are written host/path with an optional subdomain and path; they are few and become
one column expression. URLs that no rule judges go to gradient-boosted trees over lexical
features: lengths, depth, digit ratio, entropy, parameter counts, and smoothed statistics
of host suffixes, all fitted to a bounded sample of labelled URLs.

A suffix's statistics, as trees see them while they are fitted, leave out the URL's whole
host. So no host's own label reaches its features: trees have to split on what hosts have
in common, and judge hosts that no label names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import trees
from codeloom.llm.common import least_keys, prepare

#: Rules by default: verdict by host and path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words that mark a host as unwanted where URLs come without labels.
HOST_TERMS = ("ad", "adult", "advert", "advertising", "banner", "bet", "bonus", "casino", "cheap", "click", "crack", "farm", "free", "gamble", "jackpot", "loan", "lottery", "pills", "poker", "porn", "prize", "replica", "spam", "torrent", "track", "tracker", "tracking", "viagra", "warez", "win", "xxx")
#: Labelled URLs that training reads at most: those of the least hash.
TRAIN_ROWS = 20_000
#: Labels of the suffixes with statistics, and features without those.
SUFFIXES, LEXICAL = (1, 2, 3), 17


def host_column(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; without ://, empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_column(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null; of equally long ones the first in their order."""
    out = F.lit(None).cast("string")
    order = list(rules)
    for rule in sorted(rules, key=lambda r: (len(r), -order.index(r))):
        own, slash, under = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + under)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * np.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str) -> list[float]:
    """Features of the characters of a URL; suffix statistics come on top."""
    host = host_of(url)
    tail = url.partition("://")[2][len(host) :]
    path, _, query = tail.partition("#")[0].partition("?")
    labels = host.split(".") if host else []
    return [
        float(len(url)),
        float(len(host)),
        float(len(path)),
        float(path.count("/")),
        float(len(labels)),
        float(max(map(len, labels), default=0)),
        sum(c.isdigit() for c in url) / max(1, len(url)),
        sum(c.isdigit() for c in host) / max(1, len(host)),
        float(host.count("-")),
        float(host.count("-") > 0 and max(map(len, labels)) or 0),
        entropy(host),
        entropy(path),
        float(len([p for p in query.split("&") if p])),
        float(len(query)),
        float("#" in tail),
        float(url[:8].lower() == "https://"),
        sum(c in "aeiou" for c in host) / max(1, len(host)),
    ]


def host_of(url: str) -> str:
    """host_column() of one URL."""
    rest = url.partition("://")[2]
    for c in "/?#":
        rest = rest.partition(c)[0]
    return rest.lower()


def suffixes(host: str) -> list[str]:
    """The last one, two and three labels of a host."""
    labels = host.split(".")
    return [".".join(labels[-n:]) if n <= len(labels) else "" for n in SUFFIXES]


@dataclass
class UrlModel:
    """Trees, and of each suffix the labelled and the unwanted URLs."""

    model: trees.Boosted
    counts: dict[str, tuple[int, int]]
    rate: float

    def features(self, urls: list[str], own: dict[str, tuple[int, int]] | None = None, lexical_only: bool = False) -> np.ndarray:
        """own: labelled and unwanted URLs of each host, taken out of its suffixes' statistics."""
        out = []
        for url in urls:
            row, host = lexical(url), host_of(url)
            less, less_bad = own[host] if own is not None else (0, 0)
            for s in () if lexical_only else suffixes(host):
                n, bad = self.counts.get(s, (0, 0))
                n, bad = n - less, bad - less_bad
                row += [(bad + 5 * self.rate) / (n + 5), float(np.log1p(n))]
            out.append(row)
        return np.array(out, np.float64).reshape(len(out), LEXICAL + (0 if lexical_only else 2 * len(SUFFIXES)))

    def probability(self, urls: list[str]) -> np.ndarray:
        """That each URL is unwanted."""
        return self.model.probability(self.features(urls))


def fit(urls: list[str], unwanted: list[int]) -> UrlModel:
    counts: dict[str, tuple[int, int]] = {}
    own: dict[str, tuple[int, int]] = {}
    for url, y in zip(urls, unwanted):
        host = host_of(url)
        n, bad = own.get(host, (0, 0))
        own[host] = (n + 1, bad + y)
        for s in suffixes(host):
            n, bad = counts.get(s, (0, 0))
            counts[s] = (n + 1, bad + y)
    model = UrlModel(trees.Boosted(), counts, sum(unwanted) / max(1, len(unwanted)))
    x = model.features(urls, own)
    model.model = trees.fit(x, np.array(unwanted, np.float64), trees=60, depth=3, rate=0.2, share=0.4)
    return model


def weak_labels(pages: DataFrame, terms: tuple[str, ...] = HOST_TERMS) -> DataFrame:
    """pages(url) -> (url, unwanted), 1 where a part of the host between dots and dashes is a term or its plural."""
    parts = F.split(host_column(F.col("url")), "[.-]")
    marked = F.arrays_overlap(parts, F.array(*[F.lit(t + end) for t in terms for end in ("", "s", "es")]))
    return pages.where("url is not null").select(F.col("url").cast("string"), marked.cast("int").alias("unwanted"))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> UrlModel:
    """labelled(url, unwanted): fitted to at most rows distinct URLs, those of the least hashes.

    Null URLs or labels don't count; of several labels of a URL the majority does.
    """
    known = labelled.select("url", F.col("unwanted").cast("int")).dropna()
    votes = least_keys(known, "url", rows).groupBy("url").agg((F.avg("unwanted") > 0.5).cast("int").alias("unwanted"))
    got = sorted((r[0], r[1]) for r in votes.collect())
    return fit([u for u, _ in got], [y for _, y in got])


def judge(pages: DataFrame, model: UrlModel, rules: dict[str, str] | None = None, threshold: float = 0.5) -> DataFrame:
    """pages(page_id, url) -> (page_id, host, path, rule, verdict).

    A null url, or one without ://, has empty host and path and is judged by its features
    like any (null as an empty text). Row for row: repeated rows and null ids stay; an
    empty table gives an empty one; other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    use = RULES if rules is None else rules
    url = F.col("url")
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parsed = parsed.select("page_id", "url", host_column(url).alias("host"), path_column(url).alias("path"))
    ruled = parsed.withColumn("rule", rule_column(F.col("host"), F.col("path"), use))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("rule").to_pylist()
            urls = [u or "" for u in batch.column("url").to_pylist()]
            verdicts = [use.get(r) for r in found]
            open_ = [i for i, v in enumerate(verdicts) if v is None]
            for i, p in zip(open_, model.probability([urls[i] for i in open_]).tolist()):
                verdicts[i] = "block" if p >= threshold else "allow"
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return ruled.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
