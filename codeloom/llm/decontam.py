"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document is contaminated by a benchmark item if some stretch of its words is within
(1 - similarity) * n word edits of the item's n words. Items are grouped by n, and the
document's windows of n words are compared with the items of that size:

1. An edit spoils at most two of an item's n - 1 word pairs, or one and pushes one out of
   the window; so with k edits allowed a window can only match if n - 1 - 2 k of its word
   pairs are pairs of items of that size. This bound loses nothing and leaves few windows.
2. Those windows and the items are embedded by CGK random walks: step j emits the word
   at the walk's place and moves on if a random function of (j, word) says so. Walks of
   texts at small edit distance fall into step again after each edit, so edits become
   few differing places.
3. Tables sample places of the embeddings; a window and an item with equal samples in
   some table are a candidate. The number of walks is set at build time, by edits planted
   in the items, so that each size reaches the target recall at the largest distance
   allowed, for each kind of edit alone and for all mixed.
4. Sizes that the walks don't bring there have no walks: every item that shares as many
   word pairs with a window as the bound of 1. asks of it is a candidate, which loses none.
5. Candidates are verified by the exact edit distance of the item to the best stretch of
   the words around the window.

Items under five words allow no edits; they are found as they are, word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, over_texts, packed, prepare

SIMILARITY = 0.8
#: Items with fewer words allow no edit and have few pairs or none: they are looked up whole.
MIN_WORDS = 5
#: Sampled places of a table, tables of a walk, walks at most, and the recall aimed at.
PLACES, TABLES, WALKS, RECALL = 3, 4, 12, 0.95
#: Edited items of a size and a kind of edit (all mixed, or one alone) that recall is measured on.
PLANTED, KINDS = 64, ((0, 1, 2), (0,), (1,), (2,))
#: Characters of benchmark text that one pass over the documents looks for.
BLOCK_CHARS = 8 << 20
#: Scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Bopomofo, Han, Yi.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORDS = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of word characters; in scripts without spaces every character is a word."""
    return _WORDS((text or "").lower())


def infix_distance(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """The least edit distance of item to a stretch of each region (rows of word ids)."""
    steps = np.arange(regions.shape[1] + 1)
    d = np.zeros((len(regions), len(steps)), np.int32)
    for i, word in enumerate(item.tolist()):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        np.minimum(d[:, :-1] + (regions != word), d[:, 1:] + 1, out=new[:, 1:])
        d = np.minimum.accumulate(new - steps, axis=1) + steps
    return d.min(axis=1)


class Index:
    """Items by size, with the keys of their embeddings."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.vocab: dict[str, int] = {}
        sizes: dict[int, list[tuple[int | None, list[int]]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                sizes.setdefault(len(words), []).append((item_id, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]))
        self.pad = len(self.vocab) + 1
        self.similarity = similarity
        self.ids = {n: [i for i, _ in sizes[n]] for n in sizes}
        # Of each short size the items by their words, and which words any of them has.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self.in_short = np.zeros(self.pad + 1, bool)
        for n in range(1, MIN_WORDS):
            for i, (_, w) in enumerate(sizes.get(n, ())):
                self.short.setdefault(n, {}).setdefault(tuple(w), []).append(i)
                self.in_short[w] = True
        self.sizes = sorted(n for n in sizes if n >= MIN_WORDS)
        self.items = {n: np.array([w for _, w in sizes[n]], np.int64) for n in self.sizes}
        self.edits = {n: int((1 - similarity) * n + 1e-9) for n in self.sizes}
        coded = {n: (self.items[n][:, :-1] * self.pad + self.items[n][:, 1:]).ravel() for n in self.sizes}
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *coded.values()]))
        self.member = {}
        for n in self.sizes:
            mask = np.zeros(len(self.pairs) + 1, bool)
            mask[np.searchsorted(self.pairs, coded[n]) + 1] = True
            self.member[n] = mask
        self.needed = {n: n - 1 - 2 * self.edits[n] for n in self.sizes}
        # Cut into stretches of the shortest item's pairs, a matching window has one with
        # at least its share of the pairs needed.
        self.stretch = min(self.sizes, default=2) - 1
        self.share = min((-(-self.needed[n] // -(-(n - 1) // self.stretch)) for n in self.sizes), default=1)
        longest = 2 * max(self.sizes, default=1)
        odd = lambda *shape: rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.moves, self.shifts = odd(WALKS, longest), odd(WALKS, longest)
        self.mixes = odd(WALKS, TABLES, PLACES)
        # Places are fractions of the walk, so that they mean the same at every size.
        self.places = rng.random((WALKS, TABLES, PLACES)) * 0.85
        self.walks = WALKS
        needed = self._calibrated(rng, recall)
        self.walked, self.walks = set(needed), max(needed.values(), default=0)
        # Of sizes without walks, the items that have each pair: those of pair p are at
        # first[p] to first[p + 1].
        self.having = {n: self._having(n) for n in self.sizes if n not in self.walked}
        # Items in one numbering, and the sorted keys of all in each table.
        self.names = [(n, i) for n in self.sizes if n in self.walked for i in range(len(self.ids[n]))]
        keys = [self._embed(self.items[n], np.full(len(self.items[n]), n)) for n in self.sizes if n in self.walked]
        self.keys = [self._sorted(np.concatenate(k)) for k in zip(*keys)]

    @staticmethod
    def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def _embed(self, rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The key of each row in each table; a row has sizes words, then padding."""
        width, count = rows.shape[1], len(rows)
        padded = np.concatenate([rows, np.full((count, 1), self.pad, rows.dtype)], axis=1).astype(np.uint64)
        flat, base = padded.ravel(), np.arange(count) * (width + 1)
        out = []
        for r in range(self.walks):
            at = base.copy()
            stop = base + sizes
            steps = np.empty((2 * width, count), np.uint64)
            for j in range(2 * width):
                steps[j] = here = flat[at]
                here = here * self.moves[r, j] + self.shifts[r, j]
                here >>= np.uint64(63)
                at = np.minimum(at + here.astype(np.int64), stop)
            for t in range(TABLES):
                key = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for q in range(PLACES):
                    place = (self.places[r, t, q] * 2 * sizes).astype(np.int64)
                    key = key + (steps[place, np.arange(count)] + np.uint64(1)) * self.mixes[r, t, q]
                out.append(key)
        return out

    def _having(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.searchsorted(self.pairs, self.items[n][:, :-1] * self.pad + self.items[n][:, 1:]) + 1
        each = np.unique(np.stack([pairs.ravel(), np.repeat(np.arange(len(pairs)), n - 1)], axis=1), axis=0)
        return np.searchsorted(each[:, 0], np.arange(len(self.pairs) + 2)), each[:, 1]

    def _calibrated(self, rng: np.random.Generator, recall: float) -> dict[int, int]:
        """Of each size that gets there, the walks until so many of the items edited as much
        as allowed share a key with themselves, by the kind of edit that needs most.

        Walks stray further the longer they are: sizes above the first that misses aren't tried.
        """
        out: dict[int, int] = {}
        for n in self.sizes:
            rows = self.items[n][np.resize(rng.permutation(len(self.items[n])), PLANTED)]
            edited = np.array([self._edited(r, self.edits[n], rng, kinds) for kinds in KINDS for r in rows], np.int64)
            a, b = self._embed(rows, np.full(len(rows), n)), self._embed(edited, np.full(len(edited), n))
            same = np.stack([np.tile(x, len(KINDS)) == y for x, y in zip(a, b)])
            met = np.logical_or.accumulate(same.reshape(WALKS, TABLES, -1).any(axis=1), axis=0)
            enough = np.flatnonzero(met.reshape(WALKS, len(KINDS), -1).mean(axis=2).min(axis=1) >= recall)
            if not len(enough):
                break
            out[n] = int(enough[0]) + 1
        return out

    def _edited(self, row: np.ndarray, edits: int, rng: np.random.Generator, kinds: tuple[int, ...] = KINDS[0]) -> np.ndarray:
        out = row.tolist()
        for _ in range(edits):
            at = int(rng.integers(0, max(1, len(out))))
            kind = kinds[int(rng.integers(0, len(kinds)))]
            if kind == 0 and out:
                out[at] = 0
            elif kind == 1 and out:
                del out[at]
            else:
                out.insert(at, 0)
        return np.array((out + [0] * len(row))[: len(row)])

    def matches(self, texts: list[str | None]) -> list[dict[int, int]]:
        """Of each text: the edit distance of each item within reach, an item named by its
        size and its place among the items of that size."""
        found: list[dict] = [{} for _ in texts]
        docs = [np.fromiter(map(self.vocab.get, words_of(t), repeat(0)), np.int64) for t in texts]
        for n, items in self.short.items():
            for own, doc in zip(found, docs):
                self._look_up(doc, n, items, own)
        if not self.sizes or not texts:
            return found
        most = max(self.edits.values())
        gap = max(most, 1)  # words between documents, so that pairs end with them
        flat, starts, ends = _laid(docs, gap)
        pairs = self._pairs(flat)
        # Documents without a stretch that has its share of pairs are done with.
        count = np.cumsum(np.append(0, pairs > 0))
        dense = np.flatnonzero(count[self.stretch :] - count[: -self.stretch] >= self.share)
        near = np.unique(np.searchsorted(ends + gap, dense, side="right"))
        near = near[near < len(docs)]
        if not len(near):
            return found
        flat, starts, ends = _laid([docs[d] for d in near.tolist()], gap)
        pairs = self._pairs(flat)
        own = [found[d] for d in near.tolist()]
        windows: dict[int, list[tuple]] = {}
        for n in self.sizes:
            k = self.edits[n]
            if len(flat) < n:
                continue
            count = np.cumsum(np.append(0, self.member[n][pairs]))
            at = np.flatnonzero(count[n - 1 :] - count[: len(count) - n + 1] >= self.needed[n])
            at = at[at + n <= len(flat)]
            if not len(at):
                continue
            doc = np.minimum(np.searchsorted(ends + gap, at, side="right"), len(own) - 1)
            # A window may stand out of its document by as many words as may be missing.
            inside = at + n <= ends[doc] + k
            at, doc = at[inside], doc[inside]
            if n not in self.walked:
                self._look_all(flat, pairs, at, doc, n, starts, ends, own)
                continue
            windows.setdefault(n.bit_length(), []).append((at, doc, n))
        for group in windows.values():
            at, doc = np.concatenate([x[0] for x in group]), np.concatenate([x[1] for x in group])
            sizes = np.repeat([x[2] for x in group], [len(x[0]) for x in group])
            some = max(1, (1 << 20) // int(sizes.max()))  # windows at a time
            for c in range(0, len(at), some):
                self._look(flat, at[c : c + some], doc[c : c + some], sizes[c : c + some], starts, ends, own)
        return found

    def _look_up(self, doc: np.ndarray, n: int, items: dict[tuple[int, ...], list[int]], found: dict) -> None:
        """Short items of n words that the document has word for word."""
        count = np.cumsum(np.append(0, self.in_short[doc]))
        for at in np.flatnonzero(count[n:] - count[:-n] == n).tolist():
            found.update(((n, i), 0) for i in items.get(tuple(doc[at : at + n].tolist()), ()))

    def _pairs(self, flat: np.ndarray) -> np.ndarray:
        """The place, from 1, of each adjacent pair among the items' pairs, else 0."""
        out = np.zeros(len(flat) - 1, np.int64)
        known = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0))
        keys = flat[known] * self.pad + flat[known + 1]
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        out[known] = np.where(self.pairs[at] == keys, at + 1, 0)
        return out

    def _look(self, flat: np.ndarray, at: np.ndarray, doc: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: list[dict]) -> None:
        """Candidates of the windows by the tables, and the edit distance of each."""
        span = np.arange(int(sizes.max()))
        rows = np.where(span < sizes[:, None], flat[np.minimum(at[:, None] + span, len(flat) - 1)], self.pad)
        pairs: set[tuple[int, int]] = set()
        for keys, (own, order) in zip(self._embed(rows, sizes), self.keys):
            low, high = np.searchsorted(own, keys, side="left"), np.searchsorted(own, keys, side="right")
            for w in np.flatnonzero(high > low).tolist():
                pairs.update((i, w) for i in order[low[w] : high[w]].tolist())
        by_item: dict[int, list[int]] = {}
        for i, w in sorted(pairs):
            by_item.setdefault(i, []).append(w)
        for i, ws in by_item.items():
            n, place_in = self.names[i]
            k = self.edits[n]
            place = at[ws][:, None] + np.arange(-k, n + k)
            own_doc = doc[ws]
            out = (place < starts[own_doc][:, None]) | (place >= ends[own_doc][:, None])
            regions = np.where(out, 0, flat[np.clip(place, 0, len(flat) - 1)])
            for d, distance in zip(own_doc.tolist(), infix_distance(self.items[n][place_in], regions).tolist()):
                if distance <= k:
                    found[d][(n, place_in)] = min(distance, found[d].get((n, place_in), distance))

    def _look_all(self, flat: np.ndarray, pairs: np.ndarray, at: np.ndarray, doc: np.ndarray, n: int, starts: np.ndarray, ends: np.ndarray, found: list[dict]) -> None:
        """The edit distance of every item of n words to the words around those of the
        windows that share as many pairs with it as a match needs."""
        if not len(at):
            return
        k, needed = self.edits[n], self.needed[n]
        first, having = self.having[n]
        for run in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) > n) | (np.diff(doc) > 0)) + 1):
            own, d = at[run], int(doc[run[0]])
            here = pairs[own[0] : own[-1] + n - 1]
            # Every pair in the run, once for each item that has it.
            counts = first[here + 1] - first[here]
            counts[here == 0] = 0
            place = np.repeat(np.arange(len(here)), counts)
            item = having[np.repeat(first[here] - np.cumsum(counts) + counts, counts) + np.arange(len(place))]
            shared = np.bincount(item, minlength=len(self.ids[n]))
            for i in np.flatnonzero(shared >= needed).tolist():
                count = np.cumsum(np.append(0, np.bincount(place[item == i], minlength=len(here))))
                near = own[count[own - own[0] + n - 1] - count[own - own[0]] >= needed]
                if len(near):
                    low, high = max(int(near[0]) - k, int(starts[d])), min(int(near[-1]) + n + k, int(ends[d]))
                    distance = int(infix_distance(self.items[n][i], flat[None, low:high])[0])
                    if distance <= k:
                        found[d][(n, i)] = min(distance, found[d].get((n, i), distance))


def _laid(docs: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents behind one another with gap unknown words after each, their starts and ends."""
    space = np.zeros(gap, np.int64)
    ends = np.cumsum([len(d) + gap for d in docs]) - gap
    return np.concatenate([x for d in docs for x in (d, space)]), ends - np.array([len(d) for d in docs]), ends


def _indexes(benchmark: DataFrame, similarity: float, block_chars: int) -> tuple[int, Iterator[Index]]:
    """The number of blocks of bounded text that the items are cut into by a hash, and their
    indexes, each made when it is asked for. A benchmark of usual size is one block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    return n, (Index(sorted(((r["item_id"], r["text"]) for r in items.where(place == b).collect()), key=order), similarity) for b in range(n))


def _found(index: Index, texts: list[str | None]) -> list[tuple[set[int | None], float | None]]:
    """Of each text the ids of the items in it, and the best similarity."""
    out = []
    for found in index.matches(texts):
        out.append(({index.ids[n][i] for n, i in found}, max((1 - d / n for (n, _), d in found.items()), default=None)))
    return out


def _pass(rows: DataFrame, index: Index, only_hits: bool) -> DataFrame:
    """One pass over rows(doc_id, key, text) with one block's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _found(index, batch.column("text").to_pylist())
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([b is not None for _, b in found], pa.bool_()), pa.array([sorted(x for x in s if x is not None) for s, _ in found], pa.list_(pa.int64())), pa.array([b for _, b in found], pa.float64())],
                ["doc_id", "key", "contaminated", "item_ids", "best_similarity"],
            )
            yield out.filter(out.column("contaminated")) if only_hits else out

    return rows.mapInArrow(run, "doc_id long, key long, contaminated boolean, item_ids array<long>, best_similarity double")


def _hits(rows: DataFrame, indexes: Iterator[Index]) -> DataFrame:
    """What all blocks found, one pass each: a row for each contaminated (doc_id, key).

    A block's index is on the driver while its pass runs, and no longer.
    """
    found = [checkpointed(_pass(rows, index, only_hits=True)) for index in indexes]
    both = reduce(DataFrame.unionByName, found)
    return both.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.max("best_similarity").alias("best_similarity"))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), *(more or [text.alias("text")]))


def scan(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, contaminated, item_ids, best_similarity).

    item_ids is sorted and without repeats; best_similarity is 1 - distance / words of
    the nearest item, null without one; ties are all listed. Items of one to four words
    have to occur word for word; items without words are never found. Null and empty texts,
    and empty tables, give no match. Row for row: repeated rows and null ids stay; other
    columns are ignored. A benchmark over block_chars is looked for block by block, and
    rows then get their blocks' results by (doc_id, 64-bit hash of the text).
    """
    prepare(docs.sparkSession)
    n, indexes = _indexes(benchmark, similarity, block_chars)
    rows = _keyed(docs)
    if n == 1:
        return _pass(rows, next(indexes), only_hits=False).drop("key")
    own = _keyed(docs, F.lit(1).alias("one"))
    joined = own.join(_hits(rows, indexes), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", F.col("best_similarity").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "best_similarity")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns and values.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark leaves
    all, an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    n, indexes = _indexes(benchmark, similarity, block_chars)
    if n > 1:
        hits = _hits(_keyed(docs), indexes)
        rows = _keyed(docs, packed(docs).alias("row"))
        return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left_anti").select("row.*")
    index = next(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = index.matches(batch.column("text").cast(pa.string()).to_pylist())
            yield batch.filter(pa.array([not f for f in found], pa.bool_()))

    return over_texts(docs, run)
