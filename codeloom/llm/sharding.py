"""Byte-balanced shards by Karmarkar-Karp differencing.

Documents of equal text are one group and stay together. Differencing keeps partial
partitions: k bins with their sums. It repeatedly takes the two with the largest spread,
lays their bins over each other in opposite order and puts the result back, until one is
left. That works on any partial partitions, so it is done in levels: tasks reduce units of
at most UNIT_GROUPS groups to one partial partition each, whose spread is about one
group's size; tasks then reduce at most UNIT_PARTS of those to one again, level by level,
until one is left. Only numbers of units reach the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, partitions, prepare, spread_join

#: Groups of one unit: what a task holds at a time.
UNIT_GROUPS = 50_000
#: Partial partitions that a task combines at a time.
UNIT_PARTS = 2_000
#: Rows numbered by one task.
SLOT_ROWS = 100_000


def difference(parts: list[list[int]], k: int) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions: the final bin of each bin of each part.

    Ties go by the parts' order, so the result depends on the input alone.
    """
    # A state: bins as (sum, members), falling; a member is (part, bin), or two members.
    heap = []
    for n, sums in enumerate(parts):
        bins = sorted(((s, (n, b)) for b, s in enumerate(sums) if s), key=lambda x: -x[0])
        low = bins[-1][0] if len(bins) == k else 0
        heap.append((low - bins[0][0] if bins else 0, n, bins))
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        met = len(a) + len(b) - k  # so many bins of both lie over each other
        if met <= 0:
            bins = a + b
        else:
            bins = a[: k - len(b)] + b[: k - len(a)]
            bins += [(x + y, (m, l)) for (x, m), (y, l) in zip(a[k - len(b) :], reversed(b[k - len(a) :]))]
        bins.sort(key=lambda x: -x[0])
        low = bins[-1][0] if len(bins) == k else 0
        heapq.heappush(heap, (low - bins[0][0] if bins else 0, turn, bins))
        turn += 1
    out = [[0] * len(sums) for sums in parts]
    for place, (_, members) in enumerate(heap[0][2] if heap else []):
        open_ = [members]
        while open_:
            x = open_.pop()
            if isinstance(x[0], int):
                out[x[0]][x[1]] = place
            else:
                open_ += x
    return out


def digest(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, size, text_crc32, group): no text after this."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    return rows.select("doc_id", (F.octet_length("t") + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode("t", "utf-8")).alias("text_crc32"), F.xxhash64("t").alias("group"))


def _reduced(groups: DataFrame, k: int) -> DataFrame:
    """groups(group, size, bytes) -> with the unit and the bin there of each; units count up from 0."""
    parts = partitions(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def reduce() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            bins = [x[0] for x in difference([[w] for w in t.column("bytes").to_pylist()], k)]
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in t.columns), pa.array([unit] * len(bins), pa.int64()), pa.array(bins, pa.int32())], ["group", "size", "bytes", "unit", "bin"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= UNIT_GROUPS:
                yield reduce()
                n, held, unit = 0, [], unit + parts
        if n:
            yield reduce()

    dealt = groups.repartition(parts, "group", "size").sortWithinPartitions("group", "size")
    return dealt.select("group", "size", "bytes").mapInArrow(run, "group long, size long, bytes long, unit long, bin int")


def _combined(sums: DataFrame, k: int) -> DataFrame:
    """sums(unit, bin, bytes) -> (unit, bin, above, place): units are combined, UNIT_PARTS in
    one task at a time, into the units above, in whose bins theirs come to lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def combine(above: int, found: dict[int, list[int]]) -> pa.RecordBatch:
            units = sorted(found)
            rows = [(u, b, above, s) for u, bins in zip(units, difference([found[u] for u in units], k)) for b, s in enumerate(bins)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["unit", "bin", "above", "place"])

        now, found = None, {}
        for batch in batches:
            for above, u, b, n in zip(*(batch.column(c).to_pylist() for c in ("above", "unit", "bin", "bytes"))):
                if above != now and found:
                    yield combine(now, found)
                    found = {}
                now = above
                found.setdefault(u, [0] * k)[b] = n
        if found:
            yield combine(now, found)

    above = sums.withColumn("above", F.floor(F.col("unit") / UNIT_PARTS).cast("long"))
    dealt = above.repartition(partitions(sums), "above").sortWithinPartitions("above", "unit", "bin")
    return dealt.select("above", "unit", "bin", "bytes").mapInArrow(run, "unit long, bin int, above long, place int")


def _placed(groups: DataFrame, k: int) -> DataFrame:
    """groups(group, size, bytes) -> (group, size, shard)."""
    placed = checkpointed(_reduced(groups, k))
    sums = checkpointed(placed.groupBy("unit", "bin").agg(F.sum("bytes").alias("bytes")))
    moves = None  # (unit, bin, above, place): from the first units to the highest so far
    while moves is None or sums.select("unit").distinct().count() > 1:
        step = checkpointed(_combined(sums, k))
        if moves is None:
            moves = step
        else:
            up = step.select(F.col("unit").alias("above"), F.col("bin").alias("place"), F.col("above").alias("higher"), F.col("place").alias("there"))
            moves = checkpointed(moves.join(up, ["above", "place"]).select("unit", "bin", F.col("higher").alias("above"), F.col("there").alias("place")))
        sums = checkpointed(sums.join(step, ["unit", "bin"]).groupBy(F.col("above").alias("unit"), F.col("place").alias("bin")).agg(F.sum("bytes").alias("bytes")))
    return placed.join(moves.select("unit", "bin", F.col("place").alias("shard")), ["unit", "bin"]).select("group", "size", "shard")


def shards(docs: DataFrame, k: int = 24) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, size, text_crc32, shard, slot); size is UTF-8 bytes + 8.

    Null texts count as empty and so are one group with those. Repeated rows and null ids
    each get a slot of their own. A group is never cut, so one that is larger than a
    k-th of all bytes makes its shard as large. Texts are told apart by a 64-bit hash and
    their size; if two ever agree in both, they only share a shard. An empty table gives
    an empty one; other columns are ignored.
    """
    prepare(docs.sparkSession)
    # Rows alike in all that matters are one row with a count, from the map side on.
    alike = ["doc_id", "size", "text_crc32", "group"]
    rows = checkpointed(digest(docs).groupBy(*alike).agg(F.count("*").alias("times")))
    groups = rows.groupBy("group", "size").agg((F.sum("times") * F.col("size")).alias("bytes"), F.count("*").alias("n"))
    where = checkpointed(_placed(groups, k))
    return slotted(spread_join(rows, where, ["group", "size"], groups.select("group", "size", "n")), k)


def slotted(sharded: DataFrame, k: int) -> DataFrame:
    """Number each shard's rows from 0 without gaps; no task numbers a whole shard.

    sharded(doc_id, size, text_crc32, group, shard, times) has rows alike once. Long runs of
    those are cut, a shard's rows are dealt by a hash of the row and its cut, each hash's are
    numbered alone and then moved up by the rows of those before.
    """
    times = F.col("times")
    starts = F.sequence(F.lit(0).cast("long"), times - 1, F.lit(SLOT_ROWS).cast("long"))
    runs = checkpointed(sharded.select("doc_id", "size", "text_crc32", "group", "shard", "times", F.explode(starts).alias("run")))
    runs = runs.withColumn("times", F.least(times - F.col("run"), F.lit(SLOT_ROWS)))
    cuts = max(1, -(-(runs.agg(F.sum("times")).first()[0] or 0) // (k * SLOT_ROWS)))
    dealt = runs.withColumn("cut", F.pmod(F.xxhash64("doc_id", "text_crc32", "run"), F.lit(cuts)))
    before = Window.partitionBy("shard").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("shard", "cut").agg(F.sum("times").alias("n")).select("shard", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "cut").orderBy("doc_id", "text_crc32", "size", "group", "run").rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("at", F.coalesce(F.sum("times").over(own), F.lit(0))).join(firsts, ["shard", "cut"])
    slots = F.sequence(F.col("first") + F.col("at"), F.col("first") + F.col("at") + times - 1)
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.explode(slots).alias("slot"))
