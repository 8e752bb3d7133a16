"""SimHash near-duplicates, linked through a pigeonring filter.

Fingerprints are 64 bits; two documents link when at most TAU = 4 bits differ. The 64
bits form a ring of five segments. If the total difference is at most 4, then some
segment starts a chain around the ring whose running differences stay within the
proportional budget l * 4 / 5 for every chain length l: 0 bits in the first segment,
at most 1 in the first two, 2 in three, 3 in four, 4 in all five.

Candidates meet in the middle: both sides name the start segment and the values of a
chain of segments, as they are and with few bits flipped; every part of an allowed
difference is itself within the budgets, so the two halves of it name one value. With a
chain of three segments (about 39 bits) and one flip a side, a fingerprint has at most
135 keys, and what meets at a key goes through the longer chains and the whole distance.
Keys that many share are split by the same rule at its full length: five segments and two
flips a side, where meeting is already being within 4 bits, so that all who meet link to
the least of them and no pairs are made. Exact copies are one fingerprint before any of
this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, measured, packed, partitions, prepare, spread_join
from codeloom.llm.components import star_forest

TAU = 4
SHINGLE = 4
#: (lowest bit, width) around the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Segments of the chain that keys are made of, and bits that either side flips in it.
CHAIN, FLIPS = 3, 1
#: A key with more members than this is split by the chain's full length. Up to here all
#: pairs of its members are looked at, which costs about as much as the split.
CROWD = 128


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of the lower-cased words' 4-word shingles; no word gives 0."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[SHINGLE - 1 :].tolist() if len(words) >= SHINGLE else [len(joined)]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps)], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): fp as a signed long with the fingerprint's bits, text_key a
    hash that tells rows of one id but different texts apart. Null texts count as empty."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(_hash_batches, "doc_id long, text_key long, fp long")


def _segment(fp: Column, i: int) -> Column:
    low, width = SEGMENTS[i % 5]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain_mask(start: int, length: int) -> int:
    """The bits of a chain of segments."""
    return sum(((1 << SEGMENTS[i % 5][1]) - 1) << SEGMENTS[i % 5][0] for i in range(start, start + length))


def _halves(start: int, length: int, flips: int) -> list[int]:
    """Every set of at most flips bits of a chain that keeps to the budgets."""
    place = {b: n for n in range(length) for b in range(SEGMENTS[(start + n) % 5][0], sum(SEGMENTS[(start + n) % 5]))}
    out = []
    for count in range(flips + 1):
        for bits in combinations(sorted(place), count):
            where = [place[b] for b in bits]
            if all(sum(w < n for w in where) <= (n * TAU) // len(SEGMENTS) for n in range(1, length + 1)):
                out.append(sum(1 << b for b in bits))
    return out


def _keys(fp: Column, start: int, length: int, flips: int) -> Column:
    """Structs (start, value): the chain's bits, as they are and with flips."""
    masks = F.split(F.lit(",".join(str(_signed(m)) for m in _halves(start, length, flips))), ",").cast("array<bigint>")
    chain = F.lit(_signed(_chain_mask(start, length))).cast("long")
    return F.transform(masks, lambda m: F.struct(F.lit(start).cast("tinyint").alias("start"), fp.bitwiseXOR(m).bitwiseAND(chain).alias("value")))


def _of_start(start: Column, of: list[Column]) -> Column:
    return F.coalesce(*[F.when(start == i, c) for i, c in enumerate(of)])


def _first_chain(x: Column, start: Column) -> Column:
    """All chains from start keep to their budgets, and those of no start before do."""
    d = [F.bit_count(_segment(x, i)) for i in range(5)]
    ok = [(d[i] == 0) & (d[i] + d[(i + 1) % 5] <= 1) & (d[i] + d[(i + 1) % 5] + d[(i + 2) % 5] <= 2) & (d[i] + d[(i + 1) % 5] + d[(i + 2) % 5] + d[(i + 3) % 5] <= 3) for i in range(5)]
    return _of_start(start, [reduce(lambda c, before: c & ~before, ok[:i], ok[i]) for i in range(5)])


def _first_key(fp: Column, x: Column, start: Column, value: Column) -> Column:
    """Of the keys at which two fingerprints that differ by x meet, one: fp's side of it flips
    the lowest of two differing bits in the chain, and nothing if fewer differ."""
    mask = _of_start(start, [F.lit(_signed(_chain_mask(i, CHAIN))).cast("long") for i in range(5)])
    own, d = fp.bitwiseAND(mask), x.bitwiseAND(mask)
    return value.bitwiseXOR(own) == F.when(F.bit_count(d) == 2, d.bitwiseAND(-d)).otherwise(F.lit(0).cast("long"))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """distinct(fp) -> (u, v) edges that connect every two fingerprints within TAU bits.

    A fingerprint has many keys, each once, so even a key that all share holds less than a
    hundredth of the keyed rows. Those are counted by a window, which spills; only keys with
    more than one member are kept. Two fingerprints share several keys, but are a pair at
    one of them only.
    """
    # The input is small beside its keys: it is dealt before these are made.
    dealt = distinct.repartition(partitions(distinct), "fp")
    keyed = dealt.select("fp", F.explode(F.concat(*[_keys(F.col("fp"), i, CHAIN, FLIPS) for i in range(5)])).alias("key")).select("fp", "key.*")
    counted = keyed.withColumn("n", F.count("*").over(Window.partitionBy("start", "value")))
    shared, seen = measured(counted.where("n > 1"), most=F.max("n"))
    few = shared.where(F.col("n") <= crowd)
    x = F.col("fp").bitwiseXOR(F.col("other"))
    met = few.select("start", "value", "fp").join(few.select("start", "value", F.col("fp").alias("other")), ["start", "value"])
    once = _first_chain(x, F.col("start")) & _first_key(F.col("fp"), x, F.col("start"), F.col("value"))
    pairs = met.where((F.col("fp") < F.col("other")) & (F.bit_count(x) <= TAU) & once).select(F.col("fp").alias("u"), F.col("other").alias("v"))
    if (seen["most"] or 0) <= crowd:
        return pairs
    return pairs.unionByName(_crowd_links(shared.where(F.col("n") > crowd).select("start", "fp").distinct()))


def _crowd_links(members: DataFrame) -> DataFrame:
    """members(start, fp) -> star edges of all within TAU bits whose chain from start keeps
    to the budgets, by the chain's full length. Rows are linear in the members."""
    dealt = members.repartition(partitions(members), "start", "fp")
    whole = F.coalesce(*[F.when(F.col("start") == i, _keys(F.col("fp"), i, len(SEGMENTS), TAU // 2)) for i in range(5)])
    named = dealt.select("fp", F.explode(whole).alias("key")).select("fp", "key.*")
    least = named.groupBy("start", "value").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    return named.join(least, ["start", "value"]).where("fp <> v").select(F.col("fp").alias("u"), "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_key, fp, component, component_id).

    component is the least fingerprint reachable, component_id the least doc_id there.
    Null and word-less texts share fingerprint 0 and link like any other; repeated rows
    and ids stay as they are; null ids get a component but are never its id (it is null
    where all are); an empty table gives an empty one; other columns are ignored.
    """
    hashed = checkpointed(fingerprints(docs))
    distinct, all_rows = measured(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), rows=F.sum("n"), most=F.max("n"))
    stars = star_forest(links(distinct.select("fp")))
    placed = checkpointed(distinct.join(stars, F.col("fp") == F.col("u"), "left").select("fp", "least_id", F.coalesce("v", "fp").alias("component")))
    parts, fps = measured(placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), rows=F.sum("n"), most=F.max("n"))
    named = spread_join(placed, parts.select("component", "component_id"), ["component"], parts, (fps["rows"], fps["most"]))
    names = checkpointed(named.select("fp", "component", "component_id"))
    return spread_join(hashed, names, ["fp"], distinct, (all_rows["rows"], all_rows["most"])).select("doc_id", "text_key", "fp", "component", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, one with the least doc_id; all columns and values of docs.

    Of rows with that id but different texts the least text_key stays, of repeated rows
    (and of rows that differ in other columns only) any one. A component whose ids are all
    null keeps one row. Rows are told apart by (doc_id, text_key), so no join meets all
    copies of a text at one key. Null and word-less texts are one component; an empty table
    gives an empty one.
    """
    near = checkpointed(near_duplicates(docs))
    own = near.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = own.groupBy("component").agg(F.min_by(F.struct("doc_id", "text_key"), "text_key").alias("row")).select("row.*")
    counts = near.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_key")]
    chosen = checkpointed(kept.alias("a").join(counts.alias("b"), same).select(F.col("a.doc_id").alias("id"), "a.text_key", "n"))
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"))

    def matching(keys: DataFrame) -> DataFrame:
        return rows.join(keys.select("id", "text_key"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")), "left_semi")

    once = matching(chosen.where("n = 1")).select("row.*")
    if chosen.where("n > 1").isEmpty():
        return once
    return once.unionByName(matching(chosen.where("n > 1")).dropDuplicates(["doc_id", "key"]).select("row.*"))
