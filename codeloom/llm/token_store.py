"""Token ids in binary blocks with Elias-Fano document boundaries.

A store is a folder of Parquet files, written by Spark's committers into any file system
that Spark reaches; each row carries one binary block:

    magic   8 bytes  b"CLTOK01\\0"
    header  6 x int64 little-endian: documents, ids, bytes of an id (2 or 4),
            documents without an id, least doc_id, bytes of the first sequence
    doc ids Elias-Fano sequence of doc_id - least
    ends    Elias-Fano sequence of the running number of ids at each document's end
    ids     unsigned little-endian, documents one after another

Blocks ascend by doc_id within and across (part, block). An Elias-Fano sequence of n
values up to u takes about n * (2 + log2(u / n)) bits; a sampled select table answers
"end of document i" without decoding the rest.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import checkpoint_folder, partitions, prepare

MAGIC = b"CLTOK01\0"
#: Ids and documents from which a block is closed; a block ends with a whole document.
BLOCK_IDS, BLOCK_DOCS = 1 << 19, 1 << 16
#: One select sample for so many values.
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, width: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.width, self.high, self.low, self.samples = n, width, high, low, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        top = int(v[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)  # at most 3 n
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        # Bit by bit: `width` bytes a value, of at most BLOCK_DOCS values in a block.
        lows = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if width else np.zeros(0, np.uint8)
        return cls(n, width, np.packbits(bits, bitorder="little"), np.packbits(lows, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i[:, None] * self.width + np.arange(self.width)
        return (((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i, reading from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        need, byte = i % SAMPLE + 1, start >> 3
        first = int(self.high[byte]) >> (start & 7) << (start & 7)
        while True:
            word = first if first >= 0 else int(self.high[byte])
            if (ones := word.bit_count()) >= need:
                break
            need, byte, first = need - ones, byte + 1, -1
        for _ in range(need - 1):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        # The low bits of value i, out of the bytes that hold them.
        first, last = i * self.width, (i + 1) * self.width
        low = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3], "little") >> (first & 7) & ((1 << self.width) - 1)
        return ((at - i) << self.width) + low

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((at - i).astype(np.uint64) << np.uint64(self.width)) + self._low(i)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.width, len(self.high), len(self.low)], "<u4")
        return b"".join([head.tobytes(), self.high.tobytes(), self.low.tobytes(), self.samples.astype("<u4").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, width, high, low = np.frombuffer(raw, "<u4", 4).tolist()
        end = 16 + high + low
        return cls(n, width, np.frombuffer(raw, np.uint8, high, 16), np.frombuffer(raw, np.uint8, low, 16 + high), np.frombuffer(raw, "<u4", -(-n // SAMPLE), end))


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One block; doc_ids ascend, those without an id (null) come first."""
    named = [d for d in doc_ids if d is not None]
    least = named[0] if named else 0
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    docs = EliasFano.of(np.array([d - least for d in named], np.uint64)).to_bytes()
    ends = EliasFano.of(np.cumsum([len(x) for x in ids])).to_bytes()
    head = np.array([len(ids), len(flat), width, len(ids) - len(named), least, len(docs)], "<i8")
    return b"".join([MAGIC, head.tobytes(), docs, len(ends).to_bytes(8, "little"), ends, flat.astype(f"<u{width}").tobytes()])


class Block:
    """A packed block, opened: ids of a document by its place."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a token block")
        n, total, width, nulls, least, size = np.frombuffer(raw, "<i8", 6, 8).tolist()
        at = 56 + size
        ends = int.from_bytes(raw[at : at + 8], "little")
        self.n = n
        self.docs = EliasFano.from_bytes(raw[56:at])
        self.ends = EliasFano.from_bytes(raw[at + 8 : at + 8 + ends])
        self.ids = np.frombuffer(raw, f"<u{width}", total, at + 8 + ends)
        self.nulls, self.least = nulls, least

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [x + self.least for x in self.docs.all().tolist()]

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the ids of document i start and end, by select."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, stop = self.bounds(i)
        return self.ids[start:stop]


#: How the tokenizers that may be cut at blanks cut words.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of ASCII and Latin-1; and signs of which the library makes one word, cut from letters before them.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?#$%&*"
#: A letter, signs and a blank: the library cuts between the first two.
_STOP = rf"([{_LETTERS}])([{_SIGNS}]+)([ \n]|$)"
#: Pieces that are one word to the library wherever they stand.
_WORD = re.compile(f"[{_LETTERS}]+").fullmatch
#: Special tokens that cuts at blanks and signs could break, or that a word could hold.
_IN_PIECES = re.compile(rf"\s|[{_LETTERS}][{_SIGNS}]|^[{_LETTERS}]*$").search
#: Words that the library gets as one text.
JOINED = 128
#: Pieces kept with their ids in a worker; beyond that they are forgotten.
CACHE_PIECES = 800_000
#: Characters from which texts are encoded together, so that a piece is looked up once for all of them.
GROUP_CHARS = 1 << 22


def cuts_at_blanks(spec: dict) -> bool:
    """A tokenizer file says that white space and case are dropped, that no word crosses
    white space or goes from letters to punctuation, and that nothing looks at whole texts.
    Special tokens are none that a cut could break or that could stand within a word."""
    steps = lambda part, many: [] if part is None else part.get(many, [part])
    normal = steps(spec.get("normalizer"), "normalizers")
    blanks = [n for n in normal if n["type"] == "Replace"]
    cut = steps(spec.get("pre_tokenizer"), "pretokenizers")
    return (
        [n["type"] for n in normal if n["type"] != "Replace"] == ["NFC", "Lowercase"]
        and [(n["pattern"], n["content"]) for n in blanks] == [({"Regex": r"\s+"}, " ")]
        and [c["type"] for c in cut] == ["Split", "ByteLevel"]
        and cut[0]["pattern"] == {"Regex": _WORD_PATTERN}
        and (cut[0]["behavior"], cut[0]["invert"]) == ("Removed", True)
        and not cut[1]["add_prefix_space"]
        and not cut[1]["use_regex"]
        and spec["model"]["type"] == "BPE"
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or _IN_PIECES(t["content"]) for t in spec["added_tokens"])
    )


class PieceEncoder:
    """The library's tokenizer over pieces between blanks, with what it said of them.

    For tokenizers that drop white space and case, whose words never cross white space or
    go from letters to punctuation: the library encodes each distinct piece once, and
    whole texts are put together from that; pieces of letters alone, which are one word each,
    go to it many in one text. Cutting, lower-casing A-Z and finding distinct
    pieces are Arrow's kernels. Whether a tokenizer is one of those its file says; any other
    one encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        # A task has one core; threads of its own would only take turns on it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Special tokens are found before case is dropped, so texts that would only look like them afterwards keep theirs.
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        with open(path, encoding="utf-8") as f:
            self.by_pieces = cuts_at_blanks(json.load(f))
        self.known: dict[str, bytes] = {}

    def pieces(self, texts: pa.Array) -> pa.Array:
        """Each text's pieces, which join to the text but for blanks and case."""
        low = pc.ascii_lower(texts)
        for token in self.special:
            if pc.any(pc.match_substring(low, token)).as_py():
                low = texts
                break
        return pc.ascii_split_whitespace(pc.replace_substring_regex(low, _STOP, r"\1 \2\3"))

    def learn(self, fresh: list[str]) -> None:
        """Ask the library for pieces: words many at a time, of which it says whose each id is."""
        words, other = [], []
        for p in fresh:
            (words if _WORD(p) else other).append(p)
        # The fast form leaves out offsets and words, which nothing here asks for.
        self.known.update(zip(other, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]))
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = array("I", e.ids).tobytes()
            stops = (4 * np.cumsum(np.bincount(e.word_ids, minlength=len(group)))).tolist()
            self.known.update(zip(group, [ids[a:b] for a, b in zip([0, *stops], stops)]))

    def encode(self, texts: list[str], end: int | None) -> list[np.ndarray]:
        """The library's ids of each text, and then end."""
        if not texts:
            return []
        tail = [] if end is None else [np.array([end], np.uint32)]
        if not self.by_pieces:
            return [np.concatenate([np.array(e.ids, np.uint32), *tail]) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        lists = self.pieces(pa.array(texts, pa.string()))
        distinct = lists.flatten().dictionary_encode()
        names = distinct.dictionary.to_pylist()
        self.learn([p for p in names if p not in known])
        found = [known[p] for p in names]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), np.uint32)
        at = distinct.indices.to_numpy()
        lengths = sizes[at]
        stops = np.cumsum(lengths)
        first = (np.cumsum(sizes) - sizes)[at] - (stops - lengths)
        flat = ids[np.repeat(first, lengths) + np.arange(int(stops[-1]) if len(stops) else 0)]
        ends = np.append(0, stops)[lists.offsets.to_numpy()].tolist()
        return [np.concatenate([flat[a:b], *tail]) if tail else flat[a:b] for a, b in zip(ends, ends[1:])]


_LOADED: dict[str, PieceEncoder] = {}


def encode_texts(path: str, texts: list[str], end: int | None) -> list[np.ndarray]:
    """PieceEncoder.encode() with the tokenizer of a path, loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path].encode(texts, end)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """doc_ids and texts of batches (doc_id, text), in order, by groups: whole batches until
    they have GROUP_CHARS characters or BLOCK_DOCS documents."""
    names, texts, chars = [], [], 0
    for batch in batches:
        more = [t or "" for t in batch.column("text").to_pylist()]
        names += batch.column("doc_id").to_pylist()
        texts += more
        chars += sum(map(len, more))
        if chars >= GROUP_CHARS or len(texts) >= BLOCK_DOCS:
            yield names, texts
            names, texts, chars = [], [], 0
    if texts:
        yield names, texts


def write(docs: DataFrame, path: str, folder: str, end: int | None = None) -> None:
    """Encode docs(doc_id, text) and write a store into folder.

    Documents are dealt by ranges of doc_id and sorted there by (doc_id, text); null ids
    come first and null texts count as empty. Other columns are ignored; an empty table
    gives a store without blocks. Ids may lie anywhere in 64 bits; without an end id empty
    texts have no ids, and blocks are closed by their documents. A task that is run again writes the same blocks, and
    only a committed task's files count.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        block, names, ids, size = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, names, ids, size
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, block, len(ids), size)] + [pa.array([pack(names, ids)], pa.binary())], ["part", "block", "n_docs", "n_ids", "data"])
            block, names, ids, size = block + 1, [], [], 0
            return row

        for doc_ids, texts in gathered(batches):
            for d, x in zip(doc_ids, encode_texts(path, texts, end)):
                names.append(d)
                ids.append(x)
                size += len(x)
                if size >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    # A block is large for a row: sizes are looked at after every one.
    rows.mapInArrow(run, "part long, block long, n_docs long, n_ids long, data binary").write.option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A store's documents: (doc_id, start, n_tokens, ids_crc32), read from its blocks alone.

    start is the number of ids of all documents before; ids_crc32 is over the ids as
    little-endian unsigned 32-bit integers.
    """
    prepare(spark)
    blocks = spark.read.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, raw in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("data")):
                opened = Block(raw.as_py())
                n = opened.n
                ends = [opened.ends.select(i) for i in range(n)]
                starts = [0, *ends][:-1]
                wide = memoryview(opened.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(opened.doc_ids(), pa.int64()), pa.array([part] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array([b - a for a, b in zip(starts, ends)], pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "block", "within", "n_tokens", "ids_crc32"],
                )

    # One row a part reaches the driver; within a part its blocks are numbered up.
    sizes = blocks.select("part", "block", "n_ids")
    totals = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offsets, at = [], 0
    for part, n in totals:
        offsets.append((part, at))
        at += n
    parts = spark.createDataFrame(offsets, "part long, part_start long")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(parts, "part").select("part", "block", (F.col("before") + F.col("part_start")).alias("block_start"))
    rows = blocks.select("part", "block", "data").mapInArrow(run, "doc_id long, part long, block long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    return f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
