"""Byte-level BPE: batched numpy merge rounds, and decoding.

Texts are cut into words by the usual byte-level pattern. Words not seen lately are
encoded together: their symbols lie in one flat array, every round looks up all adjacent
pairs by binary search over the sorted pair keys, takes the lowest rank of each word and
merges its occurrences from the left, until no word has a known pair. A merge only makes
pairs of higher rank, so this is the same as merging one pair at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import prepare

#: The word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(r" (?!\S)").search
_SPACE_WORD = re.compile(r" (?=\S)").split
#: A letter run and one of these are two words without the pattern's help.
_STOPS = frozenset(".,;:!?")
#: Words, and pieces of text, kept with their ids in a worker; beyond that they are forgotten.
CACHE_WORDS = 400_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check(spec: dict) -> None:
    """Raise unless a tokenizer file says what this module does: byte-level words by the usual
    pattern, no normaliser, added tokens found as they are, plain BPE, and merges whose
    products have later merges only."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if spec.get("normalizer") is not None or any(cut.get(k) != v for k, v in plain.items()):
        raise ValueError("not a byte-level tokenizer without a normaliser")
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("not a byte-level decoder")
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("not plain BPE")
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens have to be found as they are")
    # A merge that makes a token comes before all that use it, so that rounds by lowest rank
    # and merging one pair at a time agree.
    made: dict[str, int] = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if any(len(x) > 1 and x not in made for x in (a, b)):
            raise ValueError(f"merge {rank} uses a token that no merge before it makes")
        made.setdefault(a + b, rank)


class ByteBPE:
    """Encoder and decoder of a tokenizer file of kind byte-level BPE."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        vocab, of = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(map(of.__getitem__, token)) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.decimal = [str(i).encode() for i in range(size)]
        self.first = np.zeros(256, np.int64)
        for token, i in vocab.items():
            if len(token) == 1 and token in of:
                self.first[of[token]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, once = np.unique(keys, return_index=True)  # the first of equal pairs has the rank
        # The last entry matches no pair and is what a search beyond all keys finds.
        self.keys, self.rank, self.made = np.append(keys, size * size), np.append(once, len(keys)), np.append(made[once], 0)
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.first_piece: dict[str, bytes] = {}
        self.later_piece: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit integers, by merge rounds over all of them."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys) - 1  # no rank is as high
        while len(symbols):
            same = owner[1:] == owner[:-1]
            keys = np.where(same, symbols[:-1] * self.size + symbols[1:], -1)
            at = np.searchsorted(self.keys, keys)
            rank = np.append(np.where(self.keys[at] == keys, self.rank[at], none), none)
            at = np.append(at, 0)
            starts = np.flatnonzero(np.append(True, ~same))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            over = least == none
            if over.any():
                ended.append((owner[over], symbols[over].astype(np.uint32)))
                live = ~over
                symbols, owner, rank, at, least = symbols[live], owner[live], rank[live], at[live], least[live]
            hit = rank == least
            # Of overlapping hits (a run of one symbol) every second one counts, from the left.
            if (hit[1:] & hit[:-1]).any():
                i = np.arange(len(hit))
                begins = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), i, 0))
                hit &= (i - begins) % 2 == 0
            symbols[hit] = self.made[at[hit]]
            if len(hit):
                stay = np.append(True, ~hit[:-1])
                symbols, owner = symbols[stay], owner[stay]
        if not ended:
            return [b""] * len(words)
        owners = np.concatenate([o for o, _ in ended])
        flat = np.concatenate([s for _, s in ended])[np.argsort(owners, kind="stable")].tobytes()
        ends = (4 * np.cumsum(np.bincount(owners, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _pieces(self, text: str) -> list[str]:
        """Cuts before every space that a word follows; words never cross such a cut."""
        return _SPACE_WORD(text) if _SPACES(text) else text.split(" ")

    def _learn(self, fresh: list[str], into: dict[str, bytes], lead: str) -> None:
        known = self.words
        whole = [p for p in fresh if p.isalpha()]
        rest = [p for p in fresh if not p.isalpha()]
        stopped = [p for p in rest if p[-1:] in _STOPS and p[:-1].isalpha()]
        other = {p: self.split(lead + p) for p in rest if not (p[-1:] in _STOPS and p[:-1].isalpha())}
        unseen = {lead + p for p in whole}
        unseen.update([lead + p[:-1] for p in stopped], _STOPS, *other.values())
        unseen = [w for w in unseen if w not in known]
        known.update(zip(unseen, self.encode_words([w.encode() for w in unseen])))
        into.update([(p, known[lead + p]) for p in whole])
        into.update([(p, known[lead + p[:-1]] + known[p[-1]]) for p in stopped])
        into.update([(p, b"".join([known[w] for w in ws])) for p, ws in other.items()])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the special tokens' strings in a text are those tokens."""
        for cache in (self.words, self.first_piece, self.later_piece):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        segments: list[list[str]] = []
        of: list[list] = []  # of each text: indexes into segments, and ids of special tokens as bytes
        for text in texts:
            own: list = []
            at = 0
            if self.cut and (marks := list(self.cut.finditer(text))):
                for m in marks:
                    own += [len(segments), np.array([self.special[m.group()]], np.uint32).tobytes()]
                    segments.append(self._pieces(text[at : m.start()]))
                    at = m.end()
            own.append(len(segments))
            segments.append(self._pieces(text[at:] if at else text))
            of.append(own)
        first, later = self.first_piece, self.later_piece
        self._learn(list({s[0] for s in segments if s[0] not in first}), first, "")
        fresh: set[str] = set()
        for s in segments:
            fresh.update(s[1:])
        self._learn([p for p in fresh if p not in later], later, " ")
        done = [first[s[0]] + b"".join([later[p] for p in s[1:]]) for s in segments]
        return [np.frombuffer(b"".join([done[x] if isinstance(x, int) else x for x in own]), np.uint32) for own in of]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are not UTF-8 become replacement characters; special tokens are kept."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>); null texts count as empty.

    Row for row: repeated rows and null ids stay, other columns are ignored, an empty
    table gives an empty one. path must be readable on every executor.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = [x.astype(np.int32) for x in bpe.encode_batch(_texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text)."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """encode() and decode() in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the decoded
    text in UTF-8. The ids of one batch live at a time, never those of a partition.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_batch(_texts(batch)):
                listed = ids.tolist()
                n.append(len(listed))
                ids_sha.append(hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, listed))).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
