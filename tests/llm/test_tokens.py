import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from codeloom.llm import bpe, token_store
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.frames import AWKWARD, EMPTY, LONG, documents

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PIECES = ["the", "The", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "12", "３", "²", "Ⅷ", "é", "é", "ß", "中文", "😀", "\xa0", "\x1c", "\x85", "\u3000", "_x", "a.", "b,", "(,)", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "aaaaaaa", "İ", "Σ", "x.\n", " \n "]
texts = st.lists(st.sampled_from(PIECES), max_size=30).map("".join) | st.text(max_size=40)


@pytest.fixture(scope="module")
def mine():
    return bpe.ByteBPE(BYTE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


@given(text=texts)
@settings(max_examples=400, deadline=None)
def test_bpe_equals_the_library(mine, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = mine.encode_batch([text])[0]
    assert got.tolist() == ids
    assert mine.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_merge_rounds_on_runs(mine, library):
    for text in ("a" * 997, "ab" * 333, LONG[:5000].replace(" ", ""), "\n" * 50):
        assert mine.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_caches_may_be_forgotten(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    b = bpe.ByteBPE(BYTE)
    for text in ("one two three four five", "six seven one two", ""):
        assert b.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_frames(spark, library):
    docs = documents(spark, AWKWARD)
    rows = bpe.round_trip(docs, BYTE).collect()
    expected = []
    for i, text in AWKWARD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    encoded = bpe.encode(docs, BYTE)
    assert sorted(str((r["doc_id"], r["text"])) for r in bpe.decode(encoded, BYTE).collect()) == sorted(str((i, t or "")) for i, t in AWKWARD)
    assert bpe.round_trip(documents(spark, EMPTY), BYTE).count() == 0


@given(text=texts)
@settings(max_examples=300, deadline=None)
def test_pieces_equal_the_library(text):
    expected = Tokenizer.from_file(WORD) if not hasattr(test_pieces_equal_the_library, "t") else test_pieces_equal_the_library.t
    test_pieces_equal_the_library.t = expected
    assert token_store.encode_texts(WORD, [text], 2)[0].tolist() == [*expected.encode(text, add_special_tokens=False).ids, 2]


@given(st.lists(st.integers(0, 1 << 40) | st.integers(0, 3), max_size=600).map(sorted))
@settings(max_examples=100, deadline=None)
def test_elias_fano(values):
    sequence = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert sequence.all().tolist() == values
    for i in random.Random(0).sample(range(len(values)), min(20, len(values))):
        assert sequence.select(i) == values[i]
    with pytest.raises(IndexError):
        sequence.select(len(values))


def test_elias_fano_of_wide_values():
    wide = [0, 1, 1 << 62, (1 << 63) + 5, (1 << 64) - 1]
    sequence = token_store.EliasFano.from_bytes(token_store.EliasFano.of(np.array(wide, np.uint64)).to_bytes())
    assert sequence.all().tolist() == wide == [sequence.select(i) for i in range(5)]
    ids = [-(1 << 63), -1, 0, (1 << 63) - 1]
    block = token_store.Block(token_store.pack([None, *ids], [np.array([i], np.uint32) for i in range(5)]))
    assert block.doc_ids() == [None, *ids] and [block.document(i).tolist() for i in range(5)] == [[0], [1], [2], [3], [4]]


def test_blocks_close_without_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_DOCS", 16)
    folder = str(tmp_path / "s")
    token_store.write(documents(spark, [(i, "") for i in range(200)]), WORD, folder)
    assert spark.read.parquet(folder).agg({"n_docs": "max"}).first()[0] <= 16
    assert sorted(map(tuple, token_store.read(spark, folder).collect())) == [(i, 0, 0, 0) for i in range(200)]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


SIGNED = ["word", "Été", "über", "ªº", "µ", "don't", "it's", "'", "n", "e\u0301", "E\u0301t", "\u0301", "ſ", "ß", "中", "%%%", "&&&", "$$", "###", "*", ".%%%", ".", "...", "!?", "(", "|", "<|endoftext|>", "<|ENDOFTEXT|>.", "7", " ", " ", "\n", "\t", "\xa0", "\u0338"]


@given(text=st.lists(st.sampled_from(SIGNED), max_size=40).map("".join))
@settings(max_examples=600, deadline=None)
def test_words_and_signs_equal_the_library(word_library, text):
    assert token_store.encode_texts(WORD, [text], None)[0].tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_the_library_sees_a_word_once_whatever_signs_follow(monkeypatch):
    encoder, library = token_store.PieceEncoder(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdeéöñ", k=rng.randrange(1, 12))) for _ in range(1000)]
    texts = [" ".join(w + s for w in words) for s in ("", ".", "%%%", ".&&&", "!!", "$$$", " ***")]
    assert [x.tolist() for x in encoder.encode(texts, None)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(encoder.known) == {*words, ".", "%%%", ".&&&", "!!", "$$$", "***"}
    seen = []

    class Counted:
        encode_batch = lambda self, texts, **more: seen.extend(texts) or library.encode_batch(texts, **more)
        encode_batch_fast = lambda self, texts, **more: seen.extend(texts) or library.encode_batch_fast(texts, **more)

    again = token_store.PieceEncoder(WORD)
    monkeypatch.setattr(again, "tokenizer", Counted())
    again.encode(texts, None)
    assert again.known == encoder.known and len(seen) < len(set(words)) / 50


def test_special_tokens_that_cuts_could_break():
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    assert token_store.cuts_at_blanks(spec)
    for content in ("end of", "<e. >", "<a%>", "END", "fin\n"):
        assert not token_store.cuts_at_blanks(spec | {"added_tokens": [spec["added_tokens"][0] | {"content": content}]})


def test_batches_are_gathered(monkeypatch):
    monkeypatch.setattr(token_store, "GROUP_CHARS", 100)
    monkeypatch.setattr(token_store, "BLOCK_DOCS", 50)
    for texts in ([f"{i} " * (i % 9) for i in range(97)], [None, ""] * 60, ["x" * 300], []):
        batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + len(t)), pa.int64()), pa.array(t, pa.string())], ["doc_id", "text"]) for i in range(0, len(texts), 7) if (t := texts[i : i + 7])]
        groups = list(token_store.gathered(iter(batches)))
        assert [(d, t) for ds, ts in groups for d, t in zip(ds, ts)] == [(i, t or "") for i, t in enumerate(texts)]
        assert all(len(ts) <= 50 + 6 and len("".join(ts[:-7])) < 100 for _, ts in groups)
        assert len(groups) <= 1 + max(len("".join(t or "" for t in texts)) // 100, len(texts) // 50)


def test_other_tokenizers_encode_whole_texts():
    library = Tokenizer.from_file(BYTE)
    texts = ["Some  Text, with\n\nblanks ", "", "<|endoftext|> I'll"]
    assert not token_store.PieceEncoder(BYTE).by_pieces and token_store.PieceEncoder(WORD).by_pieces
    assert [x.tolist() for x in token_store.encode_texts(BYTE, texts, None)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 1500, 10_000))
    assert len(token_store.EliasFano.of(ends).to_bytes()) < 10_000 * 13 / 8 + 1000
    with pytest.raises(ValueError):
        token_store.EliasFano.of(np.array([2, 1], np.uint64))


def test_blocks():
    block = token_store.Block(token_store.pack([None, -5, 3, 3], [np.array(x, np.uint32) for x in ([1, 2], [], [70000], [4, 5])]))
    assert block.doc_ids() == [None, -5, 3, 3]
    assert [block.document(i).tolist() for i in range(4)] == [[1, 2], [], [70000], [4, 5]]
    assert token_store.Block(token_store.pack([], [])).doc_ids() == []
    with pytest.raises(ValueError):
        token_store.Block(b"nonsense")


@pytest.mark.parametrize("block_ids", [1 << 19, 50])
def test_store(spark, tmp_path, monkeypatch, block_ids):
    monkeypatch.setattr(token_store, "BLOCK_IDS", block_ids)
    rows = [(i, t) for i, t in AWKWARD if t != LONG] + [(i, f"doc {i} " * (i % 7)) for i in range(100, 200)]
    folder = str(tmp_path / "store")
    token_store.write(documents(spark, rows), WORD, folder, end=2)
    library = Tokenizer.from_file(WORD)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, at = [], 0
    for i, text in ordered:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_store.read(spark, folder).collect()), key=lambda r: r[1]) == expected


def test_empty_store(spark, tmp_path):
    token_store.write(documents(spark, EMPTY), WORD, str(tmp_path / "s"), end=2)
    assert token_store.read(spark, str(tmp_path / "s")).count() == 0


def test_other_files_are_refused():
    import json

    with open(BYTE, encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"decoder": None}, {"model": spec["model"] | {"byte_fallback": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        with pytest.raises(ValueError):
            bpe.check(spec | change)
    with pytest.raises(ValueError):
        bpe.ByteBPE(WORD)
