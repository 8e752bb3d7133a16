import random

import numpy as np
import pytest
from codeloom.llm import decontam as D
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.frames import AWKWARD, EMPTY, documents, kept_whole


def words(rng, n):
    return [f"w{rng.randrange(3000)}" if rng.random() < 0.7 else rng.choice(["the", "of", "and"]) for _ in range(n)]


def edited(rng, source, edits):
    out = source[:]
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "zz"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "zz")
    return out


def slow_distance(item, text):
    """Least edit distance of item to a stretch of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_infix_distance(item, region):
    assert D.infix_distance(np.array(item), np.array([region]))[0] == slow_distance(item, region)


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(5)
    return [(i, " ".join(words(rng, rng.randrange(12, 60)))) for i in range(60)]


def test_exact_copies_are_always_found(bench):
    index, rng = D.Index(bench), random.Random(6)
    texts = [" ".join(words(rng, 50)) + "\n" + text.upper().replace(" ", ", ") + " " + " ".join(words(rng, 20)) for _, text in bench] + [text for _, text in bench]
    found = index.matches(texts)
    for n, (i, _) in enumerate(bench + bench):
        assert i in [index.ids[s][k] for s, k in found[n]]
        assert min(found[n].values()) == 0


def test_recall_against_brute_force(bench):
    index, rng = D.Index(bench), random.Random(7)
    texts, sources = [], []
    for _ in range(4):
        for i, text in bench:
            item = text.split()
            texts.append(" ".join(words(rng, 30) + edited(rng, item, rng.randrange(0, int(0.2 * len(item)) + 1)) + words(rng, 30)))
            sources.append(i)
    found = index.matches(texts)
    true = hit = false = 0
    for text, got in zip(texts, found):
        names = {index.ids[n][k]: d for (n, k), d in got.items()}
        for i, b in bench:
            item = b.split()
            d = slow_distance(item, text.split()) if set(item) & set(text.split()) and (i in names or i == sources[texts.index(text)]) else 99
            if d <= int(0.2 * len(item) + 1e-9):
                true += 1
                hit += i in names
                assert names.get(i, d) >= d
            elif i in names:
                false += 1
    assert false == 0 and hit / true >= 0.9


def test_clean_text_stays(bench):
    rng = random.Random(8)
    assert not any(D.Index(bench).matches([" ".join(words(rng, 300)) for _ in range(50)]))
    assert D.Index([]).matches(["a b c"]) == [{}] and D.Index([(2, None), (3, "!")]).matches(["too short", "!"]) == [{}, {}]


def test_short_items_are_found_word_for_word(bench):
    index = D.Index([*bench, (100, "What is the capital"), (101, "forty two"), (102, "Paris"), (103, "forty two"), (104, "the capital is")])
    texts = ["say: what is the CAPITAL?", "forty, two", "in paris", "what is a capital", "the capital is paris", "", None, bench[0][1] + " paris"]
    got = [{index.ids[n][i]: d for (n, i), d in f.items()} for f in index.matches(texts)]
    assert got == [{100: 0}, {101: 0, 103: 0}, {102: 0}, {}, {104: 0, 102: 0}, {}, {}, {0: 0, 102: 0}]


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_recall_at_the_limit_by_kind_of_edit(kind):
    """Items of 1 to 1,000 words, each with exactly as many edits of one kind as may be, the
    words put in being the benchmark's own."""
    rng = random.Random(11)
    sizes = [1, 2, 4, 5, 9, 14, 22, 40, 59, 120, 350, 1000]
    items = [(i, words(rng, sizes[i % len(sizes)])) for i in range(3 * len(sizes))]
    vocabulary = [w for _, ws in items for w in ws]
    index = D.Index([(i, " ".join(ws)) for i, ws in items])
    hits, total = {}, {}
    for i, ws in items:
        n = len(ws)
        for _ in range(2 if n > 300 else 6):
            out = list(ws)
            for _ in range(int(0.2 * n + 1e-9)):
                at = rng.randrange(len(out))
                if kind == 0:
                    out[at] = rng.choice(vocabulary)
                elif kind == 1:
                    del out[at]
                else:
                    out.insert(at, rng.choice(vocabulary))
            found = index.matches([" ".join(["pre"] * 9 + out + ["post"] * 9)])[0]
            hits[n] = hits.get(n, 0) + (i in [index.ids[m][k] for m, k in found])
            total[n] = total.get(n, 0) + 1
    assert all(hits[n] >= 0.95 * total[n] - 1 for n in total) and sum(hits.values()) >= 0.95 * sum(total.values()), (hits, total)


def test_frames(spark, bench):
    items = spark.createDataFrame([*bench, (None, "one two three four five six"), (99, None), (98, ""), (0, bench[0][1])], "item_id long, text string")
    rows = [*AWKWARD, (50, f"x {bench[3][1]} y {bench[4][1]}"), (51, "say one two three four five six now")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in D.scan(docs, items).collect()}
    assert got[50]["item_ids"] == [3, 4] and got[50]["best_similarity"] == 1.0
    assert got[51]["contaminated"] and got[51]["item_ids"] == []  # the item has no id
    assert not got[3]["contaminated"] and D.scan(docs, items).count() == len(rows)
    assert kept_whole(docs, D.clean(docs, items)) == len(rows) - 2
    key = lambda r: (r["doc_id"] is None, r["doc_id"], tuple(r["item_ids"]), r["best_similarity"])
    assert sorted(map(key, D.scan(docs, items, block_chars=2000).collect()), key=str) == sorted(map(key, D.scan(docs, items).collect()), key=str)
    assert kept_whole(docs, D.clean(docs, items, block_chars=2000)) == len(rows) - 2
    assert D.scan(documents(spark, EMPTY), items).count() == 0
    assert not any(r["contaminated"] for r in D.scan(docs, items.limit(0)).collect())


@pytest.mark.parametrize("mixed", [True, False])
def test_recall_of_every_size(mixed):
    """Of mixed edits and of deletions alone, as many as may be."""
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([20] * 12 + [60] * 12 + [250] * 6)]
    index = D.Index(items)
    hits = {}
    for i, text in items:
        item = text.split()
        for _ in range(8):
            out = edited(rng, item, len(item) // 5) if mixed else [item[w] for w in sorted(rng.sample(range(len(item)), len(item) - len(item) // 5))]
            text = " ".join(["pre"] * 20 + out + ["post"] * 20)
            hits.setdefault(len(item), []).append(i in [index.ids[n][k] for n, k in index.matches([text])[0]])
    assert {n: sum(h) / len(h) >= 0.9 for n, h in hits.items()} == {20: True, 60: True, 250: True}


def test_sizes_without_walks_lose_nothing():
    rng = random.Random(10)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 14)))) for i in range(40)]
    index = D.Index(items, recall=2)
    assert not index.walked
    texts = [" ".join(rng.choice("abcdefghz") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [t for _, t in items]
    for text, got in zip(texts, index.matches(texts)):
        slow = {(i, slow_distance(t.split(), text.split())) for i, t in items}
        assert {(index.ids[n][k], d) for (n, k), d in got.items()} == {(i, d) for i, d in slow if d <= len(items[i][1].split()) // 5}


def test_scripts_without_spaces():
    items = [(1, "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed"), (2, "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e0a\u0e32\u0e27\u0e42\u0e25\u0e01"), (3, "\u304d\u3087\u3046\u306f\u3068\u3066\u3082\u3044\u3044\u5929\u6c17")]
    index = D.Index(items)
    found = index.matches([f"\u524d{text}\u5f8c and more" for _, text in items] + ["plain words in a row here"])
    assert [[index.ids[n][k] for n, k in f] for f in found] == [[1], [2], [3], []]
    assert D.words_of("Caf\u00e9 x_1 \u5929\u6c14ok") == ["caf\u00e9", "x_1", "\u5929", "\u6c14", "ok"]
