import random

import numpy as np
import pytest

from reelrank.llm import decontam as D

WORDS = [f"word{i}" for i in range(3000)]


def plain_smith_waterman(p, w):
    best, row = 0, [0] * (len(w) + 1)
    for x in p:
        new = [0]
        for j, y in enumerate(w):
            new.append(max(0, row[j] + (D.MATCH if x == y else D.MISMATCH), row[j + 1] - D.GAP, new[j] - D.GAP))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_plain_smith_waterman():
    r = np.random.default_rng(1)
    for _ in range(300):
        p, w = (r.integers(0, 6, r.integers(1, 15)).astype(np.uint64) for _ in range(2))
        score, s, e = D.align(p, w)
        assert score == plain_smith_waterman(p, w)
        if score:
            assert plain_smith_waterman(p, w[s:e]) == score


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(2)
    prose = lambda n: [r.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(prose(r.randint(20, 90)))) for i in range(12)] + [(50, "too short"), (51, None)]
    docs, truth = [], {}
    for i in range(80):
        text = prose(r.randint(30, 300))
        if i % 4 == 0:
            item, words = items[i % 12][0], items[i % 12][1].split()
            if i % 8 == 0:  # an edited copy: every eighth word replaced, one dropped, one added, other case and punctuation
                words = [r.choice(WORDS) if k % 8 == 3 else w for k, w in enumerate(words) if k != 5]
                words.insert(9, "added")
                words = [w.upper() + "," for w in words]
            truth[i] = item
            text[10:10] = words
        docs.append((i, " ".join(text)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), truth


def test_planted_copies_and_no_others(planted):
    docs, items, truth = planted
    got = {(r.doc_id, r.item_id): r for r in D.find_leaks(docs, items).collect()}
    assert {k[0] for k in got} == set(truth) and all(truth[d] == i for d, i in got)
    exact = [r for (d, _), r in got.items() if d % 8]
    assert all(r.score == 1.0 for r in exact)
    texts = {r.doc_id: r.text for r in docs.collect()}
    item = {r.item_id: r.text for r in items.collect()}
    assert all(texts[r.doc_id][r.start: r.end] == " ".join(item[r.item_id].split()[:64]) or len(item[r.item_id].split()) > 64 for r in exact)


def test_blocks_of_the_benchmark_give_the_same(planted):
    docs, items, _ = planted
    one, many = (sorted(map(tuple, D.find_leaks(docs, items, block_words=n).select("doc_id", "item_id").collect())) for n in (10**6, 150))
    assert one == many


def test_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "looked at the moon over the quiet house by the river while rain fell"), (1, "looked at the moon over the quiet house by the river while rain fell")],
                                  "item_id long, text string")
    got = D.find_leaks(edge_docs, items, min_score=0.9).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "10", "10", "2", "None"]
    assert D.find_leaks(no_docs, items).count() == 0 and D.find_leaks(edge_docs, items.where("false")).count() == 0


@pytest.mark.parametrize("size", [60, 4000])
def test_edited_copies_of_a_hot_item_at_every_corpus_size(spark, size):
    """Every fifth word replaced (score 0.7); nine documents in ten hold the item, which makes its own words frequent."""
    r = random.Random(3)
    prose = lambda n: [r.choice(WORDS) for _ in range(n)]
    item = prose(30)
    docs = []
    for i in range(size):
        copy = [r.choice(WORDS) if k % 5 == 4 else w for k, w in enumerate(item)]
        docs.append((i, " ".join(prose(3) + (prose(30) if i % 10 == 0 else copy) + prose(3))))
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(size) if i % 10]
    assert all(r.score >= 0.69 for r in got)


def test_whatever_reaches_the_score_is_found(spark):
    """Against plain Smith-Waterman of every item in every document: few words, replaced, dropped and inserted ones."""
    r = random.Random(4)
    prose = lambda n: [r.choice(WORDS[:150]) for _ in range(n)]
    items = [(i, prose(r.randint(5, 40))) for i in range(15)]
    docs = []
    for i in range(240):
        words = list(items[i % 15][1])
        if i % 4 == 0:
            words = [x for w in words for x in (w, r.choice(WORDS))]  # a word after each word: half the score, no two side by side
        else:
            rate = r.choice([0.2, 0.3, 0.4])
            words = [x for w in words for x in ([w], [r.choice(WORDS)], [], [w, r.choice(WORDS)])[r.randint(1, 3) if r.random() < rate else 0]]
        docs.append((i, prose(r.randint(0, 20)) + words + prose(r.randint(0, 20))))
    want = {(d, i) for d, words in docs for i, item in items if plain_smith_waterman(item, words) >= D.MIN_SCORE * D.MATCH * len(item)}
    tables = [spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    assert len(want) > 100 and {(x.doc_id, x.item_id) for x in D.find_leaks(*tables).collect()} == want


def brute_words(t):
    import re

    one = "[฀-࿿က-Ⴟក-៿぀-鿿豈-﫿\U00020000-\U00033fff]"
    return re.findall(f"{one}|(?:(?!{one})[A-Za-z0-9\u0080-\U0010ffff])+", t)


def test_words_of_unspaced_scripts():
    r = random.Random(5)
    texts = ["".join(r.choice(["中", "文", "ก", "ひ", "한", "é", "a", "B", "7", " ", ",", "🙂", "𠀀", "က", "ක"]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, start, end, n = D.words_of(buf, off)
    first = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert [bytes(buf[start[k]: end[k]]).decode() for k in range(first[i], first[i + 1])] == brute_words(t)
        assert np.array_equal(h[first[i]: first[i + 1]], D._hashes(t))


def test_short_items_are_found_whole(spark):
    """Items of one to four words: exactly where their word sequence stands, against a plain search."""
    r = random.Random(6)
    prose = lambda n: [r.choice(WORDS[:25]) for _ in range(n)]
    items = [(i, prose(1 + i % 4)) for i in range(40)] + [(90, ["word1", "word1", "word1"]), (91, ["word2"])]
    docs = [(i, prose(r.randint(0, 60))) for i in range(150)] + [(900, []), (901, ["word1"] * 4), (902, ["word2"] * 5)]
    want = {(d, i) for d, w in docs for i, x in items if any(w[k: k + len(x)] == x for k in range(len(w)))}
    tables = [spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = D.find_leaks(*tables).collect()
    assert len(got) == len(want) and {(x.doc_id, x.item_id) for x in got} == want and {x.score for x in got} == {1.0}
    words, item = {i: " ".join(w) for i, w in docs}, dict(items)
    assert all(words[x.doc_id][x.start: x.end] == " ".join(item[x.item_id]) for x in got)
    assert D.find_leaks(*tables, short_items=False).count() == 0


def test_items_in_unspaced_scripts(spark):
    r = random.Random(7)
    signs = [chr(0x4E00 + i) for i in range(400)] + [chr(0x0E01 + i) for i in range(40)]
    prose = lambda n: "".join(r.choice(signs) for _ in range(n))
    items = [(i, prose(r.randint(15, 60))) for i in range(10)]
    docs = []
    for i in range(60):
        copy = items[i % 10][1]
        if i % 3 == 1:  # every seventh sign replaced
            copy = "".join(r.choice(signs) if k % 7 == 3 else c for k, c in enumerate(copy))
        docs.append((i, prose(100) + ("" if i % 3 == 2 else copy) + prose(100)))
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(i, i % 10) for i in range(60) if i % 3 != 2]
    assert all(x.score == 1 for x in got if x.doc_id % 3 == 0)
