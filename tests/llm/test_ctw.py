import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from reelrank.llm import ctw as C
from reelrank.llm.common import crc_mod


def flat(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


class Brute:
    """Context-tree weighting by its definition, node by node."""

    def __init__(self, texts):
        self.n = collections.defaultdict(lambda: [0, 0])
        for t in texts:
            for ctx, node, bit in self.decisions(t):
                for k in range(3):
                    self.n[ctx[2 - k:], node][bit] += 1
        self.kids = collections.defaultdict(set)
        for c, node in self.n:
            if c:
                self.kids[c[1:], node].add(c)

    @staticmethod
    def decisions(t):
        t = b"\0\0" + t
        for i in range(2, len(t)):
            node = 1
            for k in range(7, -1, -1):
                bit = t[i] >> k & 1
                yield t[i - 2: i], node, bit
                node = 2 * node + bit

    def kt(self, c, node):
        a, b = self.n.get((c, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, node):
        if (c, node) not in self.n:
            return 0.0
        if len(c) == 2:
            return self.kt(c, node)
        return np.logaddexp(self.kt(c, node), sum(self.weighted(k, node) for k in self.kids[c, node])) - math.log(2)

    def one(self, ctx, node, depth=0):
        c = ctx[2 - depth:]
        a, b = self.n.get((c, node), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if depth == 2:
            return own
        r = self.kt(c, node) - sum(self.weighted(k, node) for k in self.kids[c, node])
        w = 1 / (1 + math.exp(-max(-700, min(700, r))))
        return w * own + (1 - w) * self.one(ctx, node, depth + 1)

    def log10(self, t):
        return sum(math.log10(p if bit else 1 - p) for ctx, node, bit in self.decisions(t) for p in [self.one(ctx, node)])


def test_log_gamma():
    x = np.concatenate([np.linspace(0.5, 40, 400), [1e6, 1e12]])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def test_against_the_definition_and_normalised():
    r = random.Random(0)
    texts = [bytes(r.choice(b"abcab ") for _ in range(60)) for _ in range(15)]
    buf, off = flat(texts)
    u, n = np.unique(C._codes(buf, off).astype(np.int64), return_counts=True)
    m, b = C.FrozenCTW(u, n), Brute(texts)
    probe = [b"abc ab", b"zzq a", b"", b"b", texts[3], "é".encode()]
    assert np.allclose(m.log10_bytes(*flat(probe)), [b.log10(t) for t in probe], atol=1e-4)
    assert np.allclose((10.0 ** m.table).sum(axis=1), 1, atol=1e-4)
    assert len(m.table) <= 65_793


def check(rows, texts):
    """Base scores by counting; rows as (doc_id, text)."""
    token = lambda t: (t or "").encode().lower().split() + [None]
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    count = collections.Counter(w for i, t in texts if train(i) for w in token(t))
    N, V = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t in texts:
        w = token(t)
        want[(str(i), not train(i), len(w), sum(count[x] > 0 for x in w), N, round(sum(math.log10((count[x] + 0.1) / (N + 0.1 * (V + 1))) for x in w), 3))] += 1
    assert collections.Counter((str(r.doc_id), not r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows) == want


def test_documents(sample):
    rows = C.score(sample, crc_mod("doc_id", 10) != 0, chunk_bytes=60_000, shard_bytes=90_000).collect()
    check(rows, [(r.doc_id, r.text) for r in sample.collect()])
    one = C.score(sample, crc_mod("doc_id", 10) != 0).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in rows) == sorted((r.doc_id, round(r.score, 6)) for r in one)
    held = [r for r in rows if not r.train and r.n_tokens > 20]
    assert np.mean([r.bits_per_byte for r in held]) < 4  # an order-0 model needs more


def test_edge_rows(edge_docs, no_docs, edge_rows):
    rows = C.score(edge_docs, crc_mod("doc_id", 10) != 0).collect()
    check(rows, edge_rows)
    assert all(r.score == 0 for r in rows if r.n_tokens == 1 and r.doc_id in (3, 4))
    assert C.score(no_docs, crc_mod("doc_id", 10) != 0).count() == 0
    none = C.score(edge_docs, F.lit(False)).collect()
    assert {r.base_score for r in none} == {None} and all(abs(r.bits_per_byte - 8) < 1e-3 for r in none if r.doc_id in (1, 6))


def deep_brute(train, probe, depth):
    """log10 P of the probes by the definition, for a tree of `depth` context bytes."""
    def steps(t):
        t = b"\0" * depth + t
        for i in range(depth, len(t)):
            for k in range(8):
                yield t[i - depth: i], (1 << k) | (t[i] >> (8 - k)), t[i] >> (7 - k) & 1

    n, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    for t in train:
        for ctx, node, bit in steps(t):
            for k in range(depth + 1):
                n[ctx[depth - k:], node][bit] += 1
                if k:
                    kids[ctx[depth - k + 1:], node].add(ctx[depth - k:])
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below = lambda c, node: sum(weighted(x, node) for x in kids[c, node])
    cache = {}

    def weighted(c, node):
        if (c, node) not in cache:
            e = pe(*n[c, node])
            cache[c, node] = e if len(c) == depth else np.logaddexp(e, below(c, node)) - math.log(2)
        return cache[c, node]

    def one(ctx, node, k):
        a, b = n.get((ctx[depth - k:], node), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if k == depth or a + b == 0:
            return own
        w = 1 / (1 + math.exp(-max(-700, min(700, pe(a, b) - below(ctx[depth - k:], node)))))
        return w * own + (1 - w) * one(ctx, node, k + 1)

    return [sum(math.log10(p if bit else 1 - p) for ctx, node, bit in steps(t) for p in [one(ctx, node, 0)]) for t in probe]


def test_deep_tree_against_the_definition(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["abc", "cab", "xyz ", "é", "a"]) for _ in range(12)) for _ in range(30)] + ["", "b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(C.score(docs, F.col("doc_id") % 3 != 0, chunk_bytes=200, shard_bytes=600).collect(), key=lambda x: x.doc_id)
    raw = [(t or "").encode() for t in texts]
    want = deep_brute([t for i, t in enumerate(raw) if i % 3], raw, C.DEPTH)
    assert C.DEPTH >= 6 and np.allclose([x.score for x in rows], want, atol=1e-3)


def test_words_longer_than_two_bytes_are_learnt(spark):
    """Random words from a list: the later bytes of a word follow from its first ones, not from the last two."""
    r = random.Random(6)
    words = ["".join(r.choice("ab") for _ in range(12)) + " " for _ in range(12)]
    docs = spark.createDataFrame([(i, "".join(r.choice(words) for _ in range(80))) for i in range(60)], "doc_id long, text string")
    held = [x.bits_per_byte for x in C.score(docs, F.col("doc_id") % 6 != 0).collect() if not x.train]
    assert np.mean(held) < 0.6  # two context bytes leave 1.25
