import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from reelrank.llm import periodic as P
from reelrank.llm import queries as Q


def brute(x, least=12):
    """Every run (start, length, period) by all distances."""
    n, got = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                got.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in got.items()), key=lambda r: (r[0], r[2]))


def texts(seed, count=60):
    r = random.Random(seed)
    out = []
    for _ in range(count):
        n, v = r.choice([0, 1, 11, 12, 13, 40, 150, 500]), r.choice([1, 2, 3, 12, 10_000])
        x = [r.randrange(v) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n > 12:
                p, a = r.randint(1, n // 2), r.randrange(n)
                for i in range(a + p, r.randint(a, n)):
                    x[i] = x[i - p]
        out.append(x)
    return out


@pytest.mark.parametrize("seed,least", [(1, 12), (2, 12), (3, 5)])
def test_runs_against_all_distances(seed, least):
    docs = texts(seed)
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    doc, start, length, period = (c.tolist() for c in P.runs(np.array([w for d in docs for w in d], np.int64), off, least))
    assert list(zip(doc, start, length, period)) == [(i, *r) for i, d in enumerate(docs) for r in brute(d, least)]


def test_short_runs_are_refused():
    with pytest.raises(ValueError):
        P.runs(np.zeros(3, np.int64), np.array([0, 3]), 4)


@pytest.mark.parametrize("n", [16, 64, 65536, 1 << 17])
def test_transform_gives_exact_correlations(n):
    t, r = P.Transform.of(n), np.random.default_rng(n)
    a, b = r.integers(0, t.p, (n, 2)), np.zeros((n, 2), np.int64)
    b[:3] = r.integers(0, t.p, (3, 2))
    got = t.inverse(t.reduce(t.forward(a.copy()) * t.forward(b.copy()))) % t.p
    want = sum(np.roll(a, k, axis=0).astype(object) * b[k].astype(object) for k in range(3)) % t.p
    assert (got == want.astype(np.int64)).all()


def test_long_texts_and_large_transforms():
    r = np.random.default_rng(1)
    x = r.integers(0, 200_000, 300_000)
    x[1000: 271_000] = np.tile(x[1000: 91_000], 3)
    started = time.time()
    got = [tuple(int(c[0]) for c in P.runs(x, np.array([0, len(x)]))[1:])]
    assert got == [(1000, 270_000, 90_000)] and time.time() - started < 120
    got = P.runs(np.zeros(20_000, np.int64), np.array([0, 20_000]))
    assert [c.tolist() for c in got] == [[0], [0], [20_000], [1]]


def test_zeros_that_are_no_match_are_thrown_out():
    """Numbers a multiple of the prime apart vanish in the transform and must not count as equal words."""
    x = np.arange(40) % 8
    y = x.copy()
    y[20] += P.FERMAT[0]
    off = np.array([0, 40])
    assert [tuple(int(v) for v in r) for r in zip(*P.runs(y, off)[1:])] == brute(y.tolist())
    y = np.arange(60) * P.FERMAT[0]
    assert len(P.runs(y, np.array([0, 60]))[0]) == 0


def rewritten(doc_id, words):
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text, plant=True):
    words = (text or "").encode().split()
    words = rewritten(doc_id, words) if plant else words
    known = {}
    runs = brute([known.setdefault(w, len(known)) for w in words])
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_operator_on_edges(spark, edge_docs, no_docs, edge_rows):
    short = [(d, t) for d, t in edge_rows if t is None or len(t) < 100_000]
    ids = edge_docs.where("text is null or length(text) < 100000")
    got = P.find_runs(ids).collect()
    want = [(d, *expected(d, t, False)) for d, t in short]
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed.encode()) for r in got), key=repr) == sorted(want, key=repr)
    assert P.find_runs(no_docs).count() == 0
    long = P.find_runs(edge_docs.where("doc_id = 6")).first()
    assert all(r.length >= max(12, 2 * r.period) for r in long.runs)


def test_query_against_brute_force(spark, sample, tmp_path):
    sample.where("length(text) < 3000").write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = {r.doc_id: r for r in Q.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) > 50
    planted = 0
    for row in rows:
        runs, rest = expected(row.doc_id, row.text)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        r = got[row.doc_id]
        planted += r.n_runs > 0
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *top, 1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(rest).hexdigest()
    assert planted > 5
