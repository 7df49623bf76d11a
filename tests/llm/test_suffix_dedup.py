import collections
import hashlib
import random

import numpy as np
import pytest

from reelrank.llm import suffix_dedup as S


def brute(rows, length):
    seen = collections.Counter(b[i: i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for doc, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                gone[i: i + length] = True
        out.append((doc, len(b), int(gone.sum()), len(S._ranges(gone)), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest(),
                    ",".join(f"{s}:{e}" for s, e in S._ranges(gone).tolist())))
    return out


def test_difference_covers():
    for length in (400, 100, 40, 12, 3, 1):
        v, d = S.difference_cover(length)
        assert v <= max(1, length * 4 // 5) and 0 in d
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def passages(seed, length):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdé ") for _ in range(r.randint(length // 2, 3 * length))) for _ in range(6)]
    rows = [(i, "".join(r.choice(known) if r.random() < 0.4 else "".join(r.choice("xyzuvw ") for _ in range(r.randint(1, length))) for _ in range(r.randint(0, 8)))) for i in range(120)]
    return rows + [(200, "a" * 500), (201, ""), (202, rows[0][1]), (203, "ab" * 100), (204, None), (205, rows[1][1][3:]), (205, rows[1][1][3:])]


@pytest.mark.parametrize("length,seed", [(40, 1), (25, 3), (12, 4)])
def test_against_brute_force(spark, length, seed):
    rows = passages(seed, length)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.repeated_bytes(df, length=length, chunk_bytes=5000, bucket_bytes=9000).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, length))


def test_edge_rows(edge_docs, no_docs, edge_rows):
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, S.repeated_bytes(edge_docs).collect()), key=key) == sorted(brute(edge_rows, 400), key=key)
    assert S.repeated_bytes(no_docs).count() == 0
