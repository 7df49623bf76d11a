import random

import numpy as np
import pytest
import xxhash

from reelrank.llm import simhash as S


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i: i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    count = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def brute_components(rows, fps, distance=2):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, d in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def family(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 300)}"
    rows = []
    for _ in range(40):
        base = [word() for _ in range(r.choice([1, 2, 3, 4, 40, 200]))]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if r.random() < 0.3 else "\t".join(copy))
    return rows


def test_against_all_pairs(spark):
    texts = family(1) + [None, "", " \n", "a", "Ünïcödé ÉÉ é", None]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    rows += rows[:3] + [(None, texts[0]), (None, "nobody else has this text at all")]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip((d for d, _ in rows), (f"{f:016x}" for f in fps), brute_components([d for d, _ in rows], fps)), key=repr)
    df = spark.createDataFrame([(d, t, "own", "own") for d, t in rows], "doc_id long, text string, component_id string, fp string")
    assert sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=repr) == want


def test_edges(spark, edge_docs, no_docs, edge_rows):
    got = S.near_duplicates(edge_docs).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=repr) == sorted(((d, f"{brute_fingerprint(t):016x}") for d, t in edge_rows), key=repr)
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert S.near_duplicates(no_docs).count() == 0
    assert S.near_duplicates(edge_docs.where("doc_id = 6")).first().component_id == 6


def codes(n, seed):
    """Chains, dense balls and free fingerprints."""
    r = random.Random(seed)
    out = {0, 2**64 - 1}
    centre = r.getrandbits(64)
    while len(out) < n:
        kind = r.random()
        if kind < 0.4:
            x = centre ^ sum(1 << b for b in r.sample(range(14), r.randint(0, 5)))
        elif kind < 0.7:
            x = r.choice(list(out)) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
        else:
            x = r.getrandbits(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("leaf,fanout,partition", [(16, 4, 128), (64, 64, 4096), (4096, 64, 1 << 16)])
def test_index_finds_every_link(spark, leaf, fanout, partition):
    fps = np.array(codes(900, leaf), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    blocks = S.leaf_blocks(df, len(fps), leaf, fanout, partition).cache()
    assert sum(len(r.fps) for r in blocks.collect()) == 8 * len(fps)
    pairs = S.block_pairs(blocks, 2, fanout).collect()
    assert len(pairs) == len(set(pairs))
    links = S.block_links(blocks, S.block_pairs(blocks, 2, fanout)).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    assert all((int(fps[at[r.a]]) ^ int(fps[at[r.b]])).bit_count() <= 64 for r in links)
    node, root = S.forest([(np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))], len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    want_node, want_root = S.forest([np.nonzero(np.triu(near, 1))], len(fps))
    assert node.tolist() == want_node.tolist() and root.tolist() == want_root.tolist()


def test_near_pairs_are_all_and_only_the_near_ones():
    fps = np.array(codes(1500, 9), np.uint64)
    x, y = fps[::2], fps[1::2]
    for a, b, same in ((x, y, False), (x, x, True)):
        found = {(int(i), int(j)) for p, q in S.near_pairs(a, b, same) for i, j in zip(p, q)}
        p, q = np.nonzero(np.bitwise_count(a[:, None] ^ b[None]) <= 2)
        assert found == {(i, j) for i, j in zip(p.tolist(), q.tolist()) if not same or i < j}


def test_gray_order_neighbours_differ_in_one_bit(spark):
    n = 64
    df = spark.range(n).selectExpr("id ^ shiftright(id, 1) AS fp")
    got = [r.fp for r in df.orderBy(S.gray_rank(df.fp)).collect()]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(got, got[1:])) and got == [i ^ i >> 1 for i in range(n)]
