import random

from reelrank.llm import neardup as N
from reelrank.llm.graph import components


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, pct):
    """component of every row: all pairs."""
    sets, parent = [sets_of(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= pct * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return [(doc, len(sets[i]), ids.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def family(seed):
    """Documents with chains of edited copies, copies of one text, and a passage that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 500)}"
    shared = [word() for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy + (shared if r.random() < 0.5 else [])).upper() if r.random() < 0.2 else " ".join(copy))
            if r.random() < 0.5:
                base = copy
    rows += [" ".join(shared + [word() for _ in range(30)]) for _ in range(30)]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark):
    for seed, k, pct in ((1, 4, 80), (3, 3, 60)):
        rows = family(seed)
        got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=k, threshold_pct=pct).collect()}
        assert [got[d] for d, _ in rows] == brute(rows, k, pct)


def test_blocks_of_a_list(spark, monkeypatch):
    rows = family(5)
    whole = sorted(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    monkeypatch.setattr(N, "BLOCK", 7)
    assert sorted(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == whole


def test_match_threshold():
    assert N.match_threshold(64, 80, 1e-6) == 34 and N.match_threshold(10, 80, 1e-3) >= 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(edge_docs, no_docs, edge_rows):
    got = N.near_duplicates(edge_docs).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(edge_rows, 5, 80), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert N.near_duplicates(no_docs).count() == 0
