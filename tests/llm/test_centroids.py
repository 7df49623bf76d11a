import hashlib
import random

import numpy as np

from reelrank.llm import centroids as C


def brute(rows, k, rounds):
    """Lloyd rounds on integers over (id, vector) rows."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and np.isfinite(e) for e in v)]
    x = np.array([[int(np.floor(256 * e)) for e in v] for _, v in rows], dtype=object).reshape(len(rows), 64)
    first = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"2:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), list(x[i])))[:k]
    c = x[first].copy()
    near = lambda v: min(range(len(c)), key=lambda j: (sum((v - c[j]) ** 2), j))
    for _ in range(rounds):
        at = [near(v) for v in x]
        for j in range(len(c)):
            own = [v for v, a in zip(x, at) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i, a, int(sum((v - c[a]) ** 2))) for (i, _), v, a in ((r, v, near(v)) for r, v in zip(rows, x))), key=repr), [list(v) for v in c]


def run(spark, rows, k, rounds, columns=""):
    df = spark.createDataFrame([(i, v, "own", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    got, about = C.cluster(df, k=k, rounds=rounds)
    return sorted([tuple(r) for r in got.collect()], key=repr), [r.centroid for r in sorted(about.collect(), key=lambda r: r.cluster)], about


def test_against_brute_force_with_ties_repeats_and_unusable_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.5]) + (r.gauss(0, 0.01) if i % 3 else 0) for _ in range(64)]) for i in range(90)]
    rows += [rows[5]] * 40 + [(7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]
    rows += [(200, None), (201, []), (202, [0.1] * 63), (203, [0.1] * 65), (204, [None] + [0.1] * 63), (205, [float("nan")] + [0.1] * 63), (206, [float("inf")] + [0.1] * 63)]
    for k, rounds in ((7, 3), (40, 2)):
        got, centroids, about = run(spark, rows, k, rounds)
        assert (got, centroids) == brute(rows, k, rounds)
        assert sum(x["size"] for x in about.collect()) == len(got) == 133


def test_fewer_rows_than_centroids_and_empty_table(spark):
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (2, [-1.0] * 64)]
    got, centroids, _ = run(spark, rows, 40, 5)
    assert got == brute(rows, 40, 5)[0] and len(centroids) == 3
    got, centroids, about = run(spark, [], 40, 5)
    assert got == [] and about.count() == 0


def test_components_beyond_the_limit_are_clamped(spark):
    got, centroids, _ = run(spark, [(1, [1e300] * 64), (2, [-1e300] * 64)], 1, 0)
    assert {abs(e) for e in centroids[0]} == {C.LIMIT} and sorted(d for _, _, d in got) == [0, 64 * 4 * C.LIMIT**2]


def test_walk_equals_all_distances_and_stops_early():
    r = np.random.default_rng(5)
    base = r.integers(-40, 40, (40, 64)) * 50
    x = base[r.integers(0, 40, 3000)] + r.integers(-2, 3, (3000, 64))
    at, far = C.SortedLists(base).nearest(x)
    every = ((x[:, None] - base[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    # an exact hit: every list's next entry is at the centroid, nothing else needs to be met
    tied = np.repeat(base[:2], 2, axis=0)
    at, far = C.SortedLists(tied).nearest(base[:2])
    assert at.tolist() == [0, 2] and far.tolist() == [0, 0]
