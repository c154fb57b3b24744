import math

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, qid int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash", 1) for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    good = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for i, v in good:
        if i % every == 0:
            d = sorted((math.dist(v, w), j) for j, w in good if j != i)
            out[i] = d[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16))
    rows = [(i, (centers[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(6000)]
    got, want = {}, brute(rows)
    for r in multi_index.search_report(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    exact = dict(rows)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        for _, i, s in found:
            assert abs(s - math.dist(np.float32(exact[q]).tolist(), np.float32(exact[i]).tolist())) < 1e-12
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
    assert got.keys() == want.keys() and hits / (10 * len(want)) >= 0.9


def test_matrix_product_loses_nothing():
    """Far from the origin, where squared distances round most, and with ties: the same rows as by plain distances."""
    rng = np.random.default_rng(3)
    x = np.float32(rng.normal(size=(700, 12)) + 1000).astype(np.float64)
    x[500:520] = x[7]
    at, queries = rng.integers(0, 40, 700), x[::9]
    visited = [rng.choice(45, rng.integers(1, 30), replace=False) for _ in queries]
    for (some, d), q, cells in zip(multi_index.near_sets(x, at, queries, visited, 5), queries, visited, strict=True):
        inside = np.flatnonzero(np.isin(at, cells))
        exact = multi_index.distances(x[inside], q)
        order = np.lexsort((inside, exact))[:5]
        best = np.lexsort((some, d))[:5]
        assert some[best].tolist() == inside[order].tolist() and d[best].tolist() == exact[order].tolist()


def test_recall_holds_at_two_sizes(spark):
    """Hard, nearly isotropic vectors: recall at two sizes, and candidates counted by what the index visits."""
    rng = np.random.default_rng(4)
    for n in (1500, 6000):
        rows = [(i, rng.normal(size=16).tolist()) for i in range(n)]
        want, got = brute(rows), {}
        for r in multi_index.search_report(table(spark, rows)).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert sum(len(got[q] & {i for _, i in near}) for q, near in want.items()) >= 0.95 * 10 * len(want)


def test_visits_follow_the_sums():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    sizes = rng.integers(0, 3, 63)
    order = [c for c in np.argsort(np.add.outer(a, b).ravel()).tolist() if sizes[c]]
    for wanted in (1, 5, 20, 1000):
        got = multi_index.visits(a, b, sizes, wanted)
        assert got == order[: len(got)] and (sizes[got].sum() >= wanted or len(got) == len(order))


def test_frequent_vectors_and_ties(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1, 900)] + [(i, [1.0, 2.0, 3.5 + i / 7]) for i in range(900, 1000)] + [(0, [1.0, 2.0, 3.0])]
    got = {}
    for r in multi_index.search_report(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [i for _, i in sorted(got[0])] == list(range(1, 11))
    assert [i for _, i in sorted(got[300])] == list(range(10))
    assert [i for _, i in sorted(got[900])] == [i for _, i in brute(rows)[900]]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (0, [1, 0]), (100, [0, 1]), (200, None), (300, [0, 0]), (400, [nan, 1]), (500, [inf, 1]), (600, [None, 1]), (7, [1, 1]), (None, [1, 1]), (700, [1, 2, 3]), (800, [])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in multi_index.search_report(table(spark, rows)).collect())
    assert got == [(0, 1, 7), (0, 2, 100), (100, 1, 7), (100, 2, 0)]
    assert multi_index.search_report(table(spark, [])).collect() == []
    assert multi_index.search_report(table(spark, [(100, [1, 2])])).collect() == []
    assert multi_index.search(table(spark, rows), F.col("id") == 7, k=1).count() == 1
