"""Connected components by themselves: long chains, hot stars, odd edges."""

import glob
import random

import numpy as np

from tickloom.llm import common, tally
from tickloom.llm import components as module
from tickloom.llm.components import components

from .helpers import documents


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            low, high = sorted((find(u), find(v)))
            root[high] = low
    return {x: find(x) for x in root}


def found(spark, edges):
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


def test_chains_stars_and_odd_edges(spark):
    rnd = random.Random(1)
    chain = list(range(0, 600, 3))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False))  # a long path through shuffled numbers
    edges += [(10_000, 10_000 + i) for i in range(1, 800)] + [(30_000 - i, 20_000) for i in range(1, 300)]  # hot stars, centre small and large
    edges += [(5000, 5000), (5001, 5002), (5002, 5001), (5001, 5002), (-7, 5002)]  # loops, repeats, both directions
    edges += [(40_000 + rnd.randrange(300), 40_000 + rnd.randrange(300)) for _ in range(250)]
    rnd.shuffle(edges)
    assert found(spark, edges) == brute(edges)


def test_rounds_and_one_task_agree(spark, monkeypatch):
    """Graphs over LOCAL edges take rounds on the cluster, small ones none; components are the same."""
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(90)]
    rounds = []
    star = module._star
    monkeypatch.setattr(module, "_star", lambda *a, **k: rounds.append(1) or star(*a, **k))
    assert found(spark, edges) == brute(edges) and not rounds
    monkeypatch.setattr(module, "LOCAL", 100)
    assert found(spark, edges) == brute(edges) and rounds
    monkeypatch.setattr(module, "LOCAL", -1)
    assert found(spark, edges) == brute(edges) and found(spark, []) == {}
    nodes, roots = module.roots(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(nodes) == len(roots) == 0


def test_no_edges(spark):
    assert found(spark, []) == {} == found(spark, [(1, 1)])


def test_rounds_leave_one_table(spark):
    tables = lambda: len(glob.glob(f"{common.shared_dir(spark)}/table-*"))
    before = tables()
    out = components(spark.createDataFrame([(i, i + 1) for i in range(100)], "u long, v long"))
    assert tables() == before + 1 and out.count() == 101


def test_shuffled_documents_are_settled_before_they_are_dealt(spark):
    """Rows are dealt by their place in a partition; a plan whose places may change when it runs again is written first."""
    docs = documents(spark, [(i, f"text {i}") for i in range(50)])
    dealt = lambda df: tally.bucketed(df).rows._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in dealt(docs)
    assert "Scan parquet" in dealt(docs.repartition(3, "doc_id")) and "Scan parquet" in dealt(docs.distinct())
