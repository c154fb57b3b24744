import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.llm import importance

from .helpers import AWKWARD, clashing, documents


def corpus(n=1200, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        junk = rnd.random() < 0.2
        words = [rnd.choice(vocab[:100]) + ("!!" if junk else "") for _ in range(rnd.randint(20, 120))]
        rows.append((i, " ".join(words)))
        if rnd.random() < 0.4:
            labels.append((i, int(not junk), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def brute_weights(rows, labels):
    """{doc_id: (n-grams, weight)} by plain loops over n-gram counts."""
    own = {}
    for i, text in rows:
        slots, _ = importance.features(pa.array([text]))
        own[i] = Counter(slots.tolist())
        assert sum(own[i].values()) == max(0, 2 * len(text.split()) - 1)
    target, known = {i for i, q, _ in labels if q}, {i for i, _, _ in labels}
    t, seen, c = Counter(), Counter(), Counter()
    for i, s in own.items():
        c.update(s)
        if i in known:
            seen.update(s)
        if i in target:
            t.update(s)
    f = sum(t.values()) / sum(c.values())
    a = importance.PRIOR
    return {i: (sum(s.values()), sum(n * math.log((t[x] - n * (i in target) + a) / ((c[x] - n) * f + a)) for x, n in s.items() if seen[x] > n * (i in known))) for i, s in own.items()}


def test_weights_match_plain_loop(spark):
    rows, labels = corpus(300)
    want = brute_weights(rows, labels)
    got = importance.weigh(documents(spark, rows).select("doc_id", "text"), spark.createDataFrame(labels, LABELS)).select("row.doc_id", "n_features", "weight").collect()
    assert len(got) == len(rows)
    assert all(r.n_features == want[r.doc_id][0] and abs(r.weight - want[r.doc_id][1]) < 1e-9 for r in got)


def test_selection_is_plain_gumbel_top_k(spark):
    """The rows selected are the k largest sums of tempered weight and noise, both found by plain loops."""
    rows, labels = corpus(400, seed=3)
    docs, marked = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    weights = brute_weights(rows, labels)
    tempered = {i: importance.TEMPER * w / (n + importance.NEUTRAL) for i, (n, w) in weights.items()}
    for seed, k in ((1, 100), (2, 100), (3, None)):
        noise = {r.doc_id: r.g for r in docs.select("doc_id", importance.gumbel(F.col("doc_id"), seed).alias("g")).collect()}
        if k is None:
            least = np.quantile([tempered[i] for i, q, _ in labels if q], 1 - importance.KEEP)
            k = sum(v >= least for v in tempered.values())
        want = sorted(tempered, key=lambda i: -tempered[i] - noise[i])[:k]
        got = {r.doc_id for r in importance.select(docs, marked, k=None if seed == 3 else k, seed=seed).collect() if r.selected}
        assert got == set(want)


def test_sampling_follows_the_weights(spark):
    """Over many seeds, how often a document is selected is what its weight and independent noise give; seeds differ where weights are near the bound."""
    n, k, seeds = 300, 100, 120
    weights = np.linspace(-4, 4, n)
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    noise = np.zeros((seeds, n))
    for r in ids.select("doc_id", *[importance.gumbel(F.col("doc_id"), s).alias(f"g{s}") for s in range(seeds)]).collect():
        noise[:, r.doc_id] = r[1:]
    assert abs(noise.mean() - 0.5772) < 0.02 and abs(noise.std() - 1.2825) < 0.02
    taken = lambda z: (lambda key: key >= np.partition(key, n - k, axis=1)[:, n - k, None])(weights + z)
    got, want = taken(noise).mean(axis=0), taken(np.random.default_rng(7).gumbel(size=(4000, n))).mean(axis=0)
    assert np.abs(got.reshape(30, 10).mean(axis=1) - want.reshape(30, 10).mean(axis=1)).max() < 0.06
    first, second = taken(noise[:2])
    expected = 2 * (want * (1 - want)).sum()
    assert 0.6 * expected < (first != second).sum() < 1.4 * expected and expected > 30


def test_rejects_junk_and_keeps_clean(spark):
    rows, labels = corpus()
    out = [i for i, _, _ in labels if i % 2]  # labels held back
    shown = spark.createDataFrame([x for x in labels if not x[0] % 2], LABELS)
    got = {r.doc_id: r.selected for r in importance.select(documents(spark, rows), shown).collect()}
    clean = [i for i in out if "!!" not in rows[i][1]]
    junk = [i for i in out if "!!" in rows[i][1]]
    assert sum(got[i] for i in clean) / len(clean) > 0.95
    assert sum(got[i] for i in junk) / len(junk) < 0.1


def test_each_row_is_judged_by_itself(spark):
    """Junk that shares its id, or has none, goes; clean text with the same id stays; all columns stay."""
    rows, labels = corpus()
    junk, clean = (next(t for _, t in rows if ("!!" in t) == bad) for bad in (True, False))
    more = [(5000, junk), (5000, clean), (None, junk), (None, clean), (None, clean)]
    docs = clashing(documents(spark, rows + more))
    got = importance.selected(docs, spark.createDataFrame(labels, LABELS))
    assert got.dtypes == docs.dtypes
    assert sorted((str(r.doc_id), "!!" in r.text) for r in got.collect() if r.doc_id in (None, 5000)) == [("5000", False), ("None", False), ("None", False)]


def test_kth_largest(spark):
    rnd = random.Random(2)
    values = [rnd.choice([rnd.gauss(0, 1), 0.5, -1e6, 1e-9]) for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 500, 14_000, 29_999, 30_000):
        assert importance.kth_largest(df, k) == order[k - 1]
    assert importance.kth_largest(df, 0) is None


def test_awkward_rows(spark):
    labels = "doc_id long, quality int, toxic int"
    some = spark.createDataFrame([(1, 1, None), (1, 1, 0), (6, 0, 1), (None, 1, 0), (7, None, None)], labels)
    docs = clashing(documents(spark, AWKWARD))
    rows = importance.select(docs, some).collect()
    assert len(rows) == len(AWKWARD) and all(r.weight == 0 for r in rows if r.n_features == 0)
    none = spark.createDataFrame([], labels)
    assert all(r.selected for r in importance.select(docs, none).collect())
    assert importance.select(documents(spark, []), some).collect() == []
    assert importance.selected(docs, none).count() == len(AWKWARD) and importance.selected(docs, some).columns == docs.columns
    assert not any(r.selected for r in importance.select(docs, some, k=0).collect())
