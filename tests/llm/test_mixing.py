import random

from tickloom.llm import mixing

from .helpers import AWKWARD, clashing, documents


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_equal_sharing_by_hand(spark):
    rnd = random.Random(1)
    for n in (1, 2, 7, 23):
        sizes = {f"s{i}": int(10 ** rnd.uniform(0, 5)) for i in range(n)} | {None: 40}
        df = spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = water(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_emits_what_the_report_says(spark):
    rnd = random.Random(2)
    docs = documents(spark, [(i, "w " * rnd.randint(0, 60), f"s{rnd.randint(0, 5) ** 2}") for i in range(800)])
    report = {r.doc_id: r for r in mixing.mixture_report(docs).collect()}
    taken = {}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len((r.text or "").split())
    assert all(taken.get(i, 0) == r.taken <= 3 * r.size for i, r in report.items())
    sums = {}
    for d in docs.collect():
        t = sums.setdefault(d.source, [0, 0.0])
        t[0] += report[d.doc_id].taken
        t[1] = report[d.doc_id].target
    assert all(abs(a - b) < 0.25 * b + 100 for a, b in sums.values())


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Rates are broadcast after their number is known: no exchange of documents. Beyond the bound the result is the same."""
    rnd = random.Random(3)
    docs = documents(spark, [(i if i % 9 else None, "w " * rnd.randint(0, 60), rnd.choice(["a", "a", "a", None, f"s{i}"])) for i in range(300)])
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(mixing.mix(docs)), rows(mixing.mixture_report(docs))
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert (rows(mixing.mix(docs)), rows(mixing.mixture_report(docs))) == want


def test_awkward_rows(spark):
    docs = clashing(documents(spark, [(*r, None if i % 3 else "z") for i, r in enumerate(AWKWARD)]))
    rows = mixing.mixture_report(docs).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    mixed = mixing.mix(docs)
    assert mixed.dtypes == docs.dtypes and {v for r in mixed.collect() for c, v in r.asDict().items() if c.startswith("__")} == {"clash"}
    empty = documents(spark, [])
    assert mixing.mixture_report(empty).collect() == [] and mixing.mix(empty).collect() == []
    blank = documents(spark, [(1, None), (2, "")])
    assert [r.taken for r in mixing.mixture_report(blank).collect()] == [0, 0]
