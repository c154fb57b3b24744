import hashlib
import random
from collections import Counter

from tickloom.llm import substrings

from .helpers import AWKWARD, clashing, documents


def brute(rows, window=35):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if seen[tuple(words[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(spark, rows):
    return sorted(repr(tuple(r)) for r in substrings.removal_report(rows).collect())


def test_cover_reaches_every_pair():
    period, cover = substrings.PERIOD, set(substrings.COVER)
    for i in range(period):
        for j in range(period):
            assert any((i + k) % period in cover and (j + k) % period in cover for k in range(period))


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(50)] + ["ünï", "(x)"]
    passages = [[rnd.choice(vocab) for _ in range(n)] for n in (20, 34, 35, 36, 50, 90, 200)]
    rows = []
    for i in range(150):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages)
            a = rnd.randint(0, max(0, len(p) - 40))
            at = rnd.randint(0, len(words))
            words[at:at] = p[a : a + rnd.randint(30, 120)]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, "loop " * 100), (2001, "a b c " * 40)]
    assert got(spark, documents(spark, rows)) == brute(rows)


def test_awkward_rows(spark):
    assert got(spark, clashing(documents(spark, AWKWARD))) == brute(AWKWARD)
    assert got(spark, documents(spark, [])) == []
    assert got(spark, documents(spark, [(1, None), (2, "")])) == brute([(1, None), (2, "")])


def test_texts_are_dealt_out_once(spark):
    plan = substrings.removal_report(documents(spark, AWKWARD))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 2
