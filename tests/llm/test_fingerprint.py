import hashlib
import random

import numpy as np

from tickloom.llm import fingerprint

from .helpers import AWKWARD, clashing, documents


def plain_digest(text):
    """The digest computed one window at a time."""
    data = text.encode()
    size = len(data)
    counts = [0] * 256
    raw = data.ljust(5, b"\0")
    mask = 2**32 - 1
    for at in range(len(raw) - 4) if size else ():
        for (i, j), salt in zip(fingerprint._PAIRS, fingerprint._SALTS.tolist(), strict=True):
            h = raw[at] | raw[at + i] << 8 | raw[at + j] << 16
            h = (h ^ h >> 11 ^ salt) * 0x9E3779B1 & mask
            counts[((h ^ h >> 15) * salt & mask) >> 24] += 1
    q = [sorted(counts)[64 * k - 1] for k in (1, 2, 3)]
    codes = [sum(c > x for x in q) for c in counts]
    body = bytes(codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, 256, 4))
    top = max(q[2], 1)
    head = bytes([min(255, round(np.log1p(size) / np.log(1.1))), 15 * q[0] // top << 4 | 15 * q[1] // top])
    return (head + body).hex()


def test_digest_matches_plain_loop(monkeypatch):
    rnd = random.Random(1)
    texts = ["", "a", "abcd", "abcde", "naïve \U0001f600"] + ["".join(rnd.choice("abc dé") for _ in range(rnd.randint(1, 900))) for _ in range(30)]
    want = [plain_digest(t) for t in texts]
    assert fingerprint.hexes(fingerprint.digest_rows(texts)) == want
    monkeypatch.setattr(fingerprint, "PIECE", 64)  # pieces must not change the counts
    assert fingerprint.hexes(fingerprint.digest_rows(texts)) == want


def test_scores_are_bounded_and_symmetric():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 256, (2, 500, 66)).astype(np.uint8)
    s = fingerprint.scores(a, b)
    assert (s == fingerprint.scores(b, a)).all() and s.max() <= fingerprint.MOST
    assert (fingerprint.likeness(a, a) == 1).all()


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        fps = fingerprint.digest_rows([text, edited, after])
        near = fingerprint.likeness(fps[[0, 0]], fps[[1, 2]])
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *fingerprint.hexes(fps[:2]), *near))
    return sorted(map(repr, [(*o[:5], float(o[5]), float(o[6])) for o in out]))


def test_report_follows_order(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(rnd.randrange(10**6) * 3, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 80)))) for _ in range(300)]
    got = fingerprint.edit_report(documents(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == brute(rows)


def test_frequent_and_missing_ids_are_cut_by_text(spark):
    """An id, or null, that holds a third of the rows lies in many buckets, and order is kept across them."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    big = 2**52 + 1
    rows = [((big, None, big + rnd.randint(-3, 3))[i % 3], t or None) for i, t in enumerate(texts)]
    docs = documents(spark, rows)
    assert sorted(map(repr, map(tuple, fingerprint.edit_report(docs).collect()))) == brute(rows)
    buckets = {r.doc_id: r for r in fingerprint._followed(docs.select("doc_id", "text")).filter("halo = 0").selectExpr("doc_id", "b").distinct().groupBy("doc_id").count().collect()}
    assert len(buckets) == 8 and buckets[big]["count"] > 3 and buckets[None]["count"] > 3


def test_awkward_rows(spark):
    got = fingerprint.edit_report(clashing(documents(spark, AWKWARD))).collect()
    assert sorted(map(repr, map(tuple, got))) == brute(AWKWARD)
    one = [(7, "alone and edited")]
    assert sorted(map(repr, map(tuple, fingerprint.edit_report(documents(spark, one)).collect()))) == brute(one)
    assert fingerprint.edit_report(documents(spark, [])).collect() == []


def test_column_functions(spark):
    df = documents(spark, AWKWARD).select("doc_id", fingerprint.digest("text").alias("d"))
    rows = df.select(fingerprint.digest_likeness("d", "d").alias("l")).collect()
    assert {r.l for r in rows} == {1.0}
