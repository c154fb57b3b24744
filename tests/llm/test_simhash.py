import random

import xxhash

from tickloom.llm import simhash

from .helpers import AWKWARD, clashing, documents


def brute(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, radius=2):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    for _, text in AWKWARD:
        assert simhash.simhash(text) == brute(text)


def test_masks_cover_every_pair():
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_components_equal_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 120))) for _ in range(40)]
    rows = []
    for i in range(400):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((1000 + i, " ".join(words)))
    fps = {i: brute(t) for i, t in rows}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.component_report(documents(spark, rows)).collect()}
    want = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_crowded_buckets_lose_no_link(spark):
    """Hundreds of fingerprints within a ball share buckets beyond SPLIT: deeper levels must find the same links."""
    rnd = random.Random(6)
    center = rnd.getrandbits(64)
    fps = {center} | {center ^ 1 << i ^ 1 << j for i in range(64) for j in range(i, 64, 3)} | {rnd.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = [(r.u, r.v) for r in simhash.links(df).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 2 for u, v in edges)
    got = {}

    def find(x):
        while got.get(x, x) != x:
            x = got[x]
        return x

    for u, v in edges:
        got[find(u)] = find(v)
    want = brute_components({simhash.signed(f): f for f in fps})
    groups = lambda root: sorted(sorted(x for x in want if root(x) == r) for r in {root(x) for x in want})
    assert groups(find) == groups(want.get)


def test_awkward_rows(spark):
    docs = clashing(documents(spark, AWKWARD))
    rows = simhash.component_report(docs).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1
    assert by[3].fingerprint == "0" * 16 and by[3].component_id == by[4].component_id == by[5].component_id == 3
    assert simhash.component_report(documents(spark, [])).collect() == []
