import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tickloom.llm import simhash
from tickloom.llm.common import hashed_words, mix64

from .helpers import AWKWARD, clashing, documents


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts, all_alike=False):
    """Component of each index, by comparing all pairs: those alike that have a print within the radius, or all alike."""
    sets = [brute_shingles(t) for t in texts]
    prints = simhash.word_prints(pa.array(texts, pa.string()))[1]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b) and (all_alike or np.bitwise_count(prints[i] ^ prints[j]).min() <= simhash.WORD_RADIUS):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(texts))]


def copies(rnd, bases=25, each=8):
    """Texts and edited copies of them, from almost equal to well under 0.8."""
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(bases):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(8, 300))]
        texts.append(" ".join(words))
        for _ in range(each):
            edited = list(words)
            for _ in range(rnd.randint(1, max(1, len(words) // 30))):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocab)
            texts.append(" ".join(edited))
    return texts


def test_prints_equal_plain_loops():
    """Shingle counts and word SimHashes of awkward texts, by plain loops over the words' hashes."""
    texts = [t for _, t in AWKWARD] + copies(random.Random(9), bases=3, each=2)
    sizes, prints = simhash.word_prints(pa.array(texts, pa.string()))
    for text, n, own in zip(texts, sizes.tolist(), prints.tolist(), strict=True):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
        assert n == len(simhash.shingles(text))
        words = sorted(set(low.split()))
        hashes = [int(hashed_words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in words]
        for k, got in enumerate(own):
            mixed = [int(mix64(np.array([(h >> 20) + (2 * k + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1], np.uint64))[0]) for h in hashes]
            assert got == sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed))


def test_covering_finds_what_is_near():
    """Any two prints within WORD_RADIUS agree under some mask."""
    rnd = random.Random(7)
    masks = simhash.covering_masks(list(range(64)), simhash.WORD_RADIUS)
    assert len(masks) == 31
    for _ in range(5000):
        bits = rnd.sample(range(64), simhash.WORD_RADIUS)
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_pieces_change_nothing(monkeypatch):
    texts = pa.array([t for _, t in AWKWARD])
    want = [simhash.word_prints(texts)[i].tolist() for i in (0, 1)], [simhash.simhash(t.as_py()) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 3)
    assert ([simhash.word_prints(texts)[i].tolist() for i in (0, 1)], [simhash.simhash(t.as_py()) for t in texts]) == want


def test_stage_keeps_one_of_near_copies(spark, tmp_path):
    texts = copies(random.Random(1))
    order = random.Random(2).sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    sets = [brute_shingles(t) for t in texts]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= x <= 0.95 for x in alike) > 100 and sum(0.5 < x < 0.8 for x in alike) > 50
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, list(enumerate(texts))), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_groups(texts)))
    near, every = (len(texts) - len(set(brute_groups(texts, all_alike=x))) for x in (False, True))
    assert near >= 0.95 * every


def test_leaders_lose_no_link(spark, monkeypatch):
    """Whether pairs are listed at once or leaders are compared first, components are the same."""
    texts = copies(random.Random(3), bases=4, each=40)
    docs = documents(spark, list(enumerate(texts)))
    want = sorted(set(brute_groups(texts)))
    for turns, leaders in ((0, 1), (1, 1), (3, 2)):
        monkeypatch.setattr(simhash, "TURNS", turns)
        monkeypatch.setattr(simhash, "LEADERS", leaders)
        monkeypatch.setattr(simhash, "DENSE", 0)
        assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == want


def test_awkward_rows(spark):
    docs = clashing(documents(spark, AWKWARD))
    kept = simhash.representatives(docs)
    assert kept.dtypes == docs.dtypes
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 6, 7, 8, 9, 10, 11]
    assert [r.text for r in rows if r.doc_id is None] == ["a null id"]
    assert simhash.representatives(documents(spark, [])).collect() == []


def test_ids_that_repeat_or_are_null(spark):
    """A unique text stays though its doc_id is another row's, and copies without id are one."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(9)) for x in "abc")
    rows = simhash.representatives(documents(spark, [(1, two), (1, one), (0, one), (None, three), (None, three)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted([("0", one), ("1", two), ("None", three)])


def compared(spark, monkeypatch, texts):
    """(doc_ids that stay, number of pairs whose texts were compared)."""
    verified, seen = simhash._verified, []

    def counting(pairs, wanted):
        seen.append(pairs.count())
        return verified(pairs, wanted)

    monkeypatch.setattr(simhash, "_verified", counting)
    kept = simhash.representatives(documents(spark, list(enumerate(texts)))).collect()
    return sorted(r.doc_id for r in kept), sum(seen)


def test_equal_words_in_other_orders_are_not_compared(spark, monkeypatch):
    """All such texts share every bucket, but hardly a shingle: pairs do not grow with the square of their number."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.sample(words, len(words))) for _ in range(60)]
    assert compared(spark, monkeypatch, texts) == (list(range(60)), 0)


def test_shared_shingles_of_unlike_texts_are_hardly_compared(spark, monkeypatch):
    """Each shingle is also another text's and prints are near, so that sketches alone tell most pairs apart."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    halves = [[" ".join(rnd.sample(part, len(part))) for _ in range(7)] for part in (words[:75], words[75:])]
    texts = [f"{a} {b}" for a in halves[0] for b in halves[1]]
    kept, pairs = compared(spark, monkeypatch, texts)
    assert kept == sorted(set(brute_groups(texts))) == list(range(49)) and pairs < 49


def test_sketches_bound_the_difference():
    texts = copies(random.Random(8), bases=3, each=6)
    runs, text, sizes = simhash._runs(pa.array(texts))
    sets = [brute_shingles(t) for t in texts]
    assert sizes.tolist() == [len(x) for x in sets]
    sketch = simhash.sketches(runs, text, len(texts)).view(np.uint64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            bits = int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
            assert bits <= len(a ^ b) and (bits - len(a ^ b)) % 2 == 0
