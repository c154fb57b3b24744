import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import packing

from .helpers import AWKWARD, clashing, documents


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def test_ids_of_words_are_ids_of_texts(plain):
    rnd = random.Random(3)
    parts = ["a", "B", "é", "É", "é", "́", "'", "'s", "'LL", "1", "23", "<|endoftext|>", "<|", ">", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "中", "\U0001f600", "ß", "İ", "ﬁ", "\x00", "!!", ".,", "_", "Σ", "ς", "Hello", "über."]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16))) for _ in range(5000)]
    own = packing.WordTokenizer(packing.vocabulary_path())
    texts += ["x" * n for n in range(40)] + ["ab" * n + "\x00" * m for n in range(9) for m in range(4)] + ["", None, "\x00", "\x00\x00"]
    for text, ids in zip([t or "" for t in texts], own.ids(pa.array(texts)), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    own = packing.WordTokenizer(packing.vocabulary_path())
    for lo in range(0, 300, 10):
        texts = [f"word{i} again, Und so. x{i % 7}" for i in range(lo, lo + 10)]
        for text, ids in zip(texts, own.ids(pa.array(texts)), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_equals_scan():
    rnd = random.Random(4)
    for _ in range(30):
        sizes = [rnd.choice([rnd.randint(1, 4096), rnd.randint(1, 300), 4096]) for _ in range(rnd.randint(1, 200))]
        bins, offsets = packing.first_fit_decreasing(np.array(sizes))
        fill, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, f in enumerate(fill) if f + sizes[i] <= 4096), len(fill))
            if b == len(fill):
                fill.append(0)
            want[i] = (b, fill[b])
            fill[b] += sizes[i]
        assert {i: (int(bins[i]), int(offsets[i])) for i in range(len(sizes))} == want


def check_rows(rows, docs, plain, limit):
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, []).append([*plain.encode(text or "", add_special_tokens=False).ids, packing.END_ID])
    covered, bins = {}, {}
    for r in rows:
        whole = ids[r.doc_id][0]
        assert r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, copies in ids.items():
        want = [at for at in range(0, len(copies[0]), limit) for _ in copies]
        assert sorted(s for s, _ in covered[doc_id]) == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit


def test_round_trip(spark, plain):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta.", "gämma", "12", "Don't", "#!"]) for _ in range(int(10 ** rnd.uniform(0, 4))))) for i in range(300)]
    got = packing.packed(documents(spark, rows), group=100).collect()
    check_rows(got, rows, plain, 4096)
    sequences = {r.sequence_id for r in got}
    assert sum(r.length for r in got) / (4096 * len(sequences)) > 0.9


def test_awkward_rows(spark, plain):
    got = packing.packed(clashing(documents(spark, AWKWARD))).collect()
    check_rows(got, AWKWARD, plain, 4096)
    assert packing.packed(documents(spark, [])).collect() == []
