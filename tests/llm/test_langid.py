import random
import zlib

import numpy as np

from tickloom.llm import langid

from .helpers import AWKWARD, clashing, documents


def brute_slots(text):
    data = b" " + text.lower().encode() + b" "
    grams = {(n, data[i : i + n]) for n in langid.ORDERS for i in range(len(data) - n + 1)}
    out = set()
    for n, g in grams:
        v = int.from_bytes(g, "little")
        s = ((v ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) ^ v >> 15
        out.add((s * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - langid.BITS)
    return out


def test_spectra_match_plain_sets():
    rnd = random.Random(1)
    texts = ["", "a", "Äb", "\U0001f600"] + ["".join(rnd.choice("abcdé ß") for _ in range(rnd.randint(0, 300))) for _ in range(20)]
    for row, text in zip(langid.spectra(texts), texts, strict=True):
        assert set(np.flatnonzero(row).tolist()) == brute_slots(text)


def corpus(n=500):
    rnd = random.Random(2)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["ströh", "ung", "ver"], "cc": ["eau", "oux", "ment"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(list(syllables))
        words = ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(2, 40))]
        rows.append((i, " ".join(words), "s", lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in langid.language_report(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for doc_id, _, _, _ in rows:
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
    out = [r for r in rows if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[3] for r in out) > 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nystroem_equals_exact_kernel_ridge():
    """With every row a landmark the regressions are those of kernel ridge regression, solved here in its dual form."""
    rows = corpus(120)
    train, rest = rows[:80], rows[80:]
    labels, n = [r[3] for r in train], len(train)
    languages = sorted(set(labels))
    unit = lambda m: m / np.sqrt(np.maximum(1, m.sum(axis=1, keepdims=True)))
    x, y = (unit(langid.spectra([r[1] for r in part]).astype(np.float64)) for part in (train, rest))
    weight = np.array([n / (len(languages) * labels.count(c)) for c in labels])
    target = np.array([[1.0 if c == d else -1.0 for d in languages] for c in labels])
    dual = np.linalg.solve(x @ x.T + 1 + langid.RIDGE * n * np.diag(1 / weight), target)  # + 1: the constant feature
    want = (y @ x.T + 1) @ dual
    model = langid.fit(langid.spectra([r[1] for r in train]), labels, landmarks=10**6)
    assert model.languages == languages
    assert np.abs(model.scorer()([r[1] for r in rest]) - want).max() < 1e-2


def test_letters_are_category_l(spark):
    """Numerals, fractions, circled digits, signs and marks are no letters; letters of any script are."""
    none = ["½ ² ①", "Ⅷ Ⅻ ↈ", "一二".translate({0x4E00: "٣", 0x4E8C: "৪"}), "ª".replace("ª", "_"), "\u0301\u0308", "€ + 12 %"]
    some = ["½ a", "中", "ª", "²é", "ʰ"]
    rows = [(i, t, "s", "en") for i, t in enumerate(["some words of text"] * 20 + none + some)]
    got = {r.doc_id: r for r in langid.language_report(documents(spark, rows)).collect()}
    assert [(got[20 + i].lang_pred, got[20 + i].score) for i in range(len(none))] == [("und", 0.0)] * len(none)
    assert all(got[20 + len(none) + i].lang_pred == "en" for i in range(len(some)))


def test_sample_of_a_language_is_taken_in_parts(spark, monkeypatch):
    """The rows learned from are those of the smallest lots, whatever the parts they are taken from first."""
    docs, models = documents(spark, corpus(300)), []
    for spread in (1, 7):
        monkeypatch.setattr(langid, "SPREAD", spread)
        models.append(langid.learn(docs, per_language=20))
    assert (models[0].landmarks == models[1].landmarks).all() and np.allclose(models[0].coefficients, models[1].coefficients)


def test_held_out_labels_are_not_read(spark):
    rows = corpus(200)
    lied = [(*r[:3], "zz") if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r for r in rows]
    a, b = (sorted(map(tuple, langid.language_report(documents(spark, x)).collect())) for x in (rows, lied))
    assert a == b


def test_awkward_rows(spark):
    rows = [(*r, "s", None if i % 4 == 0 else "en") for i, r in enumerate(AWKWARD)] + [(12, "123 456 _ !", "s", "en")]
    got = langid.language_report(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (3, 4, 5, 12)} == {("und", 0.0)}
    assert {r.lang_pred for r in got if r.doc_id in (1, 9)} == {"en"}
    docs = clashing(documents(spark, rows))
    named = langid.predict(docs, langid.learn(docs))
    assert [c for c in docs.columns if c != "text"] == named.select("row.*").columns and named.count() == len(rows)
    assert langid.language_report(documents(spark, [])).collect() == []
    unlabelled = documents(spark, [(1, "text", "s", "en")]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert [r.lang_pred for r in langid.language_report(unlabelled).collect()] == ["und"]
