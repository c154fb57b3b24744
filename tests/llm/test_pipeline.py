import random
from collections import Counter

import corpus_pipeline
from tickloom.llm import importance, mixing, packing

from .helpers import clashing, documents
from .test_packing import check_rows
from .test_simhash import brute, brute_components


def test_run_equals_stages_by_hand(spark, tmp_path):
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(500)]
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    rows = []
    for i in range(300):
        junk = i % 7 == 0
        words = [rnd.choice(vocab[:40] if junk else vocab[:150]) + ("!!" if junk else "") for _ in range(rnd.randint(30, 120))]
        text = " ".join(words) + ("\n" + passage if i % 10 == 1 else "")
        rows.append((i, text, f"s{i % 5}"))
    rows += [(1000 + i, rows[2][1], "s9") for i in range(20)]
    docs = documents(spark, rows)
    # labels are a random sample of all documents, copies included, as the models take them to be
    labels = spark.createDataFrame([(i, int(i >= 1000 or i % 7 != 0), 0) for i, _, _ in rows if rnd.random() < 0.5], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    chosen = {r.doc_id for r in importance.select(docs, labels).collect() if r.selected}
    texts = {i: t for i, t, _ in rows if i in chosen}
    junk = [i for i, _, _ in rows if i < 300 and i % 7 == 0]
    assert sum(i in chosen for i in junk) < 0.2 * len(junk)
    assert sum(i in chosen for i, _, _ in rows if i not in junk) > 0.95 * (len(rows) - len(junk))
    groups = brute_components({i: brute(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    split = {i: t.encode().split() for i, t in texts.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    kept = []
    for i, words in split.items():
        gone = {x for k in range(len(words) - 34) if seen[tuple(words[k : k + 35])] > 1 for x in range(k, k + 35)}
        text = b" ".join(w for k, w in enumerate(words) if k not in gone).decode() if gone else texts[i]
        kept.append((i, text, next(s for j, _, s in rows if j == i)))
    assert any(passage not in t for _, t, _ in kept)
    mixed = documents(spark, kept)
    want = [(r.doc_id, r.text) for r in mixing.mix(mixed).collect()]

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    check_rows(got, want, Tokenizer.from_file(packing.vocabulary_path()), 4096)


def test_stages_keep_columns(spark, tmp_path):
    docs = clashing(documents(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (None, None, None), (2, "", "t")]))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != "pack":
                assert out.dtypes == docs.dtypes
            out.collect()
