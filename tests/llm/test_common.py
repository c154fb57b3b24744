import glob
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.llm import common


def test_words_and_hashes():
    rnd = random.Random(1)
    texts = ["", None, " ", "a", "ab", "\x1c x\xa0y", "é" * 10] + ["".join(rnd.choice("ab é\n\t\x0b\r\x0c") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    hashes, firsts = common.hashed_words(*common.text_buffer(pa.array(texts)))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(firsts).tolist() == [len(w) for w in want]
    seen = {}
    for word, h in zip([x for w in want for x in w], hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_slices(monkeypatch):
    text = "x" * 700_000 + " end " + "y " * 300_000 + "end"
    hashes, _ = common.hashed_words(*common.text_buffer(pa.array([text, "end"])))
    assert len(hashes) == 300_004
    assert hashes[1] == hashes[-1] == hashes[-2] and len(set(hashes.tolist())) == 3


def test_sliced_arrays():
    column = pa.array(["a b", "c", None, "d e f"]).slice(1)
    hashes, firsts = common.hashed_words(*common.text_buffer(column))
    assert np.diff(firsts).tolist() == [1, 0, 3]


def test_windows():
    words = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    h = common.window_hashes(words, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(common.window_hashes(words, 8)) == 0


def test_materialize_leaves_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    files = lambda: len(glob.glob(f"{spark.conf.get('spark.local.dir')}/blockmgr-*/*/shuffle_*"))
    before = files()
    out = common.materialize(df)
    assert files() <= before
    assert out.count() == 7
    assert spark.conf.get(common._CLEANUP, None) in (None, "false")


def test_discard_deletes_what_was_written(spark):
    path = common.materialize(spark.range(3)).inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert glob.glob(f"{path}/*.parquet")
    assert common.discard(spark) >= 1 and not glob.glob(f"{path}/*.parquet")
    assert common.discard(spark) == 0
