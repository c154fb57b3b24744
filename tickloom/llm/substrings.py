"""Removal of repeated passages by difference-cover anchors.

A run of WINDOW words is repeated if the same word sequence starts anywhere else
in the corpus. Anchors are the runs of ANCHOR words that start at positions in a
difference cover modulo PERIOD (Burkhardt and Kärkkäinen, 2003): for any two
positions some shift below PERIOD takes both into the cover, so two equal runs of
WINDOW = PERIOD + ANCHOR - 1 words share an anchor at the same shift. Only anchors
are counted over the whole corpus, about a quarter of all positions. Windows that
hold a repeated anchor are then extended to whole windows, whose 96-bit hashes
are counted in turn; a window counted twice or more is repeated, and every word
that a repeated window covers is removed. Windows are judged on the input.

Defined cases: null, empty and blank texts have no words; texts of fewer than
WINDOW words lose nothing; a very long text is hashed about a megabyte at a time and
kept whole; equal rows, and rows that share an id, are documents of their own and
repeats of each other where their words are; an empty table gives an empty one; further
columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_words, mix64, text_buffer, text_slices, window_hashes
from .tally import SENT, bucketed, distinct, sent, tallied, totals_of

WINDOW = 35
#: A perfect difference set: every residue but 0 is the difference of exactly one pair.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1

_SHIFTS = np.zeros(PERIOD, bool)
_SHIFTS[list(COVER)] = True


def _texts(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its word hashes), in order; about a megabyte of text is hashed at a time."""
    data, offsets = text_buffer(table["text"])
    for lo, hi in text_slices(offsets):
        words, firsts = hashed_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for i in range(hi - lo):
            yield lo + i, words[firsts[i] : firsts[i + 1]]


def _anchors(table: pa.Table) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(hashes of all anchors of a bucket in order, [(text, positions of its anchors)])."""
    hashes, places = [], []
    for i, words in _texts(table):
        if len(words) >= WINDOW:
            h = window_hashes(words, ANCHOR)
            at = np.flatnonzero(np.resize(_SHIFTS, len(h)))
            hashes.append(h[at])
            places.append((i, at))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), places


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions some span [start, end) covers."""
    delta = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(ends, n), minlength=n + 1)
    return np.cumsum(delta[:n]) > 0


def _send_anchors(table: pa.Table, ranges: int) -> pa.Table:
    keys, _, counts, _ = distinct(_anchors(table)[0])
    return sent(table["b"][0].as_py(), keys, None, np.minimum(counts, 2), ranges)


def _candidates(table: pa.Table, totals: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(hashes, second hashes, [(text, starts)]) of the windows that hold a repeated anchor."""
    anchors, places = _anchors(table)
    _, _, _, place = distinct(anchors)
    repeated = totals_of(totals, "u1")[place] > 1
    held, edge = {}, 0
    for i, at in places:
        marks = repeated[edge : edge + len(at)]
        edge += len(at)
        if marks.any():
            held[i] = at[marks]
    first, second, starts = [], [], []
    for i, words in _texts(table) if held else ():
        if i not in held:
            continue
        n = len(words) - WINDOW + 1
        # a window holds an anchor if it starts in the PERIOD positions up to it
        at = np.flatnonzero(_covered(np.maximum(0, held[i] - PERIOD + 1), held[i] + 1, n))
        if len(at):
            starts.append((i, at))
            first.append(window_hashes(words, WINDOW, 1)[at])
            second.append((window_hashes(mix64(words ^ np.uint64(0x5851F42D4C957F2D)), WINDOW, 2)[at] >> np.uint64(32)).astype(np.uint32))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    return np.concatenate(first) if first else none[0], np.concatenate(second) if second else none[1], starts


def _send_windows(table: pa.Table, totals: pa.Table, ranges: int) -> pa.Table:
    first, second, _ = _candidates(table, totals)
    keys, more, counts, _ = distinct(first, second)
    return sent(table["b"][0].as_py(), keys, more, np.minimum(counts, 2), ranges)


def _strip(table: pa.Table, totals: pa.Table, as_it_was: bool) -> pa.Table:
    """n_words, n_removed and the kept words of a bucket's texts; totals of anchors and windows come together."""
    part = lambda kind: totals.filter(pc.equal(totals["kind"], kind))
    first, second, starts = _candidates(table, part(0))
    _, _, _, place = distinct(first, second)
    repeated = totals_of(part(1), "u1")[place] > 1
    held, edge = {}, 0
    for i, at in starts:
        held[i] = at[repeated[edge : edge + len(at)]]
        edge += len(at)
    n_words, n_removed, kept = [], [], []
    for i, text in enumerate(table["text"]):
        words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        n_words.append(len(words))
        if len(at := held.get(i, ())):
            gone = _covered(at, at + WINDOW, len(words))
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        n_removed.append(n_words[-1] - len(words))
        whole = as_it_was and not n_removed[-1]
        kept.append(text.as_py() if whole else b" ".join(words).decode("utf-8", "surrogatepass"))
    return pa.table([table["row"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, text: str = "text", as_it_was: bool = False) -> DataFrame:
    """row (a struct of the columns of docs but the text), n_words, n_removed, kept (words joined by one space) for every row.

    With as_it_was, kept is the text itself, or null, where nothing is removed.
    """
    dealt = bucketed(docs, text)
    ranges = dealt.ranges
    anchors = tallied(dealt.gather(_send_anchors), most=2)
    windows = tallied(dealt.with_totals(anchors, lambda table, totals: _send_windows(table, totals, ranges), SENT), most=2)
    both = anchors.withColumn("kind", F.lit(0)).union(windows.withColumn("kind", F.lit(1)))
    kinds = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())]
    schema = T.StructType([dealt.rows.schema["row"], *[T.StructField(*k) for k in kinds]])
    return dealt.with_totals(both, lambda table, totals: _strip(table, totals, as_it_was), schema)


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    out = without_repeats(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), repeated AS (
  SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(35)) AS j FROM repeated)
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words a WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.p = a.p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
