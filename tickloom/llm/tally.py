"""Corpus-wide counts of hashed keys, gathered and handed back by bucket of documents.

Documents are dealt into buckets once. Each bucket sums up its keys, so a key
that every document holds is one entry per bucket, and sends them as packed
arrays to ranges of the key space; each range adds up what it got and returns
the totals in the order of each bucket's keys. A bucket, with its documents and
its keys' totals, is what one task works on; sizes follow from the number of
shuffle partitions, not from the content.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize, parallelism, trimming

#: Buckets of documents, and ranges of keys, for each shuffle partition at most.
BUCKETS, RANGES = 4, 8
#: Packed arrays that a document brings along at most: buckets times ranges stay in proportion to the documents.
PACKED = 1

SENT = "r long, b long, n long, keys binary, more binary, counts binary"
TOTALS = "b long, r long, totals binary"


class Dealt(NamedTuple):
    """Documents by bucket: rows has b (bucket), text and row (a struct of the other columns).

    A plan that uses rows several times deals the texts out once: equal exchanges are shared.
    """

    rows: DataFrame
    ranges: int

    def gather(self, count: Callable[[pa.Table, int], pa.Table]) -> DataFrame:
        """SENT rows of every bucket; count(documents of a bucket, number of ranges) makes them with `sent`."""
        ranges = self.ranges
        return self.rows.groupBy("b").applyInArrow(trimming(lambda table: count(table, ranges)), SENT)

    def with_totals(self, totals: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        """use(documents of a bucket, its totals) for every bucket that has documents."""
        return self.rows.groupBy("b").cogroup(totals.groupBy("b")).applyInArrow(trimming(use), schema)


def settled(docs: DataFrame) -> DataFrame:
    """docs if its rows come from files in an order that holds when a task runs again; else a written table of them."""
    return materialize(docs) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def bucketed(docs: DataFrame, text: str = "text") -> Dealt:
    """Deals all rows of docs out; copies and equal ids are spread over the buckets. Counts docs, which for files reads no texts."""
    docs = settled(docs)
    n, partitions = docs.count(), parallelism(docs.sparkSession)
    buckets = max(1, min(BUCKETS * partitions, n // 16))
    ranges = 8 * max(1, min(RANGES * partitions, PACKED * n // buckets) // 8)
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets))
    rows = docs.select(spread.alias("b"), F.col(f"`{text}`").alias("text"), carried(docs, text).alias("row"))
    return Dealt(rows.repartition(partitions, "b"), ranges)


def distinct(keys: np.ndarray, more: np.ndarray | None = None, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(distinct keys in order, their second halves, sums of counts, for each given key its place)."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if more is not None:
        more = more[order]
        new[1:] |= more[1:] != more[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    sums = np.bincount(place, counts, int(new.sum())).astype(np.int64)
    return keys[new], None if more is None else more[new], sums, place


def sent(b: int, keys: np.ndarray, more: np.ndarray | None, counts: np.ndarray, ranges: int) -> pa.Table:
    """Rows (SENT) that carry a bucket's distinct, ordered keys to their ranges."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    rows = [(r, lo, hi) for r, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
    blob = lambda a, kind: pa.array([planes(a[lo:hi].astype(kind)) for _, lo, hi in rows] if a is not None else [None] * len(rows), pa.binary())
    gaps = [planes(np.diff(keys[lo:hi].astype("<u8"), prepend=np.uint64(0))) for _, lo, hi in rows]
    number = lambda v: pa.array(v, pa.int64())
    columns = [number([r for r, _, _ in rows]), number([b] * len(rows)), number([hi - lo for _, lo, hi in rows])]
    return pa.table([*columns, pa.array(gaps, pa.binary()), blob(more, "<u4"), blob(counts, "<u4")], ["r", "b", "n", "keys", "more", "counts"])


def planes(a: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes, then all second, ...; the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(raw: bytes | pa.Buffer, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _joined(column: pa.ChunkedArray, kind: str, gaps: bool = False) -> np.ndarray:
    parts = [unplanes(x, kind) for x in column.to_pylist() if x is not None]
    return np.concatenate([np.cumsum(p, dtype=p.dtype) for p in parts] if gaps else parts) if parts else np.zeros(0, kind)


def tallied(sent_rows: DataFrame, most: int | None = None, summary: bool = False) -> DataFrame:
    """(b, r, totals): totals of each bucket's keys over all buckets, capped at `most`, in the order they were sent.

    With `summary` each range adds a row of bucket -1: its number of keys counted at all, and the sum of their counts.
    """
    kind = "<i8" if most is None else "u1"

    @trimming
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _joined(table["keys"], "<u8", gaps=True), _joined(table["counts"], "<u4")
        more = _joined(table["more"], "<u4") if table["more"].null_count < len(table) else None
        _, _, sums, place = distinct(keys, more, counts)
        totals = (sums if most is None else np.minimum(sums, most))[place].astype(kind)
        edges = np.cumsum([0, *table["n"].to_pylist()]).tolist()
        blobs = [planes(totals[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]
        b, r = table["b"].to_pylist(), table["r"].to_pylist()
        if summary:
            b, r = [*b, -1], [*r, r[0]]
            blobs.append(planes(np.array([np.count_nonzero(sums), sums.sum()], "<i8")))
        return pa.table([pa.array(b, pa.int64()), pa.array(r, pa.int64()), pa.array(blobs, pa.binary())], ["b", "r", "totals"])

    return sent_rows.groupBy("r").applyInArrow(run, TOTALS)


def totals_of(table: pa.Table, kind: str) -> np.ndarray:
    """A bucket's totals in the order of its distinct keys."""
    return _joined(table.sort_by("r")["totals"], kind)
