"""Quartile bucket digests of documents, and how alike two digests are.

A window of five bytes slides over the UTF-8 text; six byte triplets of each
window that hold its first byte are hashed into 256 counters. The digest keeps,
for each counter, which quarter of the text's own counters it lies in (two
bits), the two quartile ratios and a logarithmic length (after Oliver, Cheng and
Chen, "TLSH - A Locality Sensitive Hash", 2013). Two digests are compared by a
score that cannot exceed MOST: the likeness is 1 - score / MOST.

Defined cases: a null text is empty; texts under five bytes are padded with zero
bytes; a very long text is hashed piece by piece; equal texts have equal digests. In
`edit_report` documents follow each other by descending doc_id, null ids last and equal
ids by ascending text (null first), so equal rows follow each other; a single document
follows itself; an empty table gives an empty one; further columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, parallelism, text_slices, trimming

BUCKETS, WINDOW = 256, 5
_PAIRS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_SALTS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
#: Penalty for two bits that differ by 0 to 3 quarters; steps of length or ratio, each weighed and bounded.
_APART = np.array([0, 1, 2, 6])
_LENGTH_STEP, _LENGTH_MOST, _RATIO_STEP, _RATIO_MOST = 4, 64, 2, 30
MOST = int(_APART[-1]) * BUCKETS + _LENGTH_MOST + 2 * _RATIO_MOST
#: Text hashed at a time.
PIECE = 1 << 19


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counters of each text, one row of BUCKETS for each."""
    n = len(offsets) - 1
    total = np.zeros(n * BUCKETS, np.int64)
    for lo in range(0, max(0, len(data) - WINDOW + 1), PIECE):  # a long text is hashed piece by piece
        part = data[lo : lo + PIECE + WINDOW - 1].astype(np.uint32)
        m = len(part) - WINDOW + 1
        at = np.arange(lo, lo + m)
        text = np.searchsorted(offsets, at, "right") - 1
        whole = at + WINDOW <= offsets[text + 1]  # windows that lie within one text
        base = (text * BUCKETS)[whole]
        for (i, j), salt in zip(_PAIRS, _SALTS, strict=True):
            h = part[:m] | part[i : m + i] << np.uint32(8) | part[j : m + j] << np.uint32(16)
            h = (h ^ (h >> np.uint32(11)) ^ salt) * np.uint32(0x9E3779B1)
            h = ((h ^ (h >> np.uint32(15))) * salt) >> np.uint32(24)
            total += np.bincount(base + h[whole], minlength=len(total))
    return total.reshape(n, BUCKETS)


def digest_rows(texts: list[str | None]) -> np.ndarray:
    """Digests as rows of bytes: length, ratios, then four counters a byte."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    raw = [r.ljust(WINDOW, b"\0") for r in raw]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    counts = np.empty((len(raw), BUCKETS), np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    for lo, hi in text_slices(offsets, PIECE):
        base = offsets[lo]
        counts[lo:hi] = _counts(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
    counts[sizes == 0] = 0
    order = np.sort(counts, axis=1)
    q1, q2, q3 = (order[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    code = sum((counts > q[:, None]).astype(np.uint8) for q in (q1, q2, q3))
    body = code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6
    length = np.minimum(255, np.round(np.log1p(sizes) / np.log(1.1))).astype(np.uint8)
    top = np.maximum(q3, 1)
    ratios = (15 * q1 // top << 4 | 15 * q2 // top).astype(np.uint8)
    return np.column_stack([length, ratios, body])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference scores, 0 to MOST, of digests row by row."""
    total = np.minimum(_LENGTH_MOST, _LENGTH_STEP * np.abs(a[:, 0].astype(int) - b[:, 0]))
    for shift in (0, 4):
        total += np.minimum(_RATIO_MOST, _RATIO_STEP * np.abs((a[:, 1] >> shift & 15).astype(int) - (b[:, 1] >> shift & 15)))
    for shift in (0, 2, 4, 6):
        apart = np.abs((a[:, 2:] >> shift & 3).astype(np.int8) - (b[:, 2:] >> shift & 3).astype(np.int8))
        total += _APART[apart].sum(axis=1)
    return total


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - scores(a, b) / MOST


def hexes(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def unhex(digests: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), -1)


@F.pandas_udf(T.StringType())
def digest(text: pd.Series) -> pd.Series:
    """Column function: the hex digest of each text."""
    return pd.Series(hexes(digest_rows(text.tolist())), dtype="object")


@F.pandas_udf(T.DoubleType())
def digest_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column function: likeness of two hex digests; null if one is null."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        out[known] = likeness(unhex(a[known].tolist()), unhex(b[known].tolist()))
    return pd.Series(out).where(known, None)


def _prefix(text: Column) -> Column:
    """The first six bytes of a text as a number, in the order of texts; 0 for null."""
    first = F.hex(F.encode(F.substring(text, 1, 6), "UTF-8"))
    return F.coalesce(F.conv(F.rpad(F.substring(first, 1, 12), 12, "0"), 16, 10).cast("long"), F.lit(0).cast("long"))


def _cuts(keyed: DataFrame, n: int) -> tuple[np.ndarray, dict[int | None, np.ndarray]]:
    """(doc_ids that cut the rows into 4 * n parts or so; for each id that fills a part by itself, and null, prefixes that cut its rows)."""
    shares = [(i + 1) / (4 * n) for i in range(4 * n - 1)] or [0.5]
    found, rows, nulls = keyed.select(F.percentile_approx(F.when(F.col("known"), F.col("id")), shares, 40 * n), F.count("*"), F.count_if(~F.col("known"))).first()
    cuts, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    hot: list[int | None] = cuts[times > 1].tolist()
    some = F.col("known") & F.col("id").isin(hot) if hot else F.lit(False)
    if 4 * n * nulls > rows:
        hot.append(None)
        some = some | ~F.col("known")
    edges = {}
    if hot:
        for r in keyed.filter(some).groupBy("known", "id").agg(F.percentile_approx("prefix", shares, 40 * n).alias("edges")).collect():
            edges[r.id if r.known else None] = np.unique(np.array(r.edges, np.int64))
    return cuts, edges


def _followed(docs: DataFrame) -> DataFrame:
    """Rows by bucket, in order, each bucket closed by a copy of the row that follows its last (`halo`).

    Buckets are cut at quantiles of doc_id, and within an id, or null, that holds many rows at quantiles of the texts'
    first bytes. Only those cut points and the first key of each bucket, a few numbers per partition, reach the driver.
    """
    n = parallelism(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNotNull().alias("known"), _prefix(F.col("text")).alias("prefix"))
    cuts, edges = _cuts(keyed, n)
    width = 4 * n + 1

    def bucket(ids: np.ndarray, known: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Ascending in the order of rows: largest ids first, null last; of a frequent id, rows by prefix, and then all smaller ids up to the next cut."""
        part, within = np.where(known, len(cuts) - np.searchsorted(cuts, ids, "left"), len(cuts) + 1), np.full(len(ids), width - 1)
        for key, steps in edges.items():
            mine = ~known if key is None else known & (ids == key)
            within[mine] = np.searchsorted(steps, prefix[mine], "left")
        return part * width + within

    def columns(*given: pd.Series) -> tuple[np.ndarray, ...]:
        return tuple(c.to_numpy(k) for c, k in zip(given, (np.int64, bool, np.int64), strict=True))

    @F.pandas_udf("long")
    def bucket_of(ids: pd.Series, known: pd.Series, prefix: pd.Series) -> pd.Series:
        return pd.Series(bucket(*columns(ids, known, prefix)))

    key = ["id", "known", "prefix"]
    first = F.min(F.struct(F.bitwise_not("id").alias("down"), "prefix")).alias("first")
    found = sorted((r.b, ~r.first.down, r.first.prefix) for r in keyed.select(*key, bucket_of(*key).alias("b")).groupBy("b").agg(first).collect())
    buckets, first_id, first_prefix = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))

    @F.pandas_udf("array<long>")
    def places_of(ids: pd.Series, known: pd.Series, prefix: pd.Series) -> pd.Series:
        """The row's bucket, and the one before it if the row can be the first of its own (the last's is followed by the first's)."""
        ids, known, prefix = columns(ids, known, prefix)
        own = bucket(ids, known, prefix)
        at = np.searchsorted(buckets, own)
        leads = (first_id[at] == ids) & (first_prefix[at] == prefix)
        return pd.Series([[o, b] if lead else [o] for o, b, lead in zip(own.tolist(), buckets[at - 1].tolist(), leads.tolist(), strict=True)])

    placed = keyed.select("doc_id", "text", F.posexplode(places_of(*key)).alias("halo", "b"))
    rows = placed.select("b", "halo", "doc_id", "text")
    return rows.repartition(n, "b").sortWithinPartitions("b", "halo", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


REPORT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _reported(held: list[tuple]) -> pa.RecordBatch:
    """Rows for all but the last held document, each followed by the one after it; halos give no row."""
    texts = [t for _, _, _, t in held]
    digests = digest_rows(texts)
    keep = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
    edited = []
    for i in keep:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    own, changed = digests[keep], digest_rows(edited)
    after = digests[[i + 1 for i in keep]]
    columns = [
        [held[i][2] for i in keep],
        [len(texts[i]) for i in keep],
        [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        hexes(own),
        hexes(changed),
        likeness(own, changed),
        likeness(own, after),
    ]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], REPORT.names)


@trimming
def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for b, halo, doc_id, text in zip(*[batch.column(c) for c in ("b", "halo", "doc_id", "text")], strict=True):
            held.append((b.as_py(), halo.as_py(), doc_id.as_py(), text.as_py() or ""))
            size += len(held[-1][3])
            if len(held) > 1 and (size > 1 << 21 or len(held) > 2000):
                yield _reported(held)
                held = held[-1:]
                size = len(held[0][3])
    if len(held) > 1:
        yield _reported(held)


def edit_report(docs: DataFrame) -> DataFrame:
    """For every document its digest, its half-edited text's digest, and how alike they and the next document are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _followed(bound_batches(rows)).mapInArrow(_report, REPORT)


#: What SQL can say of the report: doc_id, n_chars, edited_sha256.
EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), e AS (
  SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC NULLS LAST, t), first_value(t) OVER (ORDER BY doc_id DESC NULLS LAST, t)) AS following FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, n - n // 2) || left(following, n // 2)) AS edited_sha256 FROM e
"""
