"""What several corpus operators share: sessions, words, and vectorised hashing.

A *word* everywhere in this subpackage is a maximal run of bytes other than
0x20 and 0x09-0x0D in the UTF-8 text; no multi-byte character contains such a
byte, so words of bytes are words of characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at a time; a single longer word is hashed in one go.
SLICE = 1 << 18

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset (single machine, tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Lets Spark drop an execution's shuffle files at its end; what it wrote stays.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions in this block leave no shuffle files behind, so that the steps of one operator don't add up on disk."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut, files outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.parquet(path)
    _WRITTEN.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


_WRITTEN: list[str] = []


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` gave, once nothing that is yet to run reads them."""
    for table in tables:
        forget_paths(table.sparkSession, [getattr(table, "_written_to", "")])


def forget_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(spark, path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """A list that has, at the end of the block, the paths of the tables written in it that are still there."""
    before, out = set(_WRITTEN), []
    yield out
    out += [path for path in _WRITTEN if path not in before]


def discard(spark: SparkSession) -> int:
    """Deletes the tables that `materialize` has written so far; call it when results that read them are written."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return n


#: Bytes of an Arrow batch that Python workers are sent, at most (a longer row is a batch of its own).
BATCH = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """df; from now on the session's Arrow batches are bounded by BATCH, or less if it is set so, however long texts are."""
    spark = df.sparkSession
    number, unit = re.fullmatch(r"(\d+)\s*([kmg]?)b?", spark.conf.get(_BATCH).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH:
        spark.conf.set(_BATCH, str(BATCH))
    return df


def carried(df: DataFrame, but: str) -> Column:
    """One struct of all columns of df but one, whatever their names; an operator's own columns then clash with none."""
    others = [F.col(f"`{c}`") for c in df.columns if c != but]
    return F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the number that is set to fit the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    up = _powers(_MULT, SLICE + 1)
    down = _powers(np.uint64(pow(int(_MULT), -1, 1 << 64)), SLICE + 1)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= SLICE + 1:
            return cls.up, cls.down
        return _powers(_MULT, n), _powers(np.uint64(pow(int(_MULT), -1, 1 << 64)), n)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of n + 1 entries); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words; a word ends at a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)  # edge[i]: a space lies before byte i, or a text starts there
    edge[1:-1] = space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[:-1] |= space
    edge[offsets] = True
    # byte i ends a word if it is no space and the next byte is one or starts a text
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]] for ascending, disjoint spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SLICE, "right")))
        hi = int(ends[j - 1])
        up, down = _Tables.get(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix64(out)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, for each text the index of its first word; n + 1 entries)."""
    hashes, firsts, done = [], [np.zeros(1, np.int64)], 0
    for lo, hi in text_slices(offsets):
        base = int(offsets[lo])
        part = data[base : int(offsets[hi])]
        starts, ends = word_spans(part, offsets[lo : hi + 1] - base)
        hashes.append(hash_spans(part, starts, ends))
        firsts.append(done + np.searchsorted(starts, offsets[lo + 1 : hi + 1] - base))
        done += len(starts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(firsts)


def text_slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` bytes together; a longer text is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def window_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `length` word hashes; n - length + 1 entries, none if fewer words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = _STEP + np.uint64(2 * seed)
    acc = np.full(n, np.uint64(seed), np.uint64)
    for j in range(length):
        acc *= step
        acc += words[j : j + n]
    return mix64(acc)


def trim() -> None:
    """Gives memory that is free back to the system, where the C library can: workers stay alive and idle after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimming(run: Callable) -> Callable:
    """The function of batches, of a table or of two tables, which trims when it has ended."""

    def batches(given):
        try:
            yield from run(given)
        finally:
            trim()

    def table(given):
        try:
            return run(given)
        finally:
            trim()

    def tables(one, two):
        try:
            return run(one, two)
        finally:
            trim()

    # Spark counts the arguments
    return batches if inspect.isgeneratorfunction(run) else table if len(inspect.signature(run).parameters) == 1 else tables


#: Rows of a batch at most.
ROWS = 1 << 16


def sized_batches(batches: Iterator[pa.RecordBatch], column: str | Callable[[pa.RecordBatch], pa.Array], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text at most (one longer text is a batch of its own)."""
    for batch in batches:
        _, offsets = text_buffer(column(batch) if callable(column) else batch.column(column))
        for lo, hi in text_slices(offsets, limit):
            for at in range(lo, hi, ROWS):
                yield batch.slice(at, min(ROWS, hi - at))
