"""Importance resampling with hashed n-gram models, by Gumbel top-k.

Words (ASCII lower case) and word pairs are hashed into SLOTS counters. A model of the target text is counted on
labelled documents (a bounded sample, at most `sample` of them, taken by hash) and a model of the raw text on all
documents, every occurrence counted. A document's weight is the log ratio of its probability under the two (Xie et al.,
"Data Selection for Language Models via Importance Resampling", 2023); the target model's counts are smoothed by
PRIOR occurrences spread as the raw model has them, and it backs off to the raw model for n-grams that no labelled
document holds, target or other: of those the sample says nothing. Labels are taken to be a random sample of all
documents: a large group of copies of which it has far less than its share looks like text that the target lacks.

n-grams of one text depend on each other, and the sum over a long text would outweigh any noise: the ratio is tempered
to TEMPER n-grams, as if each document held that many independent ones. Gumbel noise of scale 1, seeded by the
document's id, is added, and the k largest sums are a sample without replacement in proportion to the tempered ratios.
k is given, or is the number of documents whose tempered weight is no less than what a share `keep` of the labelled
target documents reaches. A document's own n-grams are left out of both models when it is weighed, so that labelled
documents gain no advantage.

The k-th largest sum is found by narrowing a histogram, so nothing but counters reaches the driver and no sort of all
documents is needed. Each task counts into a dense array and sends it in ranges of slots, which are added up in two
steps.

Defined cases: null, empty and blank texts have no n-grams and weight 0; a very long text is a batch of its own; ties at
the k-th place are all selected; equal rows fare alike; rows with the same doc_id get the same noise, but each is
weighed and selected by itself; a row without doc_id draws by its text and is never labelled; without labels, or
without any that name the target, all weights are 0 and every document is selected (unless k is given); a document
labelled twice has its lowest quality; an empty table gives an empty one; `selected` keeps further columns, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, hash_spans, materialize, mix64, sized_batches, text_buffer, trimming, word_spans
from .tally import planes, unplanes

BITS = 20
SLOTS = 1 << BITS
#: Labelled documents that are counted, at most.
SAMPLE = 20_000
#: Occurrences of a slot in the raw model's proportions that the target model starts with, as many as that model would have of it.
PRIOR = 8.0
#: Share of the target documents that selection keeps, about.
KEEP = 0.995
#: n-grams that every document's ratio is tempered to, and neutral n-grams that each is given besides.
TEMPER, NEUTRAL = 32.0, 10
#: Ranges of slots, and groups of tasks that are added up first.
RANGES, GROUPS = 256, 32
SEED = 11

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, texts): one entry for each word and each pair of words of a text."""
    data, offsets = text_buffer(column)
    data = _LOWER[data]
    starts, ends = word_spans(data, offsets)
    words = hash_spans(data, starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    within = text[:-1] == text[1:]
    pairs = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[within]
    slots = (np.concatenate([words, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)
    return slots, np.concatenate([text, text[:-1][within]])


def _text(batch: pa.RecordBatch) -> pa.Array:
    return pc.struct_field(batch.column("row"), "text")


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    """1 for documents of the target model, 0 for other labelled ones, -1 for the rest."""
    return batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)


def _counts(flagged: DataFrame) -> np.ndarray:
    """Counters of the target documents, of all labelled ones and of all, summed over the cluster; 3 * SLOTS numbers reach the driver."""
    width = SLOTS // RANGES

    @trimming
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, SLOTS), np.int64)
        for batch in sized_batches(batches, _text):
            slots, text = features(_text(batch))
            label = _labels(batch)
            total[2] += np.bincount(slots, minlength=SLOTS)
            for row, some in zip(total, (label == 1, label >= 0), strict=False):
                if some.any():
                    row += np.bincount(slots[some[text]], minlength=SLOTS)
        parts = [planes(total[:, lo : lo + width].ravel()) for lo in range(0, SLOTS, width)]
        yield pa.record_batch([pa.array(range(RANGES)), pa.array([TaskContext.get().partitionId() % GROUPS] * RANGES), pa.array(parts, pa.binary())], ["r", "g", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(3 * width, np.int64)
        for part in table["sums"]:
            total += unplanes(part.as_py(), "<i8")
        return pa.table([table["r"].slice(0, 1), table["g"].slice(0, 1), pa.array([planes(total)], pa.binary())], ["r", "g", "sums"])

    kind = "r long, g long, sums binary"
    sums = flagged.mapInArrow(count, kind)
    for by in (["r", "g"], ["r"]):
        sums = sums.groupBy(*by).applyInArrow(add, kind)
    out = np.zeros((3, RANGES, width), np.int64)
    found = sums.select("r", "sums").toArrow()
    for r, part in zip(found["r"].to_pylist(), found["sums"], strict=True):
        out[:, r] = unplanes(part.as_buffer(), "<i8").reshape(3, width)
    return (out.astype(np.uint32) if out.max() < 1 << 32 else out).reshape(3, SLOTS)


def log_weights(slots: np.ndarray, text: np.ndarray, label: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of n-grams, log ratio under the two models without its own n-grams) of each text.

    A slot with target count t and raw count c has the ratio (t + PRIOR) / (f * c + PRIOR), where f is the target's
    share of all occurrences: what the target model saw against what it would have seen were it the raw model. It is 1
    where no other labelled document holds the slot.
    """
    n = len(label)
    target, _, raw = counts.sum(axis=1, dtype=np.int64).tolist()
    sizes = np.bincount(text, minlength=n)
    if not len(slots) or not target:
        return sizes, np.zeros(n)
    key, own = np.unique(text << BITS | slots, return_counts=True)
    text, slots = key >> BITS, key & SLOTS - 1
    t, seen, c = (counts[i, slots].astype(np.int64) - own * mine for i, mine in enumerate((label[text] == 1, label[text] >= 0, 1)))
    ratio = np.where(seen > 0, np.log((t + PRIOR) / (c * (target / raw) + PRIOR)), 0.0)
    return sizes, np.bincount(text, ratio * own, n)


def gumbel(doc_id: Column, seed: int, text: Column | None = None) -> Column:
    """Gumbel noise from the document's id, or from its text where the id is null."""
    lot = F.xxhash64(F.lit(seed), doc_id) if text is None else F.xxhash64(F.lit(seed), doc_id, F.when(doc_id.isNull(), text))
    bits = F.shiftrightunsigned(lot, 11)
    return -F.log(-F.log((bits + 0.5) / float(2**53)))


def weigh(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED, whole: bool = False) -> DataFrame:
    """row, label (1: counted on for the target model, 0: labelled otherwise, null), noise, n_features, weight for every row of docs.

    row is a struct of doc_id, or of all columns of docs if `whole`.
    """
    judged = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).cast("int").alias("label"))
    chosen = judged.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if whole else ("doc_id", "text"))]).alias("row"))
    flagged = rows.join(F.broadcast(chosen), F.col("row.doc_id") == chosen["doc_id"], "left")  # `sample` rows at most
    flagged = bound_batches(flagged).select("row", "label", gumbel(F.col("row.doc_id"), seed, F.col("row.text")).alias("noise"))
    counts = _counts(flagged.select("row", "label"))
    kept = rows.schema["row"].dataType if whole else T.StructType([docs.schema["doc_id"]])

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, _text):
            slots, text = features(_text(batch))
            sizes, weight = log_weights(slots, text, _labels(batch), counts)
            row = batch.column("row")
            if not whole:
                row = pa.StructArray.from_arrays([pc.struct_field(row, "doc_id")], ["doc_id"])
            yield pa.record_batch([row, batch.column("label"), batch.column("noise"), pa.array(sizes, pa.int64()), pa.array(weight)], ["row", "label", "noise", "n_features", "weight"])

    kinds = [("label", T.IntegerType()), ("noise", T.DoubleType()), ("n_features", T.LongType()), ("weight", T.DoubleType())]
    return flagged.mapInArrow(run, T.StructType([T.StructField("row", kept), *[T.StructField(*k) for k in kinds]]))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of column `key` (doubles without nulls), exactly; None if k is not positive.

    Each round counts the values in 4,096 bins of the range that holds it, until
    that range holds one value or few enough to fetch.
    """
    if k <= 0:
        return None
    n, lo, hi = keys.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if k >= n:
        return lo
    while lo < hi:
        held = keys.filter((F.col("key") >= lo) & (F.col("key") <= hi))
        if n <= 10_000:
            return sorted((r.key for r in held.select("key").collect()), reverse=True)[k - 1]
        width = (hi - lo) / 4096
        slot = F.least(F.floor((F.col("key") - lo) / width), F.lit(4095))
        bins = held.groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r.s):
            if k <= r.n:
                n, lo, hi = r.n, r.lo, r.hi
                break
            k -= r.n
    return lo


def _drawn(docs: DataFrame, labels: DataFrame, whole: bool, sample: int, keep: float, k: int | None, seed: int) -> DataFrame:
    """row, n_features, weight, tempered, key, selected for every row of docs, by one pass over the texts after the models'."""
    weighed = weigh(docs, labels, sample, seed, whole)
    tempered = weighed.withColumn("tempered", F.lit(TEMPER) * F.col("weight") / (F.col("n_features") + NEUTRAL))
    rows = materialize(tempered.withColumn("key", F.col("tempered") + F.col("noise")))
    if k is None:
        least = rows.filter("label = 1").agg(F.percentile("tempered", F.lit(1 - keep))).first()[0]  # of `sample` rows at most
        k = rows.filter(F.col("tempered") >= F.lit(least)).count() if least is not None else rows.count()
    bound = kth_largest(rows, k)
    return rows.withColumn("selected", F.col("key") >= F.lit(bound) if bound is not None else F.lit(False))


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, tempered, key, selected for every row of docs."""
    return _drawn(docs, labels, False, sample, keep, k, seed).select("row.doc_id", "n_features", "weight", "tempered", "key", "selected")


def selected(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that are selected, with all their columns; each row stands or falls by itself, without a join."""
    return _drawn(docs, labels, True, sample, keep, k, seed).filter("selected").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
