"""Language identification with string kernels, Nyström landmarks and kernel ridge regression.

A text's spectrum is the set of its byte n-grams of orders 1 to 4 (lower case,
with a space at either end), hashed into SLOTS; the blended-spectrum presence
kernel of two texts is the size of the intersection of their sets over the
geometric mean of their sizes (Ionescu and Popescu, "Knowledge Transfer between
Computer Vision and Text Mining", 2016). Landmarks of each language give the
Nyström approximation, in which one-versus-rest ridge regressions are solved. A
batch of texts is scored by two matrix products: presence by landmarks, kernel
values by coefficients. The regressions are fitted on a bounded sample of labelled
rows: at most SAMPLE in all and PER_LANGUAGE of a language, taken by hash.

Defined cases: a text without any letter, empty or null, is `und` with score 0;
so is every text if no row can be learned from; labels of one language alone
make that the prediction; ties go to the first language by code point. Letters are
the characters of Unicode's category L: digits, fractions and circled or Roman numerals
are none. A null doc_id is not held out; rows with equal doc_id and language are one
row of the sample, and equal texts get equal predictions; a very long text is hashed
piece by piece; an empty table gives an empty one; further columns stay, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, carried, sized_batches, trimming

BITS, ORDERS = 15, (1, 2, 3, 4)
SLOTS = 1 << BITS
SAMPLE, PER_LANGUAGE, LANDMARKS = 4000, 400, 256
RIDGE, SHARPNESS, SEED = 1e-3, 6.0, 23
UNKNOWN = "und"
#: Texts of one matrix product, and parts of a language from which samples are taken first.
BATCH, SPREAD = 128, 16


def spectra(texts: list[str]) -> np.ndarray:
    """Presence (0 or 1, float32) of each slot in each text, one row for each."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    out = np.zeros(len(raw) * SLOTS, np.float32)
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    piece, reach = 1 << 18, max(ORDERS) - 1
    for lo in range(0, len(data), piece):  # long texts are hashed piece by piece
        part = data[lo : lo + piece + reach].astype(np.uint32)
        at = np.arange(lo, min(lo + piece, len(data)))
        text = np.searchsorted(offsets, at, "right") - 1
        room, row = offsets[text + 1] - at, text << BITS
        gram = np.zeros(len(at), np.uint32)
        for n in ORDERS:
            head = part[n - 1 : n - 1 + len(at)]
            gram[: len(head)] |= head << np.uint32(8 * (n - 1))
            slot = ((gram ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) ^ (gram >> np.uint32(15))
            slot = (slot * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
            fits = room >= n
            out[row[fits] + slot[fits]] = 1
    return out.reshape(len(raw), SLOTS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))


class Model:
    """Landmarks (packed presence bits) and, by language, the coefficients of the kernel values."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, coefficients: np.ndarray, bias: np.ndarray):
        self.languages, self.landmarks = languages, np.packbits(landmarks.astype(bool), axis=1)
        self.coefficients, self.bias = coefficients.astype(np.float32), bias.astype(np.float32)

    def scorer(self):
        """A function from texts to scores, one column for each language."""
        landmarks = unit(np.unpackbits(self.landmarks, axis=1).astype(np.float32)).T.copy()
        return lambda texts: unit(spectra(texts)) @ landmarks @ self.coefficients + self.bias


def fit(presence: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regressions over Nyström features; languages share the landmarks evenly."""
    languages = sorted(set(labels))
    rows = {c: [i for i, x in enumerate(labels) if x == c] for c in languages}
    marks = presence[[i for c in languages for i in rows[c][: max(1, landmarks // len(languages))]]]
    unit_marks = unit(marks)
    values, vectors = np.linalg.eigh((unit_marks @ unit_marks.T).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = (unit(presence) @ unit_marks.T).astype(np.float64) @ root
    target = np.array([[1.0 if x == c else -1.0 for c in languages] for x in labels])
    weight = np.array([len(labels) / (len(languages) * len(rows[x])) for x in labels])[:, None]  # languages count alike
    features = np.column_stack([features, np.ones(len(features))])
    gram = features.T @ (weight * features) + ridge * len(labels) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (weight * target))
    return Model(languages, marks, root @ solved[:-1], solved[-1])


def learn(docs: DataFrame, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model of labelled rows (text, lang) of docs; None if there are none with a letter."""
    usable = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    n = usable.select("lang").distinct().count()
    if not n:
        return None
    each = max(1, min(per_language, sample // n))
    lot = F.xxhash64(F.lit(SEED), "doc_id")
    ranked = usable.select("doc_id", "lang", lot.alias("lot"))
    for by in (["lang", F.pmod(F.xxhash64("lot"), F.lit(SPREAD))], ["lang"]):  # so that no task reads all rows of a language
        ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("lot", "doc_id"))).filter(F.col("k") <= each)
    chosen = ranked.groupBy("doc_id", "lang").agg(F.min("k").alias("k")).withColumnsRenamed({"doc_id": "chosen", "lang": "label"})
    found = usable.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("lang") == F.col("label")))

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                bits = np.packbits(spectra(part.column("text").to_pylist()).astype(bool), axis=1)
                yield pa.record_batch([part.column("label"), part.column("k"), pa.array([b.tobytes() for b in bits], pa.binary())], ["label", "k", "bits"])

    rows = found.select("text", "label", "k").mapInArrow(run, "label string, k int, bits binary")
    rows = rows.groupBy("label", "k").agg(F.min("bits").alias("bits")).toArrow().sort_by([("label", "ascending"), ("k", "ascending")])
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(len(rows), -1)
    return fit(np.unpackbits(bits, axis=1).astype(np.float32), rows["label"].to_pylist())


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (a softmax of the regressions' values) in place of the text."""
    rows = bound_batches(docs.select(F.col(f"`{text}`").alias("text"), carried(docs, text).alias("row")))

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = model.scorer() if model else None
        for batch in sized_batches(batches, "text"):
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                texts = [t or "" for t in part.column("text").to_pylist()]
                named = [i for i, t in enumerate(texts) if model and any(map(str.isalpha, t))]
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if named:
                    v = SHARPNESS * values([texts[i] for i in named])
                    p = np.exp(v - v.max(axis=1, keepdims=True))
                    scores[named] = p.max(axis=1) / p.sum(axis=1)
                    for i, best in zip(named, v.argmax(axis=1), strict=True):
                        names[i] = model.languages[best]
                yield pa.record_batch([part.column("row"), pa.array(names), pa.array(scores)], ["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; learned from the rows that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = learn(rows.filter("NOT held_out"))
    return predict(rows.drop("lang"), model).select("row.doc_id", "row.held_out", "lang_pred", "score")
