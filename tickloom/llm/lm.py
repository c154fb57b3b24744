"""Language-model scoring by deleted interpolation.

Tokens are words (ASCII lower case) and one end for each document; a document's
first word follows an end. A token's probability after its context mixes four
estimates: the pair's relative frequency, the token's relative frequency, the
uniform distribution over the known tokens and the unknown, and the unknown
alone (Jelinek and Mercer, 1980). The mixture weights depend on how often the
context was seen, in powers of two, and are learned by expectation-maximisation
on held-out counts: every training token is judged by the counts of all others,
so the single occurrences stand for the unknown.

Counts come from all training documents and are exact: pairs and words are tallied
over the cluster (see `tally`), and each bucket of documents gets the totals of
its own. EM works on a table of (context class, both estimates in quarters of a
power of two), whose size is bounded whatever the corpus.

Defined cases: null, empty and blank texts are one end; a null doc_id is not held
out; without training documents all tokens are unknown; a very long text is hashed
about a megabyte at a time and scored whole; equal rows, and rows that share an id, are
documents of their own; an empty table gives an empty one; further columns are carried,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropping_shuffles, hashed_words, materialize, mix64, text_buffer
from .tally import bucketed, distinct, sent, tallied, totals_of, unplanes

END = np.uint64(0x2545F4914F6CDD1D)
#: Added to each count of the smoothed unigram score.
BASE = 0.1
#: Steps of a power of two in which EM sees an estimate, and the most such steps.
STEPS, MOST_STEPS = 4, 200
ROUNDS = 200

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of a bucket's tokens in order, the text each belongs to)."""
    data, offsets = text_buffer(table["text"])
    words, firsts = hashed_words(_LOWER[data], offsets)
    return np.insert(words, firsts[1:], END), np.repeat(np.arange(len(table)), np.diff(firsts) + 1)


def _keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of all tokens, then of all pairs (context, token); tokens take the lowest eighth of the key space."""
    context = np.concatenate([[END], tokens[:-1]])
    pairs = mix64(context * np.uint64(0x9E3779B97F4A7C15) + tokens)
    return np.concatenate([tokens >> np.uint64(3), pairs - (pairs >> np.uint64(3)) + np.uint64((1 << 61) - 1)])


def _trains(table: pa.Table) -> np.ndarray:
    return ~pc.struct_field(table["row"], "held_out").to_numpy(zero_copy_only=False).astype(bool)


def _count(table: pa.Table, ranges: int) -> pa.Table:
    tokens, text = _tokens(table)
    keys, _, counts, _ = distinct(_keys(tokens), None, np.tile(_trains(table)[text], 2))
    return sent(table["b"][0].as_py(), keys, None, counts, ranges)


def _counted(table: pa.Table, totals: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: count of its pair, of its context, of itself; and its text."""
    tokens, text = _tokens(table)
    _, _, _, place = distinct(_keys(tokens))
    counts = totals_of(totals, "<i8")[place]
    own, pair = np.split(counts, 2)
    end = own[np.flatnonzero(tokens == END)[0]]  # every text has an end
    return pair, np.concatenate([[end], own[:-1]]), own, text


def _divide(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(np.asarray(b) > 0, len(a)))


def _classes(context: np.ndarray) -> np.ndarray:
    return np.frexp(context + 1)[1] - 1  # powers of two


def _steps(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else 1 + quarters of a power of two below 1."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = np.minimum(MOST_STEPS - 1, 1 + np.rint(-STEPS * np.log2(p[some])))
    return out


def _held_out_table(table: pa.Table, totals: pa.Table, n: int) -> pa.Table:
    """How many training tokens of a bucket have which class and estimates, each without itself."""
    pair, context, own, text = _counted(table, totals)
    train = _trains(table)[text]
    pair, context, own = pair[train] - 1, context[train] - 1, own[train] - 1
    code = (_classes(context) * MOST_STEPS + _steps(_divide(pair, context))) * MOST_STEPS + _steps(_divide(own, n - 1))
    codes, counts = np.unique(code, return_counts=True)
    return pa.table([pa.array(codes), pa.array(counts)], ["code", "n"])


def learn_weights(codes: np.ndarray, counts: np.ndarray, n_types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (pair, token, uniform, unknown) of each context class; the last row holds for unseen classes."""
    rest, token = np.divmod(codes, MOST_STEPS)
    cls, pair = np.divmod(rest, MOST_STEPS)
    estimate = lambda s: np.where(s > 0, 2.0 ** (-(s - 1) / STEPS), 0.0)
    p = np.column_stack([estimate(pair), estimate(token), np.full(len(codes), 1 / (n_types + 1)), token == 0])
    n_classes = 64
    weights = np.full((n_classes + 1, 4), 0.25)
    if not len(codes):
        return weights
    rows = np.concatenate([cls, np.full(len(cls), n_classes)])  # the last class sees all tokens
    p, counts = np.tile(p, (2, 1)), np.tile(counts.astype(float), 2)
    for _ in range(rounds):
        share = weights[rows] * p
        share *= (counts / share.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(rows, share[:, j], n_classes + 1) for j in range(4)]) + 0.5
        new = sums / sums.sum(axis=1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-7
        weights = new
        if done:
            break
    unseen = np.bincount(rows, minlength=n_classes + 1) == 0
    weights[unseen] = weights[n_classes]
    return weights


def _score(table: pa.Table, totals: pa.Table, n: int, n_types: int, weights: np.ndarray) -> pa.Table:
    pair, context, own, text = _counted(table, totals)
    w = weights[_classes(context)]
    known = own > 0
    p = w[:, 0] * _divide(pair, context) + w[:, 1] * _divide(own, n) + w[:, 2] / (n_types + 1) + w[:, 3] * ~known
    base = np.log10((own + BASE) / (n + BASE * (n_types + 1)))
    texts = len(table)
    columns = [
        pa.array(np.bincount(text, minlength=texts)),
        pa.array(np.bincount(text, known, texts).astype(np.int64)),
        pa.array(np.bincount(text, base, texts)),
        pa.array(np.bincount(text, np.log10(p), texts)),
    ]
    return pa.table([table["row"], *columns], ["row", "n_tokens", "n_known", "base_score", "score"])


def scored(docs: DataFrame, held_out: str = "held_out", text: str = "text") -> DataFrame:
    """row (a struct of the columns of docs but the text), n_tokens, n_known, train_tokens, base_score, score for every row.

    docs has a boolean column `held_out` without nulls; the other documents train the model.
    """
    spark = docs.sparkSession
    dealt = bucketed(docs.withColumnRenamed(held_out, "held_out"), text)
    totals = materialize(tallied(dealt.gather(_count), summary=True))
    tokens = totals.filter(f"b = -1 AND r < {dealt.ranges // 8}")  # those of single tokens
    sums = np.array([unplanes(r.totals, "<i8") for r in tokens.select("totals").collect()]).reshape(-1, 2).sum(axis=0)
    n_types, n = int(sums[0]), int(sums[1])
    totals = totals.filter("b >= 0")
    with dropping_shuffles(spark):
        seen = dealt.with_totals(totals, lambda table, t: _held_out_table(table, t, n), "code long, n long")
        seen = seen.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    weights = learn_weights(seen["code"].to_numpy(), seen["n"].to_numpy(), n_types)
    kinds = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([dealt.rows.schema["row"], *[T.StructField(*k) for k in kinds]])
    out = dealt.with_totals(totals, lambda table, t: _score(table, t, n, n_types, weights), schema)
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def score_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    out = scored(docs.select("doc_id", "text", held_out.alias("held_out")))
    return out.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
