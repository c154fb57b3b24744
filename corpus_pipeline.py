"""The corpus pipeline: stages over the table documents, each written as Parquet and read again by the next.

Quality selection, near-duplicates, repeated passages, source mixing, packing.
Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the
last one the packed pieces. A stage may start once the result of the one before is
written: it first deletes the tables that that one needed for its work.

Defined cases: a null, empty or blank text is neither good nor bad text and stays, as one
document (all such are equal), loses no words, adds none to the mixture, and is packed
as the end id alone; a very long text passes through whole; rows are judged one by one,
whatever doc_ids they share or lack; of equal rows, as of near-duplicates, one stays;
further columns pass through whatever their names; empty tables give empty results, and
without labels no document is rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import importance, mixing, packing, simhash, substrings
from tickloom.llm.common import forget, forget_paths, materialize, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_NEEDED: list[str] = []


def _stage(function: Stage) -> Stage:
    """The stage, which deletes what the stage before it needed and remembers what it needs itself."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget_paths(spark, _NEEDED)
        with recorded() as paths:
            out = function(spark, docs, sf_dir)
        _NEEDED[:] = paths
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return importance.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: near by SimHash, and 0.8 or more of their five-word shingles in common."""
    return simhash.representatives(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a text that loses none stays as it was."""
    out = substrings.without_repeats(docs, as_it_was=True)
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mix(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with the sequence and offset each lies at."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL expresses neither the hashed models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        forget(before)  # does nothing to the table documents itself
    return STAGES[-1][1](spark, docs, sf_dir)
