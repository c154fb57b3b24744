"""Mixing sources to target weights, with built-in SQL functions only.

Tokens are summed by source (with map-side partial sums, so one source may hold
any share of the rows), targets and repetition rates are derived from the few
sums, and each document is emitted floor(rate) times plus one more time if its
hash-seeded draw lies below the fraction.

Defined cases: a null text has size 0, and documents of size 0 take rate 0 or
their source's rate alike (they add no words); a null source is a source, ranked
last; a null doc_id draws like any other value; rows with the same doc_id draw
alike; a very long text is counted whole; an empty table gives an empty result; a
source whose sizes are all 0 has rate 0. Columns of the input other than the named
ones pass through `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Weights by rank of the source, repeating; and the most repeats of a source.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Sources whose rates are broadcast, at most, and keys that a source's rows are spread over beyond that.
BROADCAST, SALTS = 100_000, 64


def n_words(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the document's id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, share: float = 1.0) -> DataFrame:
    """source, source_size, target for a table with source and size; windows run over the sources' sums.

    Targets share `share` of all sizes by weight; one above `most` times its
    source's size stops there and the excess is shared again by weight. That
    ends where every source takes min(most * size, level * weight) for one
    level; sources saturate in the order of most * size / weight, so the level
    follows from running sums over the sources (not over documents).
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sums.select("source", "source_size", weight.cast("long").alias("weight"))
    cap = F.col("source_size") * F.lit(most)
    order = Window.orderBy(cap / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = ranked.select("source", "source_size", "weight", cap.cast("double").alias("cap"), level.cast("double").alias("level"))
    # levels rise up to the first source that stays below its cap and fall after it: that source's level holds for all
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole)
    return levels.select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _matched(rows: DataFrame, source: Column, doc_id: Column, targets: DataFrame, seed: int) -> DataFrame:
    """rows with source_size, target and copies; targets is a written table of one row for each source.

    It is broadcast if it has BROADCAST rows at most. Beyond that rows of a source are spread over SALTS keys, so that a
    source may hold any share of them.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if targets.count() <= BROADCAST:
        joined = rows.join(F.broadcast(targets), source.eqNullSafe(targets["source"]))
    else:
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, source.eqNullSafe(salted["source"]) & (F.pmod(F.xxhash64(doc_id), F.lit(SALTS)) == salted["salt"]))
    return joined.withColumn("copies", F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long"))


def mix(docs: DataFrame, seed: int = 7, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """The mixture itself: rows of docs, each as often as its rate and draw say, with all their columns.

    Texts are counted in a first pass, of which only the sums by source are kept; the second passes them on where they lie.
    """
    sized = docs.select(F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"))
    targets = materialize(source_targets(sized, **how))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    matched = _matched(rows, F.col(f"row.`{source}`"), F.col(f"row.`{doc_id}`"), targets, seed)
    taken = matched.select("row", F.explode(F.expr("IF(copies > 0, sequence(1L, copies), array())")))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mixture_report(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs; texts are counted once."""
    sized = materialize(docs.select("doc_id", F.col("source").alias("own"), n_words(F.col("text")).alias("size")))
    targets = materialize(source_targets(sized.select(F.col("own").alias("source"), "size"), **how))
    out = _matched(sized, F.col("own"), F.col("doc_id"), targets, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


REPORT_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
    CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS weight
  FROM sums
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM ranked
), targets AS (
  SELECT source, source_size,
    least(CAST(cap AS DOUBLE), coalesce((max(CASE WHEN level * weight <= cap THEN level END) OVER ()) * weight, CAST(cap AS DOUBLE))) AS target
  FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('7:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
