"""Log returns of candles and the correlation of every pair of series over sliding windows.

Pairs are joined on the candle first and spread over sliding windows after, so the
join sees each point once. The join's condition keeps each pair once, without a
cross join of keys.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CorrelationConfig
from ..functions import NAN, log_ratio, pair_key, partition_of, pearson, sliding_starts, window_label, window_last
from ..tables import written
from . import kernel

#: Series of a block, values that a task holds, and keys of a block of pairs, at most.
SERIES, NUMBERS, BLOCK = 2048, 1 << 23, 2048


def log_returns(candles: DataFrame) -> DataFrame:
    """key, close_time (the candle), time (of the close), value = ln(close ask / open ask)."""
    return candles.select("key", "close_time", F.col("close.time").alias("time"), log_ratio(F.col("close.ask"), F.col("open.ask")).alias("value"))


def in_sliding_windows(points: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    """Each point once for each sliding window that holds its candle's close_time: w_start beside all columns."""
    return points.withColumn("w_start", F.explode(sliding_starts(F.col("close_time"), cfg.window_ms, cfg.slide_ms)))


def work_packets(points: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    """w_start, key and the series' points in that window, ordered by time."""
    return in_sliding_windows(points, cfg).groupBy("w_start", "key").agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("points"))


def configured_pairs(keys: DataFrame, n_partitions: int) -> DataFrame:
    """key1, key2, pair, part: every pair of keys (column key) once, and the partition it belongs to.

    Keys are dealt into blocks of BLOCK or so and pairs are joined by cells of two blocks: no task sees all keys.
    """
    keys = keys.select("key").filter("key IS NOT NULL").distinct()
    sent = in_cells(keys, max(1, -(-keys.count() // BLOCK)))
    side = lambda n: sent.select("low", "high", F.col("key").alias(f"key{n}"), F.col("block").alias(f"block{n}"))
    once = (F.col("block1") != F.col("block2")) | (F.col("low") == F.col("high"))  # both in one block meet in its own cell
    pairs = side(1).join(side(2), ["low", "high"]).filter((F.col("key1") < F.col("key2")) & once).select("key1", "key2")
    pair = pair_key(F.col("key1"), F.col("key2"))
    return pairs.withColumn("pair", pair).withColumn("part", partition_of(F.col("pair"), n_partitions))


def fan_out(table: DataFrame, n_partitions: int, pair: str = "pair") -> DataFrame:
    """The rows with `part`, each partition of pairs in a task of its own."""
    return table.withColumn("part", partition_of(F.col(pair), n_partitions)).repartition(n_partitions, "part")


def _only(points: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    if cfg.pairs == "observed":
        return points
    wanted = points.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(cfg.keys)], "key string")
    return points.join(F.broadcast(wanted), "key", "left_semi")  # as many rows as the configuration names


def paired_points(points: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    """key1 < key2, w_start and the two points that belong together: time1, value1, time2, value2."""
    points = _only(points, cfg)
    if cfg.align == "candle":
        on = ["close_time"]
    else:
        order = Window.partitionBy("w_start", "key").orderBy("time", "close_time")
        points = in_sliding_windows(points, cfg).withColumn("position", F.row_number().over(order))
        on = ["w_start", "position"]
    side = lambda n: points.select(*on, *[F.col(c).alias(f"{c}{n}") for c in ("key", "time", "value")])
    pairs = side(1).join(side(2), on).filter("key1 < key2")
    return in_sliding_windows(pairs, cfg) if cfg.align == "candle" else pairs


def _counts(points: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    return in_sliding_windows(_only(points, cfg), cfg).groupBy("w_start", "key").agg(F.count("*").alias("n"))


def pair_statistics(points: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    """w_start, key1, key2, r, x_count, y_count (and x_values, y_values): every pair with two points or more.

    A pair whose series have unequal numbers of points in a window is dropped, or fails the query, as cfg says.
    """
    pairs = paired_points(points, cfg)
    aggs = [pearson(F.col("value1"), F.col("value2")).alias("r"), F.count("*").alias("n")]
    if cfg.include_underlying:
        for n, name in ((1, "x_values"), (2, "y_values")):
            point = F.struct(F.col(f"time{n}").alias("time"), F.col(f"key{n}").alias("key"), F.col(f"value{n}").alias("value"))
            ordered = F.array_sort(F.collect_list(point))
            aggs.append(F.transform(ordered, lambda p: F.struct(p["key"].alias("key"), p["time"].alias("time"), p["value"].alias("value"))).alias(name))
    stats = pairs.groupBy("w_start", "key1", "key2").agg(*aggs)
    counts = _counts(points, cfg)
    for n, name in ((1, "x_count"), (2, "y_count")):
        stats = stats.join(counts.select("w_start", F.col("key").alias(f"key{n}"), F.col("n").alias(name)), ["w_start", f"key{n}"])
    even = (F.col("x_count") == F.col("y_count")) & (F.col("n") == F.col("x_count"))
    if cfg.on_mismatch == "error":
        stats = stats.withColumn("r", F.when(even, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("unequal numbers of points: "), pair_key(F.col("key1"), F.col("key2"))))))
    else:
        stats = stats.filter(even)
    return stats.filter("x_count >= 2").drop("n")


def kept(r: Column, cfg: CorrelationConfig) -> Column:
    """NaN stays if it is propagated; a value stays unless its magnitude is below the threshold."""
    return (F.lit(cfg.propagate_nan) | ~F.isnan(r)) & ~(~F.isnan(r) & (F.abs(r) < F.lit(cfg.min_corr)))


def correlations(points: DataFrame, cfg: CorrelationConfig) -> DataFrame:
    """time (last millisecond of the window), key, value, x_count, y_count, is_nan, window (and x_values, y_values).

    A NaN that is propagated has value 1 and is_nan true.
    """
    stats = pair_statistics(points, cfg).filter(kept(F.col("r"), cfg))
    return correlation_rows(stats, cfg, ("x_values", "y_values") if cfg.include_underlying else ())


def _mates(block: Column, blocks: int) -> Column:
    """The cells (low, high) that a block of series takes part in."""
    return F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(F.least(block, i).alias("low"), F.greatest(block, i).alias("high")))


def in_cells(points: DataFrame, blocks: int) -> DataFrame:
    """points with `block`, a number their key is dealt to, and once for each cell (low, high) of two blocks that need it."""
    dealt = points.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return dealt.withColumn("cell", F.explode(_mates(F.col("block"), blocks))).select("*", "cell.low", "cell.high").drop("cell")


def matrix_layout(points: DataFrame, cfg: CorrelationConfig) -> tuple[int, int]:
    """(blocks of series, milliseconds of window starts that a task has), from the numbers of series and candles.

    A cell holds SERIES series of a block and NUMBERS values at most; time is cut so that there are a few cells for
    each partition, but no finer than a window where that fits, since each cut sends a window's points twice.
    """
    n, candles, first, last = points.agg(F.count_distinct("key"), F.count_distinct("close_time"), F.min("close_time"), F.max("close_time")).first()
    if not n:
        return 1, cfg.slide_ms
    span = last - first + cfg.window_ms
    per_ms = candles / span
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(cfg.window_ms, span // (4 * partitions))
    series = max(1, min(SERIES, n, int(NUMBERS / max(1.0, per_ms * (wanted + cfg.window_ms)))))
    wanted = min(wanted, max(cfg.slide_ms, int(NUMBERS / (series * per_ms)) - cfg.window_ms))
    return -(-n // series), max(1, wanted // cfg.slide_ms) * cfg.slide_ms


def correlation_matrix(points: DataFrame, cfg: CorrelationConfig, blocks: int | None = None) -> DataFrame:
    """The same as `correlations` without underlying points, for many series: blocks of series by matrix products.

    Series are dealt into blocks, as many as their number asks for; a task gets two blocks over some windows, so each
    point is sent `blocks` times and about twice for windows, and pairs that are not kept never leave the task. Series
    pair up if they have the same candles in a window; others follow the mismatch rule.
    """
    points = written(_only(points, cfg).select("key", "close_time", "value"))
    own, span = matrix_layout(points, cfg)
    blocks = blocks or own
    time = F.col("close_time")
    groups = F.sequence(F.floor((time - (cfg.window_ms - 1)) / span), F.floor(time / span))
    sent = in_cells(points.withColumn("g", F.explode(groups)), blocks)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda c: table[c].chunk(0).to_numpy(zero_copy_only=False)
        low, high, start = (int(table[c][0].as_py()) for c in ("low", "high", "g"))
        cell = kernel.cell_of(table["key"].chunk(0), column("block"), column("close_time"), column("value"), low, high)
        first = -(-start * span // cfg.slide_ms) * cfg.slide_ms
        return kernel.cell_pairs(cell, range(first, (start + 1) * span, cfg.slide_ms), cfg)

    return correlation_rows(sent.groupBy("g", "low", "high").applyInArrow(run, kernel.KINDS), cfg)


def correlation_rows(stats: DataFrame, cfg: CorrelationConfig, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with r and counts as correlations (see `correlations`)."""
    r = F.coalesce("r", F.lit(NAN))
    return stats.select(
        window_last(F.col("w_start"), cfg.window_ms).alias("time"),
        pair_key(F.col("key1"), F.col("key2")).alias("key"),
        F.when(F.isnan(r), F.lit(1.0)).otherwise(r).alias("value"),
        F.col("x_count").cast("int").alias("x_count"),
        F.col("y_count").cast("int").alias("y_count"),
        F.isnan(r).alias("is_nan"),
        window_label(F.col("w_start"), cfg.window_ms).alias("window"),
        *more,
    )
