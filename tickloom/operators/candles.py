"""Candles: ticks summed up by tumbling window, gaps filled, and each close carried on.

A window exists if any key has a tick in it. A configured key that is silent in an
existing window gets a candle that carries its last close on, at the window's last
millisecond; before its first tick that price is 0. Every candle opens at the close
before it, a key's first at its own close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CandleConfig
from ..functions import state, window_last, window_start
from ..tables import written

#: Candles from here on are flushes of an endless window (a far-future sentinel), not data.
END_OF_TIME = 32_530_703_764_000
#: Keys of a block that a window meets at once, and blocks that are broadcast, at most.
BLOCK, SENT = 4096, 16
EXTREMES = ("min_ask", "max_ask", "min_bid", "max_bid")


def windowed(ticks: DataFrame, cfg: CandleConfig) -> DataFrame:
    """ticks with `start`, their tumbling window."""
    return ticks.withColumn("start", window_start(F.col("time"), cfg.candle_ms))


def window_counts(ticks: DataFrame, cfg: CandleConfig) -> DataFrame:
    return windowed(ticks, cfg).groupBy("start").agg(F.count("*").alias("n_ticks"))


def seen_keys(ticks: DataFrame, cfg: CandleConfig) -> DataFrame:
    """(start, key): the keys that tick in each window."""
    return windowed(ticks, cfg).select("start", "key").distinct()


def key_blocks(spark: SparkSession, cfg: CandleConfig, keys: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((block, keys: array), number of blocks) of the keys to fill: those of the table `keys` (column key), or of cfg."""
    if keys is None:
        keys, known = spark.createDataFrame([(k,) for k in cfg.keys], "key string"), len(cfg.keys)
    else:
        keys = keys.select("key").filter("key IS NOT NULL").distinct()
        known = keys.count()
    n = max(1, -(-known // BLOCK))
    return keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list("key").alias("keys")), n


def silent_keys(seen: DataFrame, cfg: CandleConfig, keys: DataFrame | None = None) -> DataFrame:
    """(start, key): keys to fill that are silent in a window that some key ticks in.

    Windows grow with time, not with ticks; each meets the keys in blocks of BLOCK or so, by the block's number.
    """
    blocks, n = key_blocks(seen.sparkSession, cfg, keys)
    windows = seen.select("start").distinct().select("start", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    held = F.broadcast(blocks) if n <= SENT else blocks
    grid = windows.join(held, "block").select("start", F.explode("keys").alias("key"))
    return grid.join(seen, ["start", "key"], "left_anti")


def generated_ticks(silent: DataFrame, cfg: CandleConfig) -> DataFrame:
    """A tick of price 0 at the last millisecond of each window that a key is silent in."""
    return silent.select(
        "key", window_last(F.col("start"), cfg.candle_ms).alias("time"), F.lit(0.0).alias("ask"), F.lit(0.0).alias("bid"), F.lit(-1).cast("long").alias("id"), F.lit(False).alias("is_live")
    )


def complete_ticks(ticks: DataFrame, cfg: CandleConfig, keys: DataFrame | None = None) -> DataFrame:
    """Live and generated ticks together."""
    return ticks.unionByName(generated_ticks(silent_keys(seen_keys(ticks, cfg), cfg, keys), cfg))


def partial_candles(ticks: DataFrame, cfg: CandleConfig) -> DataFrame:
    """key, start, close_time, close and the four extremes, for each key and window that has ticks.

    Of equal times the tick with the smallest id is the close, of equal prices the earliest tick is the extreme.
    """
    tick = state(F.col("time"), F.col("ask"), F.col("bid"), F.col("is_live"))
    first = [F.col("time"), F.col("id")]
    ask, bid = F.col("ask"), F.col("ask" if cfg.bid_by_ask else "bid")
    low = lambda price: F.min_by(tick, F.struct(price, *first))
    high = lambda price: F.max_by(tick, F.struct(price, -F.col("time"), -F.col("id")))
    summed = windowed(ticks, cfg).groupBy("key", "start").agg(
        F.max_by(tick, F.struct(F.col("time"), -F.col("id"))).alias("close"),
        low(ask).alias("min_ask"),
        high(ask).alias("max_ask"),
        low(bid).alias("min_bid"),
        high(bid).alias("max_bid"),
    )
    return with_close_time(summed, cfg)


def with_close_time(candles: DataFrame, cfg: CandleConfig) -> DataFrame:
    return candles.withColumn("close_time", window_last(F.col("start"), cfg.candle_ms))


def with_gaps(partials: DataFrame, cfg: CandleConfig, keys: DataFrame | None = None) -> DataFrame:
    """partials and, for each key to fill that is silent in a window, a row without close and extremes."""
    gaps = with_close_time(silent_keys(partials.select("start", "key"), cfg, keys), cfg)
    return partials.unionByName(gaps, allowMissingColumns=True)


def complete_candles(partials: DataFrame, cfg: CandleConfig) -> DataFrame:
    """Candles of all rows of with_gaps: gaps carry the last close on, and each opens at the close before it."""
    order = Window.partitionBy("key").orderBy("start")
    last = F.last("close", ignorenulls=True).over(order)
    zero = F.lit(0.0)
    close = F.coalesce("close", state(F.col("close_time"), F.coalesce(F.col("last.ask"), zero), F.coalesce(F.col("last.bid"), zero), F.col("last").isNotNull()))
    filled = partials.withColumn("last", last).withColumn("is_live", F.col("close").isNotNull()).withColumn("close", close)
    if cfg.leading_gap == "skip":
        filled = filled.filter("last IS NOT NULL")
    opened = filled.withColumn("open", F.coalesce(F.lag("close").over(order), F.col("close")))
    return opened.select("key", "start", "close_time", "open", "close", *[F.coalesce(c, "close").alias(c) for c in EXTREMES], "is_live")


def checked(candles: DataFrame) -> DataFrame:
    """The candles; a candle stamped before its own close fails the query: gaps and ticks never make one."""
    wrong = F.raise_error(F.concat(F.lit("close_time before the close of "), F.col("key")))
    return candles.withColumn("close_time", F.when(F.col("close_time") >= F.col("close.time"), F.col("close_time")).otherwise(wrong))


def without_skewed(candles: DataFrame) -> DataFrame:
    """The candles but for those stamped before their own close, for inputs that are not trusted."""
    return candles.filter(F.col("close_time") >= F.col("close.time"))


def before_end_of_time(candles: DataFrame) -> DataFrame:
    return candles.filter(F.col("close_time") < END_OF_TIME)


def build_candles(ticks: DataFrame, cfg: CandleConfig, reuse: bool = True, keys: DataFrame | None = None) -> DataFrame:
    """All steps: ticks to complete candles, without flushes of an endless window. A table `keys` (column key) stands in for cfg.keys.

    With `reuse` the partial candles are written once, so that ticks are scanned once: gaps need the windows and keys
    of all candles, and later steps read candles several times. Without it all is one lazy plan.
    """
    partials = partial_candles(ticks, cfg)
    partials = written(partials) if reuse else partials
    return before_end_of_time(complete_candles(with_gaps(partials, cfg, keys), cfg))


def flat(candles: DataFrame) -> DataFrame:
    """Candles as plain columns of times and prices."""
    return candles.select(
        "key",
        "close_time",
        F.col("open.time").alias("open_state_time"),
        F.col("close.time").alias("close_state_time"),
        F.col("open.ask").alias("open_ask"),
        F.col("close.ask").alias("close_ask"),
        F.col("close.is_live").alias("close_is_live"),
        F.col("min_ask.ask").alias("min_ask_price"),
        F.col("max_ask.ask").alias("max_ask_price"),
        F.col("min_bid.bid").alias("min_bid_price"),
        F.col("max_bid.bid").alias("max_bid_price"),
    )
