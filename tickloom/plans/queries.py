"""Named queries over the star-schema tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources, streaming
from ..config import CandleConfig, CorrelationConfig
from ..functions import first_part, parsed_ms, window_last
from ..operators import candles as C
from ..operators import correlate as R

HOUR, DAY = 3_600_000, 86_400_000
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
HOURLY = CandleConfig(candle_ms=HOUR, keys=EVENT_TYPES)
QUARTERLY = CandleConfig(candle_ms=HOUR // 4, keys=(*EVENT_TYPES, "absent"))
DAILY = CorrelationConfig(window_ms=DAY, slide_ms=DAY // 4, min_corr=0.0, propagate_nan=True)
WEEKLY_LINES = CandleConfig(candle_ms=7 * DAY, keys=("A", "N", "R"))
WEEKLY_ORDERS = CandleConfig(candle_ms=7 * DAY, keys=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))

Query = Callable[[SparkSession, str], DataFrame]


def ticks_assign_time(spark, sf):
    return sources.with_event_time(sources.event_ticks(spark, sf)).select("key", "time", F.unix_millis("ts").alias("ts_ms"), "ask", "bid", "id", "is_live")


def ticks_printed(spark, sf):
    """Lines key:ask:bid:time, and the key that each begins with."""
    ticks = sources.event_ticks(spark, sf)
    return sources.printed(ticks).select("line", first_part(F.col("line")).alias("key"))


def candles_json(spark, sf):
    """Candles as lines of JSON, read back by their fields."""
    lines = sources.json_lines(C.build_candles(sources.event_ticks(spark, sf), HOURLY))
    number = lambda path: F.get_json_object("line", path).cast("double").alias(path.strip("$.").replace(".", "_"))
    return lines.select(F.get_json_object("line", "$.key").alias("key"), F.get_json_object("line", "$.close_time").cast("long").alias("close_time"), number("$.open.ask"), number("$.close.ask"), number("$.max_bid.bid"))


def ticks_in_time(spark, sf):
    """Candles after the skew guard: none is stamped before its own close."""
    return C.flat(C.without_skewed(C.checked(C.build_candles(sources.event_ticks(spark, sf), HOURLY))))


def dates_parsed(spark, sf):
    """Order dates written as local text and read again as epoch milliseconds, eight hours ahead of UTC."""
    orders = sources.parquet(spark, sf, "orders")
    text = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")
    return orders.select("o_orderkey", parsed_ms(text, offset_ms=8 * HOUR).alias("ms"))


def random_series(spark, sf):
    """Random control series: their ticks' times, and that prices are in [0, 1) and the same for the same seed."""
    one, two = (sources.random_ticks(spark, tuple(f"R-{i}" for i in range(5)), 200, seed=7).withColumnsRenamed({"ask": f"ask{x}", "bid": f"bid{x}"}) for x in (1, 2))
    both = one.join(two.select("key", "time", "ask2", "bid2"), ["key", "time"])
    sound = (F.col("ask1") == F.col("ask2")) & (F.col("bid1") == F.col("bid2")) & F.col("ask1").between(0, 1) & F.col("bid1").between(0, 1) & (F.col("ask1") != F.col("bid1"))
    return both.select("key", "time", sound.alias("sound"))


def tumbling_count(spark, sf):
    return C.window_counts(sources.event_ticks(spark, sf), HOURLY)


def ticks_total(spark, sf):
    return sources.event_ticks(spark, sf).agg(F.count("*").alias("n"))


def distinct_keys_per_window(spark, sf):
    return C.seen_keys(sources.event_ticks(spark, sf), HOURLY).groupBy("start").agg(F.count("*").alias("n_keys"))


def missing_keys_per_window(spark, sf):
    return C.silent_keys(C.seen_keys(sources.event_ticks(spark, sf), QUARTERLY), QUARTERLY)


def generated_ticks(spark, sf):
    ticks = sources.event_ticks(spark, sf)
    return C.generated_ticks(C.silent_keys(C.seen_keys(ticks, QUARTERLY), QUARTERLY), QUARTERLY).select("key", "time", "ask", "bid", "is_live")


def complete_ticks_union(spark, sf):
    return C.complete_ticks(sources.event_ticks(spark, sf), QUARTERLY).select("key", "time", "ask", "bid", "is_live")


def _partial(ticks: DataFrame, cfg: CandleConfig) -> DataFrame:
    return C.partial_candles(ticks, cfg).select(
        "key",
        "start",
        F.col("close.time").alias("close_state_time"),
        F.col("close.ask").alias("close_ask"),
        F.col("close.bid").alias("close_bid"),
        F.col("min_ask.ask").alias("min_ask_price"),
        F.col("max_ask.ask").alias("max_ask_price"),
        F.col("min_bid.bid").alias("min_bid_price"),
        F.col("max_bid.bid").alias("max_bid_price"),
    )


def partial_candles(spark, sf):
    return _partial(sources.event_ticks(spark, sf), HOURLY)


def partial_candles_bid_ask(spark, sf):
    return _partial(sources.lineitem_ticks(spark, sf), WEEKLY_LINES)


def partial_candles_bid_by_ask(spark, sf):
    return _partial(sources.lineitem_ticks(spark, sf), replace(WEEKLY_LINES, bid_by_ask=True))


def window_end_stamp(spark, sf):
    seen = C.seen_keys(sources.event_ticks(spark, sf), HOURLY)
    return seen.select("key", window_last(F.col("start"), HOUR).alias("close_time"))


def complete_candles(spark, sf):
    return C.flat(C.build_candles(sources.event_ticks(spark, sf), QUARTERLY))


def sparse_candles(spark, sf):
    """Candles by user: many silent windows, with leading gaps."""
    users = tuple(str(i) for i in range(1, 21))
    return C.flat(C.build_candles(sources.event_ticks(spark, sf, "user_id"), CandleConfig(candle_ms=6 * HOUR, keys=users)))


def candles_without_leading_gaps(spark, sf):
    return C.flat(C.build_candles(sources.event_ticks(spark, sf), replace(QUARTERLY, leading_gap="skip")))


def lineitem_candles(spark, sf):
    return C.flat(C.build_candles(sources.lineitem_ticks(spark, sf), WEEKLY_LINES))


def orders_priority_candles(spark, sf):
    return C.flat(C.build_candles(sources.order_ticks(spark, sf), WEEKLY_ORDERS))


def end_of_time_filter(spark, sf):
    """A far-future sentinel closes the last windows and is filtered out again."""
    ticks = sources.event_ticks(spark, sf)
    sentinel = ticks.limit(1).select("key", F.lit(C.END_OF_TIME + DAY).cast("long").alias("time"), F.lit(1.0).alias("ask"), F.lit(1.0).alias("bid"), "id", "is_live")
    return C.flat(C.build_candles(ticks.unionByName(sentinel), HOURLY))


def event_returns(spark, sf):
    return R.log_returns(C.build_candles(sources.event_ticks(spark, sf), HOURLY))


def _rounded(df: DataFrame, name: str = "value") -> DataFrame:
    return df.withColumn(name, F.when(F.isnan(name) | (F.abs(name) == float("inf")), F.col(name)).otherwise(F.round(name, 9) + 0.0))


def log_returns(spark, sf):
    return _rounded(event_returns(spark, sf))


def sliding_points(spark, sf):
    windows = R.in_sliding_windows(event_returns(spark, sf), DAILY)
    return windows.groupBy("w_start", "key").agg(F.count("*").alias("n_points"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def work_packets(spark, sf):
    packets = R.work_packets(event_returns(spark, sf), DAILY)
    return packets.select("w_start", "key", F.posexplode("points").alias("position", "point")).select("w_start", "key", F.col("position").cast("long").alias("position"), F.col("point.time").alias("time"))


def pair_keys_configured(spark, sf):
    nations = sources.parquet(spark, sf, "nation").select(F.col("n_name").alias("key"))
    return R.configured_pairs(nations, 20)


def pairs_by_partition(spark, sf):
    """Correlations dealt out by the partition of their pair: how many pairs each partition has, and in how many tasks."""
    dealt = R.fan_out(R.correlations(event_returns(spark, sf), DAILY), 20, "key")
    dealt = dealt.withColumn("task", F.spark_partition_id())
    return dealt.groupBy("part").agg(F.count_distinct("key").alias("n_pairs"), F.count("*").alias("n_rows"), F.count_distinct("task").alias("n_tasks"))


def pair_points_observed(spark, sf):
    points = R.paired_points(event_returns(spark, sf), DAILY)
    return points.groupBy("w_start", "key1", "key2").agg(F.count("*").alias("n_points"), F.max("time1").alias("last1"), F.max("time2").alias("last2"))


def _correlated(spark, sf, cfg: CorrelationConfig, points: DataFrame | None = None) -> DataFrame:
    out = R.correlations(event_returns(spark, sf) if points is None else points, cfg)
    return _rounded(out)


def pearson_all_pairs(spark, sf):
    return _correlated(spark, sf, DAILY)


def pearson_thresholded(spark, sf):
    return _correlated(spark, sf, replace(DAILY, min_corr=0.3, propagate_nan=False))


def _mixed_returns(spark, sf):
    """Returns by event type, those of error constant in price: its returns are 0 in every window."""
    ticks = sources.event_ticks(spark, sf)
    constant = F.when(F.col("key") == "error", F.lit(5.0))
    ticks = ticks.withColumn("ask", F.coalesce(constant, "ask")).withColumn("bid", F.col("ask"))
    return R.log_returns(C.build_candles(ticks, HOURLY))


def pearson_nan_policy(spark, sf):
    return _correlated(spark, sf, replace(DAILY, min_corr=0.2), _mixed_returns(spark, sf))


def pearson_nan_dropped(spark, sf):
    return _correlated(spark, sf, replace(DAILY, propagate_nan=False), _mixed_returns(spark, sf))


def pearson_partitioned(spark, sf):
    return _correlated(spark, sf, replace(DAILY, pairs="configured", keys=("click", "view", "purchase", "never")))


def pearson_by_position(spark, sf):
    return _correlated(spark, sf, replace(DAILY, align="position"))


def pearson_matrix(spark, sf):
    return _rounded(R.correlation_matrix(event_returns(spark, sf), DAILY))


def pearson_matrix_in_blocks(spark, sf):
    """The same with series dealt into four blocks, as where there are many."""
    return _rounded(R.correlation_matrix(event_returns(spark, sf), replace(DAILY, min_corr=0.3, propagate_nan=False), blocks=4))


def pearson_mismatch_error(spark, sf):
    """Unequal numbers of points fail the query; gap fill leaves none."""
    return _correlated(spark, sf, replace(DAILY, on_mismatch="error"))


def pearson_underlying(spark, sf):
    out = R.correlations(event_returns(spark, sf), replace(DAILY, include_underlying=True))
    both = F.explode(F.arrays_zip("x_values", "y_values")).alias("p")
    return out.select("time", "key", both).select("time", "key", F.col("p.x_values.time").alias("x_time"), F.col("p.y_values.time").alias("y_time"), F.round("p.x_values.value", 9).alias("x"), F.round("p.y_values.value", 9).alias("y"))


def candles_by_key_sorted(spark, sf):
    listed = sources.candles_by_key(C.build_candles(sources.event_ticks(spark, sf), HOURLY))
    return listed.select("key", F.posexplode("candles").alias("position", "c")).select("key", F.col("position").cast("long").alias("position"), "c.close_time", "c.open", "c.close")


def corr_by_time(spark, sf):
    listed = sources.correlations_by_time(R.correlations(event_returns(spark, sf), DAILY))
    return listed.select("time", F.size("correlations").cast("long").alias("n"), F.col("correlations")[0]["key"].alias("first_key"))


def sparse_user_correlations(spark, sf):
    users = tuple(str(i) for i in range(1, 21))
    points = R.log_returns(C.build_candles(sources.event_ticks(spark, sf, "user_id"), CandleConfig(candle_ms=6 * HOUR, keys=users)))
    cfg = CorrelationConfig(window_ms=4 * DAY, slide_ms=2 * DAY, min_corr=0.0, propagate_nan=True)
    return _rounded(R.correlations(points, replace(cfg, pairs="configured", keys=users)))


def all_user_correlations(spark, sf):
    """Every pair of all users in the table; sparse_user_correlations has 20 configured ones."""
    ticks = sources.event_ticks(spark, sf, "user_id")
    points = R.log_returns(C.build_candles(ticks, CandleConfig(candle_ms=6 * HOUR), keys=ticks.select("key")))
    cfg = CorrelationConfig(window_ms=4 * DAY, slide_ms=2 * DAY, min_corr=0.0, propagate_nan=True)
    return _rounded(R.correlation_matrix(points, cfg))


def stream_candles(spark, sf):
    """Events replayed as a stream to the end; the same candles as in batch."""
    return streaming.replayed_candles(sources.event_ticks(spark, sf), HOURLY)


def stream_correlations(spark, sf):
    """Events replayed as a stream through candles, returns, sliding windows and pairs; the same as in batch."""
    return _rounded(streaming.replayed_correlations(sources.event_ticks(spark, sf), HOURLY, DAILY))


def demo_correlations(spark, sf):
    """The demo's four regular series end to end; needs no table."""
    ticks = sources.demo_ticks(spark).filter("key <> 'TS-5'")
    cfg = CorrelationConfig(min_corr=0.0, propagate_nan=True)
    candles = C.build_candles(ticks, CandleConfig(keys=("TS-1", "TS-2", "TS-3", "TS-4")))
    return _rounded(R.correlations(R.log_returns(candles), cfg))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        pearson_all_pairs, ticks_assign_time, ticks_printed, ticks_total, tumbling_count, distinct_keys_per_window, missing_keys_per_window, generated_ticks, complete_ticks_union,
        partial_candles, partial_candles_bid_ask, partial_candles_bid_by_ask, window_end_stamp, complete_candles, sparse_candles, candles_without_leading_gaps, lineitem_candles,
        orders_priority_candles, end_of_time_filter, log_returns, sliding_points, work_packets, pair_keys_configured, pair_points_observed, pearson_thresholded, pearson_nan_policy,
        pearson_nan_dropped, pearson_partitioned, pearson_by_position, pearson_matrix, pearson_matrix_in_blocks, pearson_mismatch_error, pairs_by_partition, candles_json, ticks_in_time, dates_parsed, random_series, stream_correlations, pearson_underlying, candles_by_key_sorted, corr_by_time, sparse_user_correlations, all_user_correlations, stream_candles, demo_correlations,
    )
}
