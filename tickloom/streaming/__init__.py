"""Candles and correlations over unbounded ticks, with the same definitions as in batch.

Watermarked ticks are summed up by window and key. A second sum tells which windows exist at all; each such window is
sent to every key to fill, by blocks of the table of keys. A state for each key puts both together: it fills gaps,
carries the close on and opens each candle at the close before it. Log returns of those candles are gathered by
sliding window and cell of two blocks of series, and every cell is correlated by the batch kernel when the watermark
passes its end.

Late ticks, behind the watermark by more than the lateness allowed, are dropped; ticks out of order within it count.
Spark closes a window when the watermark passes its end: `replay` appends a far-future sentinel tick so that the last
windows close too, and filters it out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import CandleConfig, CorrelationConfig
from ..functions import log_ratio
from ..operators import kernel
from ..operators.candles import END_OF_TIME, SENT, key_blocks
from ..operators.correlate import correlation_rows, in_cells
from ..sources import TICKS
from ..tables import shared_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLAT = "key string, close_time bigint, open_state_time bigint, close_state_time bigint, open_ask double, close_ask double, close_is_live boolean, min_ask_price double, max_ask_price double, min_bid_price double, max_bid_price double"
COLUMNS = [c.split()[0] for c in FLAT.split(", ")]
CORRELATION = "time bigint, key string, value double, x_count int, y_count int, is_nan boolean, window string"
SENTINEL = "\u0000end"


class CarryForward(StatefulProcessor):
    """Completes a key's candles in order of time; the state is its last close.

    Rows are sums of ticks (n_ticks > 0) and windows that exist (n_ticks = 0), at most one of each for a window. Both come
    when the watermark passes the window's end.
    """

    def __init__(self, leading_gap: str):
        self.leading_gap = leading_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "time bigint, ask double, bid double, live boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        candles = pd.concat(list(rows)).sort_values(["close_time", "n_ticks"]).drop_duplicates("close_time", keep="last")
        last = self.last.get() if self.last.exists() else None
        out = []
        for c in candles.itertuples(index=False):
            if c.n_ticks > 0:
                close, extremes = (int(c.close_state_time), c.close_ask, c.close_bid, True), (c.min_ask, c.max_ask, c.min_bid, c.max_bid)
            else:
                close = (int(c.close_time), last[1], last[2], last[3]) if last else (int(c.close_time), 0.0, 0.0, False)
                extremes = (close[1], close[1], close[2], close[2])
            if self.leading_gap == "skip" and not close[3]:
                continue
            opened = last or close
            out.append((key[0], int(c.close_time), opened[0], close[0], opened[1], close[1], close[3], *extremes, c.et))
            last = close
        if last:
            self.last.update(tuple(last))
        if out:
            yield pd.DataFrame(out, columns=[*COLUMNS, "et"])

    def close(self) -> None:
        pass


def timed_candles(ticks: DataFrame, cfg: CandleConfig, lateness: str = "0 seconds", keys: DataFrame | None = None) -> DataFrame:
    """A stream of ticks to a stream of flat candles with `et`, their event time, under which watermarks go on."""
    size = f"{cfg.candle_ms} milliseconds"
    timed = ticks.withColumn("ts", F.timestamp_millis("time")).withWatermark("ts", lateness)
    first = F.struct(F.col("time"), -F.col("id"))
    bid_order = "ask" if cfg.bid_by_ask else "bid"
    # the sentinel makes no window but moves the watermark: it is told by a sum, since a condition on the key would be pushed below the watermark
    live_ticks = F.count_if(F.col("key") != SENTINEL)
    summed = timed.groupBy(F.window("ts", size).alias("w"), "key").agg(
        live_ticks.alias("n_ticks"),
        F.max_by(F.struct("time", "ask", "bid"), first).alias("close"),
        F.min("ask").alias("min_ask"),
        F.max("ask").alias("max_ask"),
        F.min_by("bid", F.struct(F.col(bid_order), F.col("time"), F.col("id"))).alias("min_bid"),
        F.max_by("bid", F.struct(F.col(bid_order), -F.col("time"), -F.col("id"))).alias("max_bid"),
    )
    at = [F.window_time("w").alias("et"), (F.unix_millis(F.col("w.end")) - 1).alias("close_time")]
    live = summed.filter("n_ticks > 0").select(
        "key", *at, "n_ticks", F.col("close.time").alias("close_state_time"), F.col("close.ask").alias("close_ask"), F.col("close.bid").alias("close_bid"), "min_ask", "max_ask", "min_bid", "max_bid"
    )
    blocks, n = key_blocks(ticks.sparkSession, cfg, keys)
    windows = timed.groupBy(F.window("ts", size).alias("w")).agg(live_ticks.alias("seen")).filter("seen > 0")
    signals = windows.select(*at, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    signals = signals.join(F.broadcast(blocks) if n <= SENT else blocks, "block")
    none = [F.lit(0).cast(t).alias(c) for c, t in live.dtypes[3:]]
    silent = signals.select(F.explode("keys").alias("key"), "et", "close_time", *none)
    both = live.unionByName(silent)
    done = both.groupBy("key").transformWithStateInPandas(CarryForward(cfg.leading_gap), f"{FLAT}, et timestamp", "Append", "EventTime", eventTimeColumnName="et")
    return done.filter(F.col("close_time") < END_OF_TIME)


def stream_candles(ticks: DataFrame, cfg: CandleConfig, lateness: str = "0 seconds", keys: DataFrame | None = None) -> DataFrame:
    """A stream of ticks (see sources) to a stream of flat candles, in append mode. Needs the RocksDB state store."""
    return timed_candles(ticks, cfg, lateness, keys).select(*COLUMNS)


def stream_correlations(ticks: DataFrame, candles: CandleConfig, cfg: CorrelationConfig, lateness: str = "0 seconds", blocks: int = 1, keys: DataFrame | None = None) -> DataFrame:
    """A stream of ticks to a stream of correlations (see operators.correlate) of all pairs over sliding windows, in append mode.

    Series are dealt into `blocks`; two blocks of one window are one row when it ends, and one task's work. The
    mismatch rule is that of `correlation_matrix`.
    """
    found = timed_candles(ticks, candles, lateness, keys)
    if cfg.pairs == "configured":
        found = found.filter(F.col("key").isin(list(cfg.keys)))
    points = found.select("key", "et", "close_time", log_ratio(F.col("close_ask"), F.col("open_ask")).alias("value"))
    sliding = F.window("et", f"{cfg.window_ms} milliseconds", f"{cfg.slide_ms} milliseconds")
    cells = in_cells(points, blocks).groupBy(sliding.alias("w"), "low", "high").agg(F.collect_list(F.struct("key", "block", "close_time", "value")).alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, low, high, held in zip(*[batch.column(i) for i in range(4)], strict=True):
                key, block, close, value = held.values.flatten()
                numbers = [np.asarray(x.to_numpy(zero_copy_only=False)) for x in (block, close, value)]
                cell = kernel.cell_of(key, *numbers, low.as_py(), high.as_py())
                yield from kernel.cell_pairs(cell, [start.as_py()], cfg).to_batches()

    return correlation_rows(cells.select(F.unix_millis(F.col("w.start")).alias("w_start"), "low", "high", "points").mapInArrow(run, kernel.KINDS), cfg)


def write_stream(rows: DataFrame, path: str, checkpoint: str, form: str = "parquet", every: str | None = None) -> StreamingQuery:
    """Starts the stream into files at path (parquet, json, ...), exactly once; `every` is the trigger's interval, else all there is and stop."""
    writer = rows.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def session_for(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application with the settings that the streams need; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


def replay(ticks: DataFrame, build: Callable[[DataFrame], DataFrame], schema: str, steps: int = 2, partitions: int = 4) -> DataFrame:
    """Ticks of a bounded table as a stream, in order of time and `steps` runs, to the end; the rows that build(stream) gave.

    For tests and backfills. Source, checkpoints and results lie in the session's shared folder. The state of each
    step lies in `partitions` parts, which stay as they are for the life of a stream.
    """
    spark = ticks.sparkSession
    shared = shared_folder(spark)
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = f"{shared}/replay-{uuid.uuid4().hex}"
    names = ["key", "time", "ask", "bid", "id", "is_live"]
    low, high = ticks.agg(F.min("time"), F.max("time")).first()
    if low is None:
        return spark.createDataFrame([], schema)
    width = (high - low) // steps + 1
    sentinel = spark.createDataFrame([(SENTINEL, 2 * END_OF_TIME, 0.0, 0.0, 0, False)], TICKS)
    own = session_for(spark, partitions)
    for i in range(steps + 1):  # one run for each step, as ticks would arrive
        part = sentinel if i == steps else ticks.filter((F.col("time") >= low + i * width) & (F.col("time") < low + (i + 1) * width))
        part.select(*names).write.mode("append").parquet(f"{root}/in")
        source = own.readStream.schema(TICKS).parquet(f"{root}/in")
        write_stream(build(source), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")


def replayed_candles(ticks: DataFrame, cfg: CandleConfig, **how) -> DataFrame:
    return replay(ticks, lambda stream: stream_candles(stream, cfg), FLAT, **how)


def replayed_correlations(ticks: DataFrame, candles: CandleConfig, cfg: CorrelationConfig, blocks: int = 1, **how) -> DataFrame:
    return replay(ticks, lambda stream: stream_correlations(stream, candles, cfg, blocks=blocks), CORRELATION, **how)
