"""Where ticks come from and where results go.

A table of ticks has key, time (epoch milliseconds), ask, bid, id (decides between
ticks of one key and time) and is_live (false for ticks made to fill a gap).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import epoch_ms

#: First instant of the demo data.
DEMO_START = 1_451_577_600_000
MINUTE = 60_000
TICKS = "key string, time bigint, ask double, bid double, id bigint, is_live boolean"


def as_ticks(table: DataFrame, key: Column, time: Column, ask: Column, bid: Column | None = None, ident: Column | None = None) -> DataFrame:
    """Any table as ticks; a table of single values has bid = ask."""
    return table.select(
        key.cast("string").alias("key"),
        time.cast("long").alias("time"),
        ask.cast("double").alias("ask"),
        (ask if bid is None else bid).cast("double").alias("bid"),
        (F.lit(0) if ident is None else ident).cast("long").alias("id"),
        F.lit(True).alias("is_live"),
    )


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    return as_ticks(parquet(spark, sf_dir, "events"), F.col(key), epoch_ms(F.col("ts")), F.col("value"), ident=F.col("event_id"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(parquet(spark, sf_dir, "orders"), F.col("o_orderpriority"), epoch_ms(F.col("o_orderdate")), F.col("o_totalprice"), ident=F.col("o_orderkey"))


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = F.col("l_extendedprice")
    ident = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return as_ticks(parquet(spark, sf_dir, "lineitem"), F.col("l_returnflag"), epoch_ms(F.col("l_shipdate")), ask, ask * (1 - F.col("l_discount")), ident)


def triangle(start: int, key: str, value: float, step: float) -> list[tuple]:
    """Ten ticks a minute apart: four steps up, one minute level, four steps down."""
    offsets = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]
    return [(key, start + i * MINUTE, value + step * o, value + step * o) for i, o in enumerate(offsets)]


def demo_rows(seed: int = 0, start: int = DEMO_START) -> list[tuple]:
    """Five series over ten minutes: two equal rising waves, two equal falling ones with gaps, one at random."""
    rows = [t for key in ("TS-1", "TS-2") for t in triangle(start, key, 1.0, 1.0)]
    silent = (2, 3, 7, 8)
    rows += [t for key in ("TS-3", "TS-4") for i, t in enumerate(triangle(start, key, 10.0, -1.0)) if i not in silent]
    rnd = random.Random(seed)
    rows += [("TS-5", start + i * MINUTE, rnd.random(), rnd.random()) for i in range(10)]
    return rows


def demo_ticks(spark: SparkSession, seed: int = 0) -> DataFrame:
    rows = [(k, t, a, b, i, True) for i, (k, t, a, b) in enumerate(demo_rows(seed))]
    return spark.createDataFrame(rows, TICKS)


def random_ticks(spark: SparkSession, keys: tuple[str, ...], n: int, seed: int = 0, start: int = DEMO_START, every_ms: int = MINUTE) -> DataFrame:
    """n ticks of each key, every_ms apart, with independent random prices in [0, 1); the same for the same seed, however it is run."""
    names = spark.createDataFrame([(k,) for k in keys], "key string")
    ticks = names.select("key", F.explode(F.sequence(F.lit(0), F.lit(n - 1).cast("long"))).alias("id"))
    price = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "key", "id"), 11) / float(2**53)
    return ticks.select("key", (F.lit(start) + F.col("id") * every_ms).alias("time"), price(1).alias("bid"), price(2).alias("ask"), "id", F.lit(True).alias("is_live"))


def with_event_time(ticks: DataFrame) -> DataFrame:
    """ts: the event time as a timestamp, for watermarks."""
    return ticks.withColumn("ts", F.timestamp_millis("time"))


def printed(ticks: DataFrame) -> DataFrame:
    """One line for each tick: key:ask:bid:time."""
    return ticks.select(F.concat_ws(":", "key", "ask", "bid", "time").alias("line"))


def candles_by_key(candles: DataFrame) -> DataFrame:
    """Each key's candles as one array ordered by time, for inspection."""
    entry = F.struct("close_time", F.col("open.ask").alias("open"), F.col("close.ask").alias("close"))
    return candles.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("candles"))


def correlations_by_time(correlations: DataFrame) -> DataFrame:
    """Each window's correlations as one array ordered by pair, for inspection."""
    return correlations.groupBy("time").agg(F.array_sort(F.collect_list(F.struct("key", "value", "is_nan"))).alias("correlations"))


def json_lines(records: DataFrame) -> DataFrame:
    """One line of JSON for each record, nested candles and arrays included."""
    return records.select(F.to_json(F.struct("*")).alias("line"))


def stream_of_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Ticks from Parquet files as they arrive in a folder; at most max_files a batch."""
    reader = spark.readStream.schema(TICKS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
