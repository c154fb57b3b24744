"""The stream gives the candles and correlations that batch gives, and what is known by hand."""

import random

import pytest

from tickloom import sources, streaming
from tickloom.config import CandleConfig, CorrelationConfig
from tickloom.operators import candles as C
from tickloom.operators import correlate as R

T0 = sources.DEMO_START
KEYS = tuple(f"TS-{i}" for i in range(1, 5))


def rows(df):
    return sorted(map(tuple, df.select(*streaming.COLUMNS).collect()))


def test_stream_equals_batch(spark):
    rnd = random.Random(3)
    ticks = [(rnd.choice("abcx"), rnd.randint(0, 30) * 1000 + rnd.randint(0, 400), float(rnd.randint(1, 9)), float(rnd.randint(1, 9)), i, True) for i in range(50)]
    df = spark.createDataFrame(ticks, sources.TICKS)
    cfg = CandleConfig(candle_ms=1000, keys=("a", "b", "c", "never"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert rows(streaming.replayed_candles(df, cfg, steps=3)) == rows(C.flat(C.build_candles(df, cfg)))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_goldens_hold_on_the_stream(spark):
    ticks = sources.demo_ticks(spark).filter("key <> 'TS-5'")
    got = streaming.replayed_candles(ticks, CandleConfig(keys=KEYS)).collect()
    one = sorted(tuple(r[c] for c in ("close_time", "open_state_time", "close_state_time", "min_ask_price", "max_ask_price", "min_bid_price", "max_bid_price")) for r in got if r.key == "TS-1")
    assert one == [
        (1451577719999, 1451577660000, 1451577660000, 1, 2, 1, 2),
        (1451577839999, 1451577660000, 1451577780000, 3, 4, 3, 4),
        (1451577959999, 1451577780000, 1451577900000, 5, 5, 5, 5),
        (1451578079999, 1451577900000, 1451578020000, 3, 4, 3, 4),
        (1451578199999, 1451578020000, 1451578140000, 1, 2, 1, 2),
    ]
    filled = sorted((r.key, r.close_time, r.close_ask) for r in got if r.close_state_time == r.close_time)
    assert filled == [("TS-3", 1451577839999, 9.0), ("TS-4", 1451577839999, 9.0)]


def test_correlations_of_the_demo_on_a_stream(spark):
    ticks = sources.demo_ticks(spark).filter("key <> 'TS-5'")
    cfg = CorrelationConfig(min_corr=0.0, propagate_nan=True)
    got = {((r.time + 1 - 600_000 - T0) // 1000, r.key): r for r in streaming.replayed_correlations(ticks, CandleConfig(keys=KEYS), cfg, blocks=3).collect()}
    assert len(got) == 18
    for start, n, across in ((-300, 2, None), (0, 5, -0.7080528534635366), (300, 3, -0.9799828854420735)):
        for a in range(1, 5):
            for b in range(a + 1, 5):
                r = got[start, f"TS-{a} :: TS-{b}"]
                want = 1.0 if (a, b) == (1, 2) else None if start < 0 else 1.0 if (a, b) == (3, 4) else across
                assert (r.x_count, r.y_count, r.is_nan) == (n, n, want is None)
                assert r.value == pytest.approx(1.0 if want is None else want, abs=1e-12)


def test_late_ticks_are_dropped_and_early_files_wait(spark, tmp_path):
    """Out-of-order ticks within the lateness count, later ones do not; files come and go through the file source and sink."""
    cfg = CandleConfig(candle_ms=1000, keys=("a",))
    own = streaming.session_for(spark, 2)
    (tmp_path / "in").mkdir()
    stream = sources.stream_of_files(own, f"{tmp_path}/in", max_files=5)

    def arrive(*ticks):
        spark.createDataFrame([(k, t, p, p, i, True) for i, (k, t, p) in enumerate(ticks)], sources.TICKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaming.write_stream(streaming.stream_candles(stream, cfg, lateness="2 seconds"), f"{tmp_path}/out", f"{tmp_path}/state", "json").awaitTermination()
        return sorted((r.key, r.close_time, r.close_ask) for r in spark.read.schema(streaming.FLAT).json(f"{tmp_path}/out").collect())

    arrive(("a", 1_100, 1.0), ("b", 3_500, 2.0), ("a", 20_000, 3.0))
    closed = [("a", 1_999, 1.0), ("a", 3_999, 1.0), ("b", 3_999, 2.0)]
    # 1,200 is behind the watermark of 18,000 and lost; 19,100 is not; 20,999 waits for the watermark
    got = arrive(("a", 1_200, 9.0), ("a", 19_100, 4.0), ("b", 20_500, 5.0), (streaming.SENTINEL, 2 * C.END_OF_TIME, 0.0))
    assert got == sorted([*closed, ("a", 19_999, 4.0), ("a", 20_999, 3.0), ("b", 20_999, 5.0)])


def test_nothing_streams_nothing(spark):
    empty = spark.createDataFrame([], sources.TICKS)
    assert streaming.replayed_candles(empty, CandleConfig()).count() == 0
    assert streaming.replayed_correlations(empty, CandleConfig(), CorrelationConfig()).count() == 0


def test_batch_kernel_and_pairs_agree_in_any_layout(spark, monkeypatch):
    """Blocks of series and cuts of time change nothing, whatever the bounds ask for."""
    rnd = random.Random(5)
    points = [(f"k{k}", c * 100 + 99, c * 100 + 50, rnd.gauss(0, 1)) for k in range(7) for c in range(60) if k != 6 or c % 11]
    df = spark.createDataFrame(points, "key string, close_time long, time long, value double")
    cfg = CorrelationConfig(window_ms=1000, slide_ms=300, min_corr=0.2)
    seen = lambda found: sorted((r.time, r.key, round(r.value, 9), r.x_count) for r in found.collect())
    want = seen(R.correlations(df, cfg))
    assert len(want) > 200
    for series, numbers in ((2048, 1 << 23), (3, 1 << 23), (2, 60)):
        monkeypatch.setattr(R, "SERIES", series)
        monkeypatch.setattr(R, "NUMBERS", numbers)
        assert seen(R.correlation_matrix(df, cfg)) == want
