"""Results that are known by hand: demo ticks, gap fill, candles, correlations."""

import math
import random

import pytest

from tickloom import sources
from tickloom.config import CandleConfig, CorrelationConfig
from tickloom.operators import candles as C
from tickloom.operators import correlate as R

T0 = sources.DEMO_START
KEYS = tuple(f"TS-{i}" for i in range(1, 6))


def end(n):
    return T0 + (n + 1) * 120_000 - 1


@pytest.fixture(scope="module")
def ticks(spark):
    return sources.demo_ticks(spark).cache()


def test_demo_has_42_ticks(ticks):
    assert ticks.count() == 42


def test_gap_fill_adds_two_ticks(ticks):
    got = C.complete_ticks(ticks, CandleConfig(keys=KEYS)).filter("NOT is_live").collect()
    assert sorted((r.key, r.time, r.ask, r.bid) for r in got) == [("TS-3", 1451577839999, 0.0, 0.0), ("TS-4", 1451577839999, 0.0, 0.0)]


def test_candles_of_one_series_in_any_order(spark, ticks):
    rows = ticks.filter("key = 'TS-1'").collect()
    random.Random(1).shuffle(rows)
    shuffled = spark.createDataFrame(rows, sources.TICKS)
    got = C.flat(C.build_candles(shuffled, CandleConfig(keys=("TS-1",)))).orderBy("close_time").collect()
    assert [(r.close_time, r.open_state_time, r.close_state_time, r.min_ask_price, r.max_ask_price, r.min_bid_price, r.max_bid_price) for r in got] == [
        (1451577719999, 1451577660000, 1451577660000, 1, 2, 1, 2),
        (1451577839999, 1451577660000, 1451577780000, 3, 4, 3, 4),
        (1451577959999, 1451577780000, 1451577900000, 5, 5, 5, 5),
        (1451578079999, 1451577900000, 1451578020000, 3, 4, 3, 4),
        (1451578199999, 1451578020000, 1451578140000, 1, 2, 1, 2),
    ]


def test_candles_across_a_gap(ticks):
    built = C.build_candles(ticks, CandleConfig(keys=KEYS)).filter("key = 'TS-3'")
    got = C.flat(built).orderBy("close_time").collect()
    assert [(r.open_ask, r.open_state_time, r.close_ask, r.close_state_time, r.min_ask_price, r.max_ask_price) for r in got] == [
        (9, T0 + 60_000, 9, T0 + 60_000, 9, 10),
        (9, T0 + 60_000, 9, end(1), 9, 9),
        (9, end(1), 6, T0 + 300_000, 6, 6),
        (6, T0 + 300_000, 7, T0 + 360_000, 7, 7),
        (7, T0 + 360_000, 10, T0 + 540_000, 10, 10),
    ]
    assert [r.is_live for r in built.orderBy("close_time").collect()] == [True, False, True, True, True]
    values = [r.value for r in R.log_returns(built).orderBy("close_time").collect()]
    assert values == pytest.approx([0, 0, math.log(6 / 9), math.log(7 / 6), math.log(10 / 7)], abs=1e-12)


def test_correlations(ticks):
    points = R.log_returns(C.build_candles(ticks.filter("key <> 'TS-5'"), CandleConfig(keys=KEYS[:4])))
    cfg = CorrelationConfig(min_corr=0.0, propagate_nan=True)
    for found in (R.correlations(points, cfg), R.correlation_matrix(points, cfg, blocks=3)):
        got = {((r.time + 1 - 600_000 - T0) // 1000, r.key): r for r in found.collect()}
        assert len(got) == 18
        for start, n, across in ((-300, 2, None), (0, 5, -0.7080528534635366), (300, 3, -0.9799828854420735)):
            for a in range(1, 5):
                for b in range(a + 1, 5):
                    r = got[start, f"TS-{a} :: TS-{b}"]
                    want = 1.0 if (a, b) == (1, 2) else None if start < 0 else 1.0 if (a, b) == (3, 4) else across
                    assert (r.x_count, r.y_count, r.is_nan) == (n, n, want is None)
                    assert r.value == pytest.approx(1.0 if want is None else want, abs=1e-12)
        assert got[0, "TS-1 :: TS-2"].window == "[2015-12-31T16:00:00.000Z..2015-12-31T16:10:00.000Z)"


def test_all_five_series_give_30_rows(ticks):
    points = R.log_returns(C.build_candles(ticks, CandleConfig(keys=KEYS)))
    assert R.correlations(points, CorrelationConfig(min_corr=0.0, propagate_nan=True)).count() == 30
    dropped = R.correlations(points, CorrelationConfig(min_corr=0.0)).collect()
    assert len(dropped) < 30 and not any(r.is_nan for r in dropped)
