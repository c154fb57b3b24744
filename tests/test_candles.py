"""Candle rules one by one, and against a sequential simulation on random ticks."""

import random

import pytest

from tickloom import sources
from tickloom.config import CandleConfig
from tickloom.operators import candles as C

MS = 100


def build(spark, rows, **cfg):
    """rows: (key, time, ask, bid); candles as {(key, window): row}."""
    ticks = spark.createDataFrame([(k, t, float(a), float(b), i, True) for i, (k, t, a, b) in enumerate(rows)], sources.TICKS)
    out = C.flat(C.build_candles(ticks, CandleConfig(candle_ms=MS, **cfg))).collect()
    return {(r.key, (r.close_time + 1) // MS - 1): r for r in out}


def simulate(rows, keys, bid_by_ask=False):
    """Every key's candles in order, one window after the other."""
    windows = sorted({t // MS for _, t, _, _ in rows})
    out = {}
    for key in sorted({k for k, *_ in rows} | set(keys)):
        last = None
        for w in windows:
            own = sorted((t, i, a, b) for i, (k, t, a, b) in enumerate(rows) if k == key and t // MS == w)
            end = (w + 1) * MS - 1
            if own:
                latest = max(t for t, *_ in own)
                t, _, a, b = next(o for o in own if o[0] == latest)
                close = (t, a, b, True)
                price = (lambda o: (o[2] if bid_by_ask else o[3]))
                asks = [o[2] for o in own]
                low = min(own, key=lambda o: (price(o), o[0], o[1]))[3]
                high = min(own, key=lambda o: (-price(o), o[0], o[1]))[3]
                extremes = (min(asks), max(asks), low, high)
            elif key in keys:
                close = (end, *last[1:]) if last else (end, 0.0, 0.0, False)
                extremes = (close[1], close[1], close[2], close[2])
            else:
                continue
            opened = last or close
            out[key, w] = (end, opened[0], close[0], opened[1], close[1], close[3], *extremes)
            last = close
    return out


def flat(r):
    return (r.close_time, r.open_state_time, r.close_state_time, r.open_ask, r.close_ask, r.close_is_live, r.min_ask_price, r.max_ask_price, r.min_bid_price, r.max_bid_price)


@pytest.mark.parametrize("seed", range(3))
def test_equals_sequential_simulation(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abcde"), rnd.randint(0, 20) * 60 + rnd.randint(0, 30), rnd.randint(1, 9), rnd.randint(1, 9)) for _ in range(60)]
    keys = ("a", "b", "c", "z")
    for by_ask in (False, True):
        got = build(spark, rows, keys=keys, bid_by_ask=by_ask)
        assert {k: flat(r) for k, r in got.items()} == simulate(rows, keys, by_ask)


def test_window_without_ticks_has_no_candle(spark):
    got = build(spark, [("a", 10, 1, 1), ("b", 510, 1, 1)], keys=("a", "b"))
    assert {w for _, w in got} == {0, 5}


def test_unconfigured_key_is_never_filled(spark):
    got = build(spark, [("x", 10, 1, 1), ("a", 110, 1, 1)], keys=("a",))
    assert set(got) == {("x", 0), ("a", 0), ("a", 1)}


def test_leading_gap_zero_or_skipped(spark):
    rows = [("a", 10, 1, 1), ("b", 110, 5, 5), ("a", 120, 2, 2)]
    zero = build(spark, rows, keys=("a", "b"))
    assert (zero["b", 0].close_ask, zero["b", 0].close_is_live, zero["b", 1].open_ask) == (0, False, 0)
    skip = build(spark, rows, keys=("a", "b"), leading_gap="skip")
    assert ("b", 0) not in skip and skip["b", 1].open_ask == 5


def test_boundary_belongs_to_the_later_window(spark):
    assert set(build(spark, [("a", 0, 1, 1), ("a", 99, 1, 1), ("a", 100, 1, 1)])) == {("a", 0), ("a", 1)}


def test_no_ticks_no_candles(spark):
    ticks = spark.createDataFrame([], sources.TICKS)
    assert C.build_candles(ticks, CandleConfig(keys=("a",))).collect() == []


def test_config_is_checked():
    for bad in ({"candle_ms": 0}, {"leading_gap": "?"}):
        with pytest.raises(ValueError):
            CandleConfig(**bad)
