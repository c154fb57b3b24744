"""Pairs, policies and mismatches of the correlations."""

import math
import random
from itertools import combinations

import pytest

from tickloom.config import CorrelationConfig
from tickloom.functions import log_ratio
from tickloom.operators import correlate as R

CFG = CorrelationConfig(window_ms=1000, slide_ms=1000, min_corr=0.0, propagate_nan=True)
POINTS = "key string, close_time long, time long, value double"


def points(spark, series):
    """series: {key: {candle: value}}"""
    return spark.createDataFrame([(k, c * 100 + 99, c * 100 + 50, float(v)) for k, s in series.items() for c, v in s.items()], POINTS)


def cfg(**how):
    return CorrelationConfig(**({"window_ms": 1000, "slide_ms": 1000, "min_corr": 0.0, "propagate_nan": True} | how))


def brute(xs, ys):
    n = len(xs)
    mx, my = sum(xs) / n, sum(ys) / n
    sx, sy = math.sqrt(sum((x - mx) ** 2 for x in xs)), math.sqrt(sum((y - my) ** 2 for y in ys))
    return sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / (sx * sy) if sx * sy else math.nan


def test_every_pair_once_and_symmetric(spark):
    rnd = random.Random(1)
    series = {f"k{i}": {c: rnd.gauss(0, 1) for c in range(8)} for i in range(7)}
    for got in (R.correlations(points(spark, series), CFG), R.correlation_matrix(points(spark, series), CFG, blocks=3)):
        rows = {r.key: r for r in got.collect()}
        assert len(rows) == 21
        for a, b in combinations(sorted(series), 2):
            assert rows[f"{a} :: {b}"].value == pytest.approx(brute(list(series[a].values()), list(series[b].values())), abs=1e-12)
            assert abs(rows[f"{a} :: {b}"].value) <= 1 + 1e-12


def test_constant_series_and_nan_policy(spark):
    df = points(spark, {"a": {0: 1, 1: 2, 2: 4}, "b": {0: 3, 1: 3, 2: 3}})
    row = R.correlations(df, cfg(min_corr=0.9)).first()
    assert (row.value, row.is_nan) == (1.0, True)
    assert R.correlations(df, cfg(propagate_nan=False)).count() == 0


def test_threshold_keeps_its_own_value(spark):
    df = points(spark, {"a": {0: 0, 1: 1, 2: 0, 3: 1}, "b": {0: 0, 1: 1, 2: 1, 3: 0}, "c": {0: 0, 1: 2, 2: 0, 3: 2}})
    keys = lambda m: {r.key for r in R.correlations(df, cfg(min_corr=m)).collect()}
    assert keys(1.0) == {"a :: c"} and keys(0.0) == {"a :: b", "a :: c", "b :: c"} and keys(1.1) == set()


def test_single_point_is_no_correlation(spark):
    assert R.correlations(points(spark, {"a": {0: 1}, "b": {0: 2}}), CFG).count() == 0


def test_unequal_counts_are_dropped_or_fail(spark):
    df = points(spark, {"a": {0: 1, 1: 2, 2: 4}, "b": {0: 3, 1: 5}, "c": {0: 1, 1: 2, 2: 5}})
    assert {r.key for r in R.correlations(df, CFG).collect()} == {"a :: c"}
    assert {r.key for r in R.correlation_matrix(df, CFG, blocks=2).collect()} == {"a :: c"}
    with pytest.raises(Exception, match="unequal numbers of points"):
        R.correlations(df, cfg(on_mismatch="error")).collect()


def test_position_pairs_different_candles(spark):
    df = points(spark, {"a": {0: 1, 1: 2, 2: 4}, "b": {3: 1, 5: 2, 7: 4}})
    assert R.correlations(df, CFG).count() == 0
    assert R.correlations(df, cfg(align="position")).first().value == pytest.approx(1.0)


def test_configured_pairs_and_payload(spark):
    df = points(spark, {"a": {0: 1, 1: 2}, "b": {0: 2, 1: 1}, "c": {0: 1, 1: 3}})
    row = R.correlations(df, cfg(pairs="configured", keys=("a", "c", "never"), include_underlying=True)).collect()
    assert [r.key for r in row] == ["a :: c"]
    assert [(p.key, p.time, p.value) for p in row[0].y_values] == [("c", 50, 1.0), ("c", 150, 3.0)]


def test_sliding_windows_hold_each_point_size_over_slide_times(spark):
    df = points(spark, {"a": {i: i for i in range(30)}})
    out = R.in_sliding_windows(df, cfg(window_ms=1000, slide_ms=300)).collect()
    for r in out:
        assert r.w_start % 300 == 0 and r.w_start <= r.close_time < r.w_start + 1000
    assert len(out) == sum(1 for c in range(30) for s in range(-1200, 3001, 300) if s <= c * 100 + 99 < s + 1000)


def test_log_ratio_is_ieee(spark):
    rows = [(2.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (-1.0, 1.0), (-1.0, 0.0)]
    got = [r.v for r in spark.createDataFrame(rows, "c double, o double").select(log_ratio(R.F.col("c"), R.F.col("o")).alias("v")).collect()]
    assert got[0] == pytest.approx(math.log(2)) and got[1] == -math.inf and got[2] == math.inf
    assert all(math.isnan(v) for v in got[3:])


def test_config_is_checked():
    for bad in ({"window_ms": 0}, {"pairs": "?"}, {"pairs": "configured"}, {"align": "?"}):
        with pytest.raises(ValueError):
            CorrelationConfig(**bad)
