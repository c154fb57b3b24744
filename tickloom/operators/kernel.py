"""Correlations of all pairs of series in a cell: two blocks of series over some windows, by matrix products."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ..config import CorrelationConfig

NAMES = ("w_start", "key1", "key2", "r", "x_count", "y_count")
KINDS = "w_start long, key1 string, key2 string, r double, x_count long, y_count long"
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())


class Cell(NamedTuple):
    """Points of two blocks of series: value[i] of the series named keys[code[i]] in the candle close[i]; owner: block of each series."""

    keys: pa.Array
    owner: np.ndarray
    code: np.ndarray
    close: np.ndarray
    value: np.ndarray
    low: int
    high: int


def cell_of(key: pa.Array, block: np.ndarray, close: np.ndarray, value: np.ndarray, low: int, high: int) -> Cell:
    coded = key.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.zeros(len(coded.dictionary), np.int64)
    owner[code] = block
    return Cell(coded.dictionary, owner, code, close, value, low, high)


def _shapes(there: np.ndarray) -> Iterable[np.ndarray]:
    """Rows that have points in the same columns, together."""
    if there.all():
        return [np.arange(len(there))]
    same = np.unique(np.packbits(there, axis=1), axis=0, return_inverse=True)[1].ravel()
    return [np.flatnonzero(same == s) for s in range(same.max() + 1)]


def _product(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson's r of rows a with rows b; NaN where one is constant or not finite."""
    constant = x.max(axis=1) == x.min(axis=1)
    with np.errstate(invalid="ignore"):
        x = x - x.mean(axis=1, keepdims=True)
        spread = np.where(constant, 0.0, np.sqrt((x * x).sum(axis=1)))
        both = np.outer(spread[a], spread[b])
        return np.divide(x[a] @ x[b].T, both, out=np.full(both.shape, np.nan), where=both != 0)


def cell_pairs(cell: Cell, starts: Iterable[int], cfg: CorrelationConfig) -> pa.Table:
    """NAMES for each pair of the cell and each window start, of those that the configuration keeps.

    Series pair up where they have points in the same candles of a window, two or more; others are dropped or fail.
    """
    out = []
    if len(cell.code):
        candles, column = np.unique(cell.close, return_inverse=True)
        values, there = np.full((len(cell.keys), len(candles)), np.nan), np.zeros((len(cell.keys), len(candles)), bool)
        values[cell.code, column], there[cell.code, column] = cell.value, True
        for start in starts:
            lo, hi = np.searchsorted(candles, (start, start + cfg.window_ms))
            held = np.flatnonzero(there[:, lo:hi].any(axis=1))
            if not len(held):
                continue
            shapes = _shapes(there[held, lo:hi])
            if cfg.on_mismatch == "error" and len(shapes) > 1:
                raise ValueError("unequal numbers of points")
            for rows in shapes:
                rows = held[rows]
                columns = lo + np.flatnonzero(there[rows[0], lo:hi])
                if len(columns) < 2 or len(rows) < 2:
                    continue
                owner = cell.owner[rows]
                a, b = np.flatnonzero(owner == cell.low), np.flatnonzero(owner == cell.high)
                r = _product(values[np.ix_(rows, columns)], a, b)
                keep = np.isnan(r) if cfg.propagate_nan else np.zeros(r.shape, bool)
                with np.errstate(invalid="ignore"):
                    keep |= np.abs(r) >= cfg.min_corr
                i, j = np.nonzero(np.triu(keep, 1) if cell.low == cell.high else keep)
                n = pa.array(np.full(len(i), len(columns)))
                named = [cell.keys.take(pa.array(rows[x])) for x in (a[i], b[j])]
                out.append(pa.table([pa.array(np.full(len(i), start, np.int64)), *named, pa.array(r[i, j]), n, n], NAMES))
    return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in _TYPES], NAMES)
