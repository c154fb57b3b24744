"""Settings of a run: window lengths in milliseconds, the key universe, and how results are filtered."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CandleConfig:
    """Candles: window length, keys that are filled where they are silent, and rules for gaps and bid extremes.

    leading_gap "zero" gives a key that was never live candles of price 0, "skip" gives none.
    bid_by_ask picks the bid extremes by the ask price of their tick.
    """

    candle_ms: int = 120_000
    keys: tuple[str, ...] = ()
    leading_gap: str = "zero"
    bid_by_ask: bool = False

    def __post_init__(self):
        if self.candle_ms <= 0:
            raise ValueError("candle_ms must be positive")
        if self.leading_gap not in ("zero", "skip"):
            raise ValueError("leading_gap is 'zero' or 'skip'")
        object.__setattr__(self, "keys", tuple(dict.fromkeys(self.keys)))


@dataclass(frozen=True)
class CorrelationConfig:
    """Correlations: sliding windows, which pairs, and which results are kept.

    pairs "observed" takes all keys seen, "configured" only `keys`. align "candle" pairs points of the same candle,
    "position" the i-th points of both series. on_mismatch "drop" or "error" says what unequal point counts do.
    """

    window_ms: int = 600_000
    slide_ms: int = 300_000
    min_corr: float = 0.5
    propagate_nan: bool = False
    include_underlying: bool = False
    pairs: str = "observed"
    keys: tuple[str, ...] = field(default=())
    align: str = "candle"
    on_mismatch: str = "drop"

    def __post_init__(self):
        if self.window_ms <= 0 or self.slide_ms <= 0:
            raise ValueError("window_ms and slide_ms must be positive")
        for name, allowed in (("pairs", ("observed", "configured")), ("align", ("candle", "position")), ("on_mismatch", ("drop", "error"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {allowed}")
        if self.pairs == "configured" and not self.keys:
            raise ValueError("configured pairs need keys")
