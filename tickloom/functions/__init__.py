"""Column functions: times and windows in milliseconds, IEEE arithmetic under ANSI mode, pair keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
SEPARATOR = " :: "


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    second = F.floor(F.extract(F.lit("SECOND"), ts) * 1000)
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + second).cast("long")


def window_start(time: Column, size_ms: int) -> Column:
    """Start of the tumbling window, aligned to 1970, that holds time."""
    return time - F.pmod(time, F.lit(size_ms).cast("long"))


def window_last(start: Column, size_ms: int) -> Column:
    """The last millisecond of the window that begins at start."""
    return start + F.lit(size_ms - 1).cast("long")


def sliding_starts(time: Column, size_ms: int, slide_ms: int) -> Column:
    """Array of the starts of all sliding windows that hold time, latest first."""
    last = time - F.pmod(time, F.lit(slide_ms).cast("long"))
    n = -(-size_ms // slide_ms)
    starts = F.array(*[last - F.lit(i * slide_ms).cast("long") for i in range(n)])
    return F.filter(starts, lambda s: s + F.lit(size_ms).cast("long") > time)


def window_label(start: Column, size_ms: int) -> Column:
    """[start..end) as UTC instants with milliseconds."""
    instant = lambda ms: F.concat(
        F.date_format(F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")), "yyyy-MM-dd"),
        F.format_string("T%02d:%02d:%02d.%03dZ", *[F.pmod(F.floor(ms / d), F.lit(m)).cast("long") for d, m in ((3_600_000, 24), (60_000, 60), (1000, 60), (1, 1000))]),
    )
    return F.concat(F.lit("["), instant(start), F.lit(".."), instant(start + F.lit(size_ms).cast("long")), F.lit(")"))


def log_ratio(close: Column, open_: Column) -> Column:
    """ln(close / open) as IEEE arithmetic has it: x/0 is infinite, 0/0 and ln of a negative number are NaN."""
    zero = F.lit(0.0)
    ratio = F.when(open_ != zero, close / F.when(open_ != zero, open_))
    return (
        F.when(F.isnan(close) | F.isnan(open_), F.lit(NAN))
        .when(open_ == zero, F.when(close > zero, F.lit(INF)).otherwise(F.lit(NAN)))
        .when(ratio == zero, F.lit(-INF))
        .when(ratio < zero, F.lit(NAN))
        .otherwise(F.ln(ratio))
    )


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r; NaN if a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread == 0.0, F.lit(NAN)).otherwise(F.covar_pop(x, y) / F.when(spread != 0.0, spread))


def pair_key(a: Column, b: Column) -> Column:
    """Both keys in order, the same for either order of arguments."""
    return F.concat_ws(SEPARATOR, F.least(a, b), F.greatest(a, b))


def partition_of(key: Column, n: int) -> Column:
    """Partition number, 0 to n - 1, that a key belongs to: 52 bits of its MD5, which any engine can recompute."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") % F.lit(n)).cast("int")


def parsed_ms(text: Column, pattern: str = "dd/MM/yyyy HH:mm:ss", offset_ms: int = 0) -> Column:
    """Epoch milliseconds of a local date and time without zone that is offset_ms ahead of UTC; null if it does not parse."""
    local = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{pattern} Z"))
    return F.unix_millis(local) - F.lit(offset_ms).cast("long")


def first_part(line: Column, separator: str = ":") -> Column:
    """What stands before the first separator, such as the key of a printed tick."""
    return F.split_part(line, F.lit(separator), F.lit(1))


def state(time: Column, ask: Column, bid: Column, is_live: Column) -> Column:
    """A tick inside a candle."""
    return F.struct(time.alias("time"), ask.alias("ask"), bid.alias("bid"), is_live.alias("is_live"))
