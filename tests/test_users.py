"""Correlations of all users of a table, however many there are."""

import math
import random
from itertools import combinations

import __spark_entry__ as entry

HOUR, CANDLE, SIZE, SLIDE = 3600, 6 * 3600, 16, 8  # sizes in candles


def brute(events):
    """{(first candle of the window, pair): r or None} from (user, second, value), users in every candle."""
    users = sorted({u for u, _, _ in events})
    starts = sorted({t // CANDLE for _, t, _ in events})
    returns = {}
    for u in users:
        last = None
        for c in starts:
            own = [(t, v) for x, t, v in events if x == u and t // CANDLE == c]
            close = max(own)[1] if own else last or 0.0
            before = close if last is None else last
            last = close
            returns[u, c] = math.nan if before == 0 and close == 0 else math.inf if before == 0 else math.log(close / before)
    out = {}
    for w in range(min(starts) // SLIDE * SLIDE - SIZE, max(starts) + 1, SLIDE):
        inside = [c for c in starts if w <= c < w + SIZE]
        for a, b in combinations(users, 2) if len(inside) > 1 else ():
            x, y = ([returns[u, c] for c in inside] for u in (a, b))
            r = None
            if all(map(math.isfinite, x + y)):
                mx, my = sum(x) / len(x), sum(y) / len(y)
                sx, sy = math.sqrt(sum((v - mx) ** 2 for v in x)), math.sqrt(sum((v - my) ** 2 for v in y))
                r = sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True)) / (sx * sy) if sx * sy else None
            out[w, f"{a} :: {b}"] = r
    return out


def test_all_users_are_paired(spark, tmp_path):
    rnd = random.Random(4)
    events = [(str(rnd.randrange(15, 45)), s, float(rnd.randint(1, 99))) for s in rnd.sample(range(16 * 86400), 900)]
    rows = [(i, int(u), s, v) for i, (u, s, v) in enumerate(events)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double")
    df.selectExpr("event_id", "user_id", "cast(timestamp_seconds(s) as timestamp_ntz) ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {((r.time + 1) // 1000 // CANDLE - SIZE, r.key): None if r.is_nan else r.value for r in entry.queries()["all_user_correlations"](spark, str(tmp_path)).collect()}
    want = brute(events)
    assert got.keys() == want.keys() and len({k for _, k in got}) == 30 * 29 // 2
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-8) for k in want)
    assert sum(v is not None for v in want.values()) > 100
