"""Dates and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_millis(value: Column) -> Column:
    return F.timestamp_millis(value.cast("bigint"))


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes to two places; zero when either end is missing.

    The hundredths are rounded as the floating-point number they are, half to even: 0.545 * 100 is a little more than 54.5 and gives 0.55.
    """
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.coalesce(F.rint(micros / F.lit(60_000_000.0) * 100) / 100, F.lit(0.0))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def days_before(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def _count(value: Column, suffix: str) -> Column:
    return F.concat(F.floor(value).cast("string"), F.lit(suffix))


def relative_age(ts: Column, now: Column) -> Column:
    """"just now", "12s ago", ... "3w ago"."""
    s = F.greatest(F.lit(0.0), seconds_between(ts, now))
    return (
        F.when(ts.isNull(), "")
        .when(s < 8, "just now")
        .when(s < 60, _count(s, "s ago"))
        .when(s < 3600, _count(s / 60, "m ago"))
        .when(s < 86400, _count(s / 3600, "h ago"))
        .when(s < 604800, _count(s / 86400, "d ago"))
        .otherwise(_count(s / 604800, "w ago"))
    )


def fixed_places(value: Column, places: int) -> Column:
    """``value`` (0 or more) to so many places, from its exact binary value and half to even, as C prints it.

    ``format_string`` rounds the shortest decimal instead: 2.15 is a little less than 2.15 and is printed 2.1 here.
    """
    scale = 10**places
    below = F.floor(value * scale)
    # Twice the distance from the middle of two neighbours. Powers of two times the value are exact, and so are their sums near the middle.
    past = -(2 * below + 1).cast("double")
    for power in (128, 64, 32, 16, 8, 4, 2):
        if 2 * scale & power:
            past = past + value * power
    up = (past > 0) | ((past == 0) & (below % 2 == 1))
    return F.format_string(f"%.{places}f", (below + up.cast("int")) / F.lit(float(scale)))


def duration(seconds: Column) -> Column:
    """"45s", "12m", "1.5h", "3d"."""
    return (
        F.when(seconds.isNull() | (seconds < 0), "")
        .when(seconds < 90, _count(seconds + 0.5, "s"))
        .when(seconds < 5400, _count(seconds / 60 + 0.5, "m"))
        .when(seconds < 36000, F.concat(fixed_places(seconds / 3600, 1), F.lit("h")))
        .when(seconds < 172800, F.concat(fixed_places(seconds / 3600, 0), F.lit("h")))
        .otherwise(_count(seconds / 86400 + 0.5, "d"))
    )


def tokens(n: Column) -> Column:
    n = n.cast("double")
    return (
        F.when(n >= 1e6, F.concat(fixed_places(n / 1e6, 1), F.lit("M")))
        .when(n >= 1e3, _count(n / 1e3 + 0.5, "K"))
        .otherwise(_count(n + 0.5, ""))
    )


def byte_size(n: Column) -> Column:
    n = n.cast("double")
    return (
        F.when(n >= 1e6, F.concat(fixed_places(n / 1e6, 1), F.lit(" MB")))
        .when(n >= 1e3, _count(n / 1e3 + 0.5, " KB"))
        .otherwise(_count(n + 0.5, " B"))
    )


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.0f%%", F.bround(value.cast("double"), 0)))


def dollars(value: Column) -> Column:
    return F.format_string("$%.2f", value.cast("double"))
