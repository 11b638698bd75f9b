"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise import fixed


def ratio_or_zero(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(part / whole * scale)


def rate(events: Column, turns: Column, per: float = fixed.RATE_PER) -> Column:
    """Pooled rate: all events over all turns; zero without turns."""
    return ratio_or_zero(events.cast("double"), turns, per)


def band_half(events: Column, turns: Column, z: float = fixed.Z, per: float = fixed.RATE_PER) -> Column:
    """Distance of the band's ends from the rate, by the square root of the count."""
    return ratio_or_zero(z * F.sqrt(F.greatest(events.cast("double"), F.lit(0.0))), turns, per)


def rate_columns(events: Column, turns: Column) -> dict[str, Column]:
    r, half = rate(events, turns), band_half(events, turns)
    return {"rate": r, "band_lo": F.greatest(F.lit(0.0), r - half), "band_hi": r + half}


def share(hits: Column, n: Column) -> Column:
    """Hits as a percentage of n; zero when empty."""
    return ratio_or_zero(hits.cast("double"), n, 100.0)


def compare_columns(worse_rate: Column, better_rate: Column, worse_n: Column, better_n: Column) -> dict[str, Column]:
    """The difference of the rates, and their quotient where the better rate is large enough to divide by."""
    gap = worse_rate - better_rate
    can_ratio = better_rate >= fixed.MIN_RATE_FOR_RATIO
    ratio = F.when(can_ratio, worse_rate / better_rate)
    return {
        "gap": gap,
        "can_ratio": can_ratio,
        "ratio": ratio,
        "enough": (worse_n >= fixed.MIN_N) & (better_n >= fixed.MIN_N),
        "phrase": F.when(can_ratio, F.format_string("%.1f times", ratio)).otherwise(
            F.format_string("%.1f more per 10 messages", gap)
        ),
    }


def effect(can_ratio: Column, ratio: Column, gap: Column) -> Column:
    return F.when(can_ratio, F.least(F.lit(2.0), ratio - 1)).otherwise(gap / 2)


def score(effect_: Column, reach: Column, n: Column) -> Column:
    return effect_ * reach * F.least(F.lit(1.0), n / 20)
