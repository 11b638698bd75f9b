"""Signals that depend on record order.

Every function takes a table and an :class:`Ordering` (or key columns), so it
runs on transcripts, event logs, conversation turns or documents alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.functions import formats, text as X
from turnwise.operators.ordering import (
    Fold, Ordering, by_number, first_by, latest, previous, running_max, running_min, running_sum, scan, top_k, total,
)


def count_if(pred: Column) -> Column:
    return F.count_if(F.coalesce(pred, F.lit(False)))


def dedupe_first(df: DataFrame, keys: Sequence[str], id_col: str, position: Column) -> DataFrame:
    """First row per id wins, however far apart the copies are; rows without an id all stay."""
    own = F.concat(F.lit("\0"), F.xxhash64(position).cast("string"), F.lit("\0"), position.cast("string"))
    keyed = df.withColumn("__id", F.coalesce(F.nullif(F.col(id_col).cast("string"), F.lit("")), own))
    return first_by(keyed, [*keys, "__id"], position).drop("__id").select(*df.columns)


def turn_numbers(df: DataFrame, o: Ordering, is_turn: Column, out: str = "turn_no") -> DataFrame:
    """Running count of turns, this row included."""
    return scan(df, o, **{out: running_sum(F.coalesce(is_turn, F.lit(False)).cast("bigint"))})


def minutes_in(df: DataFrame, o: Ordering, ts: str, out: str = "minutes_in") -> DataFrame:
    """Minutes from the earliest to the latest timestamp seen so far."""
    seen = scan(df, o, __lo=running_min(F.col(ts)), __hi=running_max(F.col(ts)))
    return seen.withColumn(out, formats.minutes_between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def gap_seconds(before: Column, now: Column, max_gap: int = fixed.ACTIVE_GAP_SECONDS) -> Column:
    """Length of a working gap; null for pauses, repeats and steps back in time."""
    gap = formats.seconds_between(before, now)
    return F.when((gap > 0) & (gap <= max_gap), gap)


def active_seconds(df: DataFrame, o: Ordering, ts: str, max_gap: int = fixed.ACTIVE_GAP_SECONDS) -> DataFrame:
    """Working time per key: gaps between consecutive timestamps, long pauses left out."""
    seen = scan(df.select(*o.keys, *dict.fromkeys([*o.order, ts])).filter(F.col(ts).isNotNull()), o, __prev=previous(F.col(ts)))
    gap = gap_seconds(F.col("__prev"), F.col(ts), max_gap)
    return seen.groupBy(*o.keys).agg(
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("active_seconds"), F.count(gap).alias("gaps")
    )


def activity_bursts(df: DataFrame, o: Ordering, ts: str, max_gap: int = fixed.ACTIVE_GAP_SECONDS) -> DataFrame:
    """Runs of records no further apart than ``max_gap`` seconds (batch twin of the streaming bursts).

    Bursts are numbered by scans and summed with partial aggregates, so one
    very busy key is spread over many tasks.
    """
    seen = scan(df.select(*o.keys, *dict.fromkeys([*o.order, ts])), o, __prev=previous(F.col(ts)))
    apart = formats.seconds_between(F.col("__prev"), F.col(ts)) > max_gap
    marked = seen.withColumn("__new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0))
    numbered = scan(marked, o, burst=running_sum(F.col("__new")))
    return numbered.groupBy(*o.keys, "burst").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")
    ).withColumn("seconds", formats.seconds_between(F.col("start"), F.col("end")))


def first_mark_turn(df: DataFrame, keys: Sequence[str], turn_no: Column, mark: Column, out: str) -> DataFrame:
    """How deep into a key the first marked row is, counted in turns, at least 1."""
    return df.groupBy(*keys).agg(F.min(F.when(mark, F.greatest(F.lit(1), turn_no))).alias(out))


def repeated_wording(df: DataFrame, keys: Sequence[str], turn: str, text: str, n: int = fixed.SHINGLE_WORDS) -> DataFrame:
    """Flag turns that share an n-word run with an earlier turn of the same key.

    A turn is new exactly when it is the first holder of every one of its runs.
    So each run finds its first holder with a map-side combined ``min`` over
    plain numbers (a hash aggregate: no self-join, no window, no sort, however
    common a run is), and a turn repeats when it is first for fewer runs than
    it has.  All joins are on key and turn, so a hot key is spread by its turns.
    """
    keys = list(keys)
    own = X.shingles(F.col(text), n)
    runs = df.select(*keys, turn, F.explode(own).alias("__run"))
    firsts = runs.groupBy(*keys, "__run").agg(F.min(turn).alias("__first"))
    fresh = firsts.groupBy(*keys, F.col("__first").alias(turn)).agg(F.count("*").alias("__new"))
    flagged = df.select(*keys, turn, F.size(own).alias("__runs")).join(fresh, [*keys, turn], "left")
    return flagged.select(*keys, turn, (F.col("__runs") > F.coalesce("__new", F.lit(0))).alias("repeated"))


def drop_repeated_boundaries(df: DataFrame, o: Ordering, cols: Sequence[str]) -> DataFrame:
    """Drop boundary rows equal (nulls included) to the boundary before them."""
    seen = scan(df, o, __prev=previous(F.struct(*cols)))
    same = F.col("__prev").isNotNull()
    for c in cols:
        same = same & F.col(f"__prev.{c}").eqNullSafe(F.col(c))
    return seen.filter(~same).drop("__prev")


def post_boundary_window(
    df: DataFrame, o: Ordering, boundary: Column, turn_no: str, size: int = fixed.POST_BOUNDARY_TURNS
) -> DataFrame:
    """Turns since the latest boundary, and whether a turn or an interruption falls in its window."""
    seen = scan(df, o, __at=latest(F.when(boundary, F.col(turn_no))))
    since = F.col(turn_no) - F.col("__at")
    return seen.withColumns(
        {
            "turns_since": since,
            "turn_in_window": F.coalesce((since >= 1) & (since <= size), F.lit(False)),
            "interrupt_in_window": F.coalesce(since < size, F.lit(False)),
        }
    ).drop("__at")


def counter_resets(df: DataFrame, o: Ordering, value: str, ratio: float = fixed.RESET_RATIO) -> DataFrame:
    """Mark rows whose counter fell below ``ratio`` of the previous one."""
    seen = scan(df, o, __prev=previous(F.col(value)))
    fell = (F.col("__prev") != 0) & (F.col(value) < F.col("__prev") * ratio)
    return seen.withColumn("is_reset", F.coalesce(fell, F.lit(False))).drop("__prev")


def peak_and_final(df: DataFrame, o: Ordering, value: str, label: str) -> DataFrame:
    """Highest value with the label of its first occurrence, and the last value."""
    at = F.col(o.order[0])
    earliest_peak = F.struct(F.col(value), -at if len(o.order) == 1 else -F.unix_micros(at), *[-F.col(c) for c in o.order[1:]])
    return df.groupBy(*o.keys).agg(
        F.max(value).alias("peak"),
        F.max_by(label, earliest_peak).alias("peak_label"),
        F.max_by(value, o.position).alias("final"),
    )


def series_folds(y: str) -> dict[str, Fold]:
    """What a series needs to know about each point: its number, how many there are, the peak."""
    return {"__i": running_sum(F.lit(1)), "__n": total(F.sum, F.lit(1)), "__top": total(F.max, F.col(y))}


def series_aggregates(x: str, y: str, target: int | None = None) -> list[Column]:
    """Per key: the evenly spaced points (all without a ``target``) and the first peak; every other point is dropped row by row."""
    i, n = F.col("__i") - 1, F.col("__n")
    if target is None:
        slot = i.cast("int")
    else:
        step = (n - 1) / F.lit(float(target - 1))
        near = F.round(i / step)
        slot = F.when(n <= target, i).when(F.bround(near * step, 0) == i, near).cast("int")
    point = F.struct(F.col(x).alias("x"), slot.alias("slot"), F.col(y).alias("y"))
    return [
        F.collect_list(F.when(slot.isNotNull(), point)).alias("__points"),
        F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.when(F.col(y) == F.col("__top"), F.col("__i"))).alias("__peak"),
    ]


def series_column(target: int | None = None) -> Column:
    """The finished series; the peak takes the middle slot when the stride missed it."""
    if target is None:
        return F.transform(F.array_sort("__points"), lambda p: F.struct(p["x"].alias("min"), p["y"].alias("ctx")))
    has_peak = F.exists("__points", lambda p: (p["x"] == F.col("__peak.x")) & (p["y"] == F.col("__peak.y")))
    swapped = F.transform(
        "__points",
        lambda p: F.when(
            p["slot"] == target // 2,
            F.struct(F.col("__peak.x").alias("x"), p["slot"].alias("slot"), F.col("__peak.y").alias("y")),
        ).otherwise(p),
    )
    ordered = F.array_sort(F.when(has_peak, F.col("__points")).otherwise(swapped))
    return F.transform(ordered, lambda p: F.struct(p["x"].alias("min"), p["y"].alias("ctx")))


def downsample_series(df: DataFrame, o: Ordering, x: str, y: str, target: int) -> DataFrame:
    """At most ``target`` points per key: evenly spaced, both ends, and the true peak."""
    numbered = scan(df.select(*o.keys, *dict.fromkeys([*o.order, x, y])), o, **series_folds(y))
    gathered = numbered.groupBy(*o.keys).agg(*series_aggregates(x, y, target))
    return gathered.select(*o.keys, series_column(target).alias("series"))


def match_results(df: DataFrame, o: Ordering, id_col: str, is_use: Column, carry: Sequence[str]) -> DataFrame:
    """Give each result row the fields of the use it answers, or nulls.

    ``df`` holds uses and results together; a result is answered only when the
    event before it under the same id is a use.
    """
    per_id = o.keyed(*o.keys, id_col)
    own = scan(
        df.filter(F.col(id_col).isNotNull()),
        per_id,
        __before=previous(F.struct(is_use.alias("use"), *[F.col(c).alias(c) for c in carry])),
    )
    hit = F.col("__before.use")
    return own.filter(~is_use).select(
        *[c for c in df.columns if c not in carry],
        *[F.when(hit, F.col(f"__before.{c}")).alias(c) for c in carry],
    )


def latest_meta(df: DataFrame, o: Ordering, last: Sequence[str] = (), first: Sequence[str] = (), ts: str | None = None) -> DataFrame:
    """Last non-null value of some columns, first of others, earliest and latest time."""
    where = o.position
    out = [F.max_by(c, F.when(F.col(c).isNotNull(), where)).alias(c) for c in last]
    out += [F.min_by(c, F.when(F.col(c).isNotNull(), where)).alias(c) for c in first]
    if ts:
        out += [F.min(ts).alias("first_ts"), F.max(ts).alias("latest_ts")]
    return df.groupBy(*o.keys).agg(*out)


def keep_last_turns(df: DataFrame, o: Ordering, turn_no: str, n: int | None = None) -> DataFrame:
    """Keep the last ``n`` turns of a key, all without a number; ``omitted`` says how many came before."""
    if n is None:
        return df.withColumn("omitted", F.lit(0).cast("bigint"))
    seen = scan(df, o, __last=total(F.max, F.col(turn_no)))
    return (
        seen.filter(F.col(turn_no) > F.col("__last") - n)
        .withColumn("omitted", F.greatest(F.lit(0), F.col("__last") - n))
        .drop("__last")
    )


def turn_minutes(df: DataFrame, keys: Sequence[str], turn_no: str, minutes: str, limit: int | None = None) -> DataFrame:
    """Minute of each turn, in order; of the first ``limit`` where given."""
    pairs = F.array_sort(F.collect_list(F.struct(turn_no, minutes)))
    return (
        df.filter(F.lit(True) if limit is None else F.col(turn_no) <= limit)
        .groupBy(*keys)
        .agg(F.transform(pairs, lambda p: p[minutes]).alias("turn_min"))
    )


def actions_between_turns(events: DataFrame, keys: Sequence[str], turn_no: str, tool: str, top: int | None = None) -> DataFrame:
    """Tools after each turn and before the next, most used first (the ``top`` ones where given); ties go to the first used."""
    keys = list(keys)
    counted = (
        events.filter((F.col(turn_no) > 0) & F.col(tool).isNotNull())
        .groupBy(*keys, turn_no, tool)
        .agg(F.count("*").alias("n"), F.min("position").alias("__first"))
    )
    return top_k(counted, [*keys, turn_no], [F.desc("n"), F.asc("__first")], top).drop("__first")
