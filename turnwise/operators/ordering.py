"""Ordered scans that survive a very long key.

Session signals are running folds in file order.  A plain window over
``partitionBy(session)`` puts a whole session in one task, which fails when one
session (or machine, or user) holds a large part of all rows.  Here every fold
is two-level:

1. rows are windowed inside ``(keys, segment)``, a run of bounded length;
2. each segment is reduced to one summary row (map-side combined), and the
   summaries of a key are scanned to give every segment its starting value;
3. the starting value is joined back on ``(keys, segment)`` and combined.

All folds used here are associative, so the result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_ROWS = 1 << 18
_SEG = "__segment"


@dataclass(frozen=True)
class Ordering:
    """How rows of a key are ordered, and how that order is cut into segments.

    ``segment`` (a SQL expression) must never decrease along ``order``; it
    bounds how many rows of one key a single task windows.  ``None`` means keys
    are known to be small.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    segment: str | None = None

    def keyed(self, *keys: str) -> Ordering:
        """The same order under other keys."""
        return Ordering(keys, self.order, self.segment)

    @property
    def position(self) -> Column:
        """Order columns as one comparable value."""
        return F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)


def by_number(keys: tuple[str, ...], number: str, rows: int = SEGMENT_ROWS) -> Ordering:
    """Order by an integer position, cut every ``rows`` positions."""
    return Ordering(tuple(keys), (number,), f"floor(`{number}` / {rows})")


def by_time(keys: tuple[str, ...], ts: str, tie: str, seconds: int = 60) -> Ordering:
    """Order by a timestamp and a tie-break column, cut every ``seconds``."""
    return Ordering(tuple(keys), (ts, tie), f"floor(unix_seconds(`{ts}`) / {seconds})")


LINES = by_number(("path",), "line_no")


@dataclass(frozen=True)
class Fold:
    """One running value: inside a segment, per segment, and how the two meet."""

    inside: Callable[[Ordering, tuple], Column]
    summary: Callable[[Ordering], Column]
    across: Callable[[Column], Column]
    meet: Callable[[Column, Column], Column]
    whole_key: bool = False


def _frames(o: Ordering, parts: tuple) -> tuple:
    base = Window.partitionBy(*parts).orderBy(*o.order)
    return (
        base.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        base.rowsBetween(Window.unboundedPreceding, -1),
        Window.partitionBy(*parts),
    )


def running_sum(value: Column) -> Fold:
    """Sum of ``value`` up to and including this row; nulls count as zero."""
    return Fold(
        lambda o, f: F.coalesce(F.sum(value).over(f[0]), F.lit(0)),
        lambda o: F.sum(value),
        F.sum,
        lambda here, before: here + F.coalesce(before, F.lit(0)),
    )


def running_max(value: Column) -> Fold:
    return Fold(lambda o, f: F.max(value).over(f[0]), lambda o: F.max(value), F.max, F.greatest)


def running_min(value: Column) -> Fold:
    return Fold(lambda o, f: F.min(value).over(f[0]), lambda o: F.min(value), F.min, F.least)


def _latest(value: Column, frame: int) -> Fold:
    return Fold(
        lambda o, f: F.last(value, ignorenulls=True).over(f[frame]),
        lambda o: F.max_by(value, F.when(value.isNotNull(), o.position)),
        lambda c: F.last(c, ignorenulls=True),
        F.coalesce,
    )


def latest(value: Column) -> Fold:
    """Most recent non-null ``value``, this row included."""
    return _latest(value, 0)


def previous(value: Column) -> Fold:
    """Most recent non-null ``value`` strictly before this row."""
    return _latest(value, 1)


def total(aggregate: Callable[[Column], Column], value: Column) -> Fold:
    """``sum``, ``max`` or ``min`` of ``value`` over the whole key, on every row.

    Only per-segment partial results meet in one place, never the key's rows.
    """
    return Fold(
        lambda o, f: aggregate(value).over(f[2]),
        lambda o: aggregate(value),
        aggregate,
        lambda here, everywhere: F.coalesce(everywhere, here),
        whole_key=True,
    )


def scan(df: DataFrame, o: Ordering, **folds: Fold) -> DataFrame:
    """Add one column per fold.  Key columns must not be null."""
    if o.segment is None:
        frames = _frames(o, tuple(F.col(k) for k in o.keys))
        return df.withColumns({name: f.inside(o, frames) for name, f in folds.items()})

    cut = df.withColumn(_SEG, F.expr(o.segment))
    parts = (*o.keys, _SEG)
    frames = _frames(o, parts)
    inside = cut.withColumns(
        {name: F.lit(None) if f.whole_key else f.inside(o, frames) for name, f in folds.items()}
    )

    everywhere = Window.partitionBy(*o.keys)
    earlier = everywhere.orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*parts).agg(
        *[f.summary(o).alias(f"__sum_{name}") for name, f in folds.items()]
    ).select(
        *parts,
        *[
            f.across(F.col(f"__sum_{name}")).over(everywhere if f.whole_key else earlier).alias(f"__start_{name}")
            for name, f in folds.items()
        ],
    )
    joined = inside.join(starts, list(parts), "left")
    return joined.withColumns(
        {name: f.meet(F.col(name), F.col(f"__start_{name}")) for name, f in folds.items()}
    ).drop(_SEG, *[f"__start_{name}" for name in folds])


def first_by(df: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """One row per key: the earliest.  Combined map-side, so hot keys are safe."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("__row")).select(*keys, "__row.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key, all without a number; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def value_segments(df: DataFrame, value: str, cuts: int) -> DataFrame:
    """Add ``__cut``, the number of approximate quantiles below each value; it never decreases with the value."""
    number = F.col(value).cast("double")
    marks = df.agg(F.percentile_approx(number, [i / cuts for i in range(1, cuts)], 10 * cuts)).scalar()
    return df.withColumn("__marks", marks).withColumn("__cut", F.size(F.filter("__marks", lambda m: m < number))).drop("__marks")


def medians(df: DataFrame, keys: list[str], value: str, out: str = "median", cuts: int = 256) -> DataFrame:
    """Exact median per key (mean of the middle two).

    Distinct values are counted first, then scanned in value order.  Segments
    are cut at approximate quantiles of the counted values, so each holds about
    ``1 / cuts`` of them however they lie, and no task holds a group.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    placed = scan(value_segments(counted, value, cuts), Ordering(tuple(keys), (value,), "__cut"), __upto=running_sum(F.col("__n")), __total=total(F.sum, F.col("__n")))
    lower = F.floor((F.col("__total") + 1) / 2)
    upper = F.floor(F.col("__total") / 2) + 1

    def covers(at: Column) -> Column:
        return (F.col("__upto") >= at) & (F.col("__upto") - F.col("__n") < at)

    middle = placed.filter(covers(lower) | covers(upper))
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias(out))
