"""Cohort statistics: pooled rates, shares, medians, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.functions import stats
from turnwise.operators.ordered import count_if
from turnwise.operators.ordering import medians


def pooled_rate(df: DataFrame, by: Sequence[str], events: Column, turns: Column) -> DataFrame:
    """All events of a group over all its turns, with the band that many events implies."""
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(events), F.lit(0)).alias("events"),
        F.coalesce(F.sum(turns), F.lit(0)).alias("turns"),
    )
    return sums.withColumns(stats.rate_columns(F.col("events"), F.col("turns")))


def share(df: DataFrame, by: Sequence[str], pred: Column) -> DataFrame:
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), count_if(pred).alias("hits"))
    return sums.withColumn("pct", stats.share(F.col("hits"), F.col("n")))


def compare(rates: DataFrame, by: Sequence[str], cohort: str, worse: str, better: str) -> DataFrame:
    """Put two cohort rows of ``pooled_rate`` side by side and describe the difference."""
    def at(name: str, field: str) -> Column:
        return F.max(F.when(F.col(cohort) == name, F.col(field)))

    sides = rates.groupBy(*by).agg(
        at(worse, "rate").alias("worse_rate"), at(better, "rate").alias("better_rate"),
        F.coalesce(at(worse, "n"), F.lit(0)).alias("worse_n"), F.coalesce(at(better, "n"), F.lit(0)).alias("better_n"),
    )
    return sides.withColumns(
        stats.compare_columns(F.col("worse_rate"), F.col("better_rate"), F.col("worse_n"), F.col("better_n"))
    )


def global_median(df: DataFrame, value: Column) -> DataFrame:
    """One row, one column: the exact median over everything (usable as a scalar subquery)."""
    one = df.select(F.lit(0).alias("__all"), value.alias("__value"))
    return medians(one, ["__all"], "__value").select("median")


def at_or_above_median(df: DataFrame, value: str) -> DataFrame:
    """Rows at or above the table's own median."""
    return df.filter(F.col(value) >= global_median(df, F.col(value)).scalar())


def top_tools(tool_sizes: DataFrame, k: int | None = None) -> DataFrame:
    """Tools by returned size, with their share of everything returned; the ``k`` largest where given."""
    totals = tool_sizes.groupBy("tool").agg(F.sum("size").alias("size"))
    whole = totals.agg(F.sum("size").alias("s"))
    shared = totals.withColumn("pct", stats.share(F.col("size"), whole.scalar()))
    return shared if k is None else shared.orderBy(F.desc("size"), "tool").limit(k)


def cause_histogram(verdict_turns: DataFrame) -> DataFrame:
    """How often each cause was named."""
    return verdict_turns.filter(F.col("cause").isNotNull()).groupBy("cause").agg(F.count("*").alias("n"))
