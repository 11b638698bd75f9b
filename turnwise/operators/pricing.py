"""Price lookup and session cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def attach_price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Join the price whose id is the model, or the longest listed prefix of it.

    Distinct models are few; each is expanded into its prefixes, so the lookup
    is an equi-join at any size of the price list, and usage joins on model.
    """
    models = usage.select("model").filter("model != ''").distinct()
    prefixes = models.select(
        "model",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("model")), lambda n: F.substring("model", F.lit(1), n))).alias("price_id"),
    )
    rest = [c for c in prices.columns if c != "price_id"]
    best = (
        prefixes.join(prices, "price_id")
        .groupBy("model")
        .agg(F.max_by(F.struct("price_id", *rest), F.length("price_id")).alias("p"))
        .select("model", "p.*")
    )
    return usage.join(best, "model", "left")


def call_cost(c: dict[str, Column] | None = None) -> Column:
    """List price in dollars of one priced usage row."""
    c = c or {}

    def at(name: str) -> Column:
        return c.get(name, F.col(name))

    read = F.coalesce(at("own_cache_read"), at("cache_read") * at("p_in"))
    tokens = (
        at("in") * at("p_in")
        + at("cc5") * at("p_in") * at("cache_write_5m")
        + at("cc1h") * at("p_in") * at("cache_write_1h")
        + at("cr") * read
        + at("out") * at("p_out")
    )
    fast = F.when(at("calls") > 0, 1 + (at("fast_multiplier") - 1) * at("fast_calls") / at("calls")).otherwise(1.0)
    return tokens / 1e6 * fast


def session_cost(usage: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dollars per key, and how many calls had no listed price."""
    priced = attach_price(usage, prices)
    known = F.col("price_id").isNotNull()
    return priced.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(known, call_cost())), F.lit(0.0)).alias("usd"),
        F.coalesce(F.sum(F.when(~known, F.col("calls"))), F.lit(0)).alias("unpriced"),
    )


def token_panel(usage: DataFrame) -> DataFrame:
    """Totals per model, most tokens first."""
    cached = F.sum(F.col("cc5") + F.col("cc1h"))
    return (
        usage.groupBy("model")
        .agg(
            F.sum("calls").alias("calls"), F.sum("in").alias("in"), cached.alias("cc"), F.sum("cr").alias("cr"),
            F.sum("out").alias("out"), F.sum("think").alias("think"),
        )
        .withColumn("total", F.col("in") + F.col("cc") + F.col("cr") + F.col("out"))
        .orderBy(F.desc("total"), "model")
    )


def token_shares(usage: DataFrame) -> DataFrame:
    """Thinking as a share of output; cache writes as a share of cached input."""
    cc = F.coalesce(F.sum(F.col("cc5") + F.col("cc1h")), F.lit(0))
    cr, out, think = (F.coalesce(F.sum(c), F.lit(0)) for c in ("cr", "out", "think"))
    return usage.agg(
        (think / F.greatest(F.lit(1), out) * 100).alias("thinking_pct"),
        (cc / F.greatest(F.lit(1), cc + cr) * 100).alias("cache_write_pct"),
    )


