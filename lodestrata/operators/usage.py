"""What calls of models cost: usage rows against a table of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER = 1_000_000
SCALES = (1_000_000, 10_000_000)


def costed(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens, reasoning_tokens) with cost; models without a price cost nothing. prices: model, input, output ($ for PER tokens)."""
    known = prices.select("model", F.col("input").alias("_in"), F.col("output").alias("_out"))
    joined = usage.join(known, "model", "left")
    tokens = lambda c: F.coalesce(c, F.lit(0))
    cost = (tokens("input_tokens") * F.coalesce("_in", F.lit(0.0)) + (tokens("output_tokens") + tokens("reasoning_tokens")) * F.coalesce("_out", F.lit(0.0))) / PER
    return joined.withColumn("cost", cost).drop("_in", "_out")


def totals(costs: DataFrame) -> DataFrame:
    """model, calls, tokens, cost, cost of a call, and that times the scales."""
    grouped = costs.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.avg("cost").alias("per_call"),
    )
    return grouped.select("*", *((F.col("per_call") * n).alias(f"at_{n // 1_000_000}m") for n in SCALES))
