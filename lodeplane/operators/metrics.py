"""Monitoring queries over counters and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increases(samples: DataFrame, *labels: str) -> DataFrame:
    """Adds inc, the step of a counter since the sample before; a reset starts at its new value."""
    before = F.lag("value").over(Window.partitionBy(*labels).orderBy("us"))
    return samples.withColumn("inc", F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value")))


def windowed(samples: DataFrame, width_us: int) -> DataFrame:
    return samples.withColumn("win", F.floor(F.col("us") / width_us))


def ratio(bad: Column, value: str) -> Column:
    return F.sum(F.when(bad, F.col(value)).otherwise(0)) / F.when(F.sum(value) > 0, F.sum(value))


def histogram_quantile(buckets: DataFrame, q: float, *labels: str) -> DataFrame:
    """Linear interpolation in the first cumulative bucket (le, n) that reaches the rank."""
    w = Window.partitionBy(*labels)
    order = w.orderBy("le")
    total = F.max("n").over(w)
    out = buckets.withColumns({"total": total, "low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "below": F.coalesce(F.lag("n").over(order), F.lit(0))})
    rank = F.lit(q) * F.col("total")
    hit = out.where((F.col("n") >= rank) & (F.col("below") < rank))
    return hit.select(*labels, (F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / (F.col("n") - F.col("below"))).alias("quantile"))


def unless_before(samples: DataFrame, offset: int, *labels: str) -> DataFrame:
    """Windows with a sample whose labels had none `offset` windows before."""
    earlier = samples.select(*labels, (F.col("win") + offset).alias("win")).distinct()
    return samples.select(*labels, "win").distinct().join(earlier, [*labels, "win"], "left_anti")


def runs(rows: DataFrame, on: Column, order: str, *labels: str) -> DataFrame:
    """Adds run_id, and n, the length so far of the run of rows on which the condition holds."""
    w = Window.partitionBy(*labels).orderBy(order)
    marked = rows.withColumn("on", on).withColumn("run_id", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w))
    return marked.withColumn("n", F.when(F.col("on"), F.sum(F.when(F.col("on"), 1).otherwise(0)).over(Window.partitionBy(*labels, "run_id").orderBy(order))).otherwise(0))
