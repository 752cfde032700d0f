"""Robust statistics over groups of rows: medians, spreads, percentiles by time, interval unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col


def population_sd(c: Column | str) -> Column:
    """Aggregate: population standard deviation, 0 for fewer than two values."""
    c = col(c)
    return F.when(F.count(c) < 2, F.lit(0.0)).otherwise(F.stddev_pop(c))


def median(c: Column | str) -> Column:
    """Aggregate: exact median, the midpoint of the middle two."""
    return F.percentile(col(c), F.lit(0.5))


def percentile(c: Column | str, p: float) -> Column:
    """Aggregate: exact percentile, linear between the neighbours of (n - 1) p."""
    return F.percentile(col(c), F.lit(p))


def median_and_mad(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """median_value and mad_value (median absolute deviation) for each group, and further aggregates. One shuffle by the keys."""
    centre = F.percentile(F.col(value), F.lit(0.5)).over(Window.partitionBy(*keys))
    return df.withColumn("group_median", centre).groupBy(*keys).agg(
        F.first("group_median", ignorenulls=True).alias("median_value"), median(F.abs(F.col(value) - F.col("group_median"))).alias("mad_value"), *more
    )


def steps(df: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """With step_before and step_after: the distances to the neighbours' times, null at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("step_before", F.col(at) - F.lag(at).over(w)).withColumn("step_after", F.lead(at).over(w) - F.col(at))


def nominal_step(step: str, longest: float, default: float) -> Column:
    """Aggregate (or window): the median of the positive steps up to `longest`, else the default."""
    s = F.col(step)
    return F.coalesce(median(F.when((s > 0) & (s <= longest), s)), F.lit(default))


def frame_weights(df: DataFrame, keys: list[str], order: list[str], at: str, longest: float, default: float) -> DataFrame:
    """With nominal_ms and weight_ms: the time to the next row, within 0 and `longest`; the nominal step for the last."""
    own = Window.partitionBy(*keys)
    stepped = steps(df, keys, order, at).withColumn(
        "nominal_ms",
        F.coalesce(F.percentile(F.when((F.col("step_before") > 0) & (F.col("step_before") <= longest), F.col("step_before")), F.lit(0.5)).over(own), F.lit(default))
    )
    return stepped.withColumn("weight_ms", F.when(F.col("step_after").isNull(), F.col("nominal_ms")).otherwise(F.least(F.lit(longest), F.greatest(F.lit(0.0), F.col("step_after").cast("double")))))


def timed_percentile(df: DataFrame, keys: list[str], value: str, weight: str, p: float, tie: list[str], name: str = "timed_percentile") -> DataFrame:
    """For each group the value at which the running weight, by ascending value, first reaches p of the whole; the plain percentile where the whole is not positive."""
    ordered = Window.partitionBy(*keys).orderBy(value, *tie).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.filter(F.col(value).isNotNull()).withColumn("running", F.sum(weight).over(ordered)).withColumn("whole", F.sum(weight).over(Window.partitionBy(*keys)))
    reached = F.min(F.when(F.col("running") >= F.lit(p) * F.col("whole"), F.col(value)))
    return summed.groupBy(*keys).agg(F.when(F.max("whole") > 0, reached).otherwise(percentile(value, p)).alias(name))


def interval_union(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """union_length, islands (separate stretches), cover_start and cover_end of each group's intervals; touching intervals join."""
    earlier = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col(start) > F.max(end).over(earlier), F.lit(True))
    numbered = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(upto))
    islands = numbered.groupBy(*keys, "island").agg(F.min(start).alias("low"), F.max(end).alias("high"))
    return islands.groupBy(*keys).agg(F.sum(F.col("high") - F.col("low")).alias("union_length"), F.count("*").alias("islands"), F.min("low").alias("cover_start"), F.max("high").alias("cover_end"))
