"""Exact percentiles by group that no group's size breaks: ranks are found by counts, first of bins, then of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.running import same

#: Bins for each doubling of a value; a bin's values differ by 0.3 % at most.
BINS = 256


def value_bin(v: Column) -> Column:
    """A whole number that never falls as v (double) grows: by logarithm on both sides of 0; NaN is greater than all."""
    size = F.floor(F.greatest(F.lit(-1100.0), F.least(F.lit(1100.0), F.log2(F.abs(v)))) * BINS).cast("bigint") + 1101 * BINS
    return F.when(F.isnan(v), 3000 * BINS).when(v == 0, 0).otherwise(F.when(v > 0, size).otherwise(-size)).cast("bigint")


def exact_percentiles(df: DataFrame, by: list[str], value: Column, fractions: dict[str, float], discrete: bool = False) -> DataFrame:
    """by and a column a fraction: the percentile of the value in the group, as a double. discrete: the smallest value with at
    least that share of the rows at or below it; else interpolated between neighbours. Null values do not count; a group
    without others has no row (no groups at all: an empty table). Null is a group.

    Rows are counted by bin (combined before the shuffle); running sums over a group's bins, some thousands at most, tell in
    which bins the wanted ranks lie. Only the rows of these bins are counted by value, a task a bin, so a group that holds
    most rows is spread and equal values are one row. Reads df twice.
    """
    t = df.select(*by, value.cast("double").alias("__v")).where("__v is not null")
    t = t.withColumn("__bin", value_bin(F.col("__v")))
    bins = t.groupBy(*by, "__bin").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by)
    bins = bins.withColumns({"__total": F.sum("__n").over(group), "__end": F.sum("__n").over(group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))})
    if discrete:
        # the share is compared as DOUBLEs are elsewhere: rank n is enough if n >= fraction * total
        low = high = lambda p: F.greatest(F.lit(1), F.ceil(F.col("__total") * F.lit(p))).cast("bigint")
    else:
        low = lambda p: (F.floor((F.col("__total") - 1) * F.lit(p)) + 1).cast("bigint")
        high = lambda p: (F.ceil((F.col("__total") - 1) * F.lit(p)) + 1).cast("bigint")
    ranks = F.array_distinct(F.array(*(f(p) for p in fractions.values() for f in (low, high))))
    begin = F.col("__end") - F.col("__n")
    aims = bins.withColumn("__ranks", F.filter(ranks, lambda r: (r > begin) & (r <= F.col("__end")))).where(F.size("__ranks") > 0)
    aims = aims.select(*(F.col(x).alias(f"__k_{x}") for x in (*by, "__bin")), begin.alias("__begin"), "__total", "__ranks")
    near = t.join(aims, same([*by, "__bin"], "__k_")).groupBy(*by, "__bin", "__v").agg(F.count("*").alias("__n"), *(F.first(x).alias(x) for x in ("__begin", "__total", "__ranks")))
    end = F.sum("__n").over(Window.partitionBy(*by, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__begin")
    near = near.withColumn("__end", end)
    near = near.select(*by, "__total", "__v", F.explode(F.filter("__ranks", lambda r: (r > F.col("__end") - F.col("__n")) & (r <= F.col("__end")))).alias("__rank"))
    found = near.groupBy(*by, "__total").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))

    def between(p: float) -> Column:
        position = (F.col("__total") - 1) * F.lit(p) + 1
        a, b = (F.col("__at")[f(p)] for f in (low, high))
        return a if discrete else F.when(low(p) == high(p), a).otherwise((high(p) - position) * a + (position - low(p)) * b)

    return found.select(*by, *(between(p).alias(name) for name, p in fractions.items()))
