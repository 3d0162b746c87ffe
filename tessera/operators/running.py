"""Running sums and trailing counts of a key whose rows are more than a task should sort: the time line is cut."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(columns: list[str], prefix: str) -> Column:
    """Columns equal those with the prefix; null equals null."""
    return reduce(operator.and_, (F.col(x).eqNullSafe(F.col(prefix + x)) for x in columns), F.lit(True))


def running_sum(df: DataFrame, by: list[str], at: str, value: str, name: str, width: int) -> DataFrame:
    """A row a key and whole number `at`: by, at, and the sum of the value over the key's rows up to it, as `name`. Rows of one
    `at` are added before the shuffle. A key's line is cut into pieces of `width`; pieces are summed by themselves, and what
    comes before each is a running sum of the pieces' totals, of which a key has as many as its span has widths."""
    t = df.groupBy(*by, at).agg(F.sum(value).alias("__n")).withColumn("__piece", F.floor(F.col(at) / width))
    totals = t.groupBy(*by, "__piece").agg(F.sum("__n").alias("__all"))
    before = F.sum("__all").over(Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__all")
    totals = totals.select(*(F.col(x).alias(f"__k_{x}") for x in by), F.col("__piece").alias("__k___piece"), before.alias("__before"))
    inside = F.sum("__n").over(Window.partitionBy(*by, "__piece").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    t = t.select(*by, at, "__piece", inside.alias("__inside"))
    return t.join(totals, same([*by, "__piece"], "__k_")).select(*by, at, (F.col("__inside") + F.col("__before")).alias(name))


def trailing_count(events: DataFrame, by: list[str], time: str, seconds: int, name: str) -> DataFrame:
    """events with the number of the key's events of the `seconds` whole seconds up to each and of its own second, as `name`. A
    running sum in which every event leaves again when it is too old: the work does not grow with the window. Null is a key;
    events without a time count those without one, as a window would."""
    t = events.withColumn("__second", F.unix_seconds(F.col(time).cast("timestamp")))
    counts = t.groupBy(*by, "__second").agg(F.count("*").alias("__c"))
    steps = counts.select(*by, F.explode(F.array(F.struct(F.col("__second").alias("at"), F.col("__c").alias("c")), F.struct((F.col("__second") + seconds + 1).alias("at"), (-F.col("__c")).alias("c")))).alias("x"))
    sums = running_sum(steps.where("x.at is not null").select(*by, F.col("x.at").alias("__second"), F.col("x.c").alias("__c")), by, "__second", "__c", name, 4 * seconds)
    untimed = counts.where("__second is null").select(*by, "__second", F.col("__c").alias(name))
    found = sums.unionByName(untimed).select(*(F.col(x).alias(f"__k_{x}") for x in (*by, "__second")), name)
    return t.join(found, same([*by, "__second"], "__k_")).select(*events.columns, name)
