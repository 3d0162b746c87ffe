"""Caches as logs: what was put and when it became invalid; a lookup finds the last entry that still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Variants of an entry, the first for any other name too, whose entries may lie under the bare query; and how a key is written.
VARIANTS = ("list", "detail")
KEY = "\n__cache_variant:"


def _variant(name: Column) -> Column:
    clean = F.lower(F.trim(name))
    return F.when(clean.isin(*VARIANTS), clean).otherwise(VARIANTS[0])


def cache_key(query: Column, variant: Column) -> Column:
    return F.concat(query, F.lit(KEY), _variant(variant))


def live_entries(puts: DataFrame, invalidations: DataFrame, by: list[str]) -> DataFrame:
    """The last put of each key (by, key, content_hash, items, at) that no later invalidation covers: one of a file names it in `by`, one of
    everything has nulls there. Invalidations at the very time of a put come after it. All of everything are one time, which is known before the join; the
    others are one row a file."""
    last = puts.groupBy(*by, "key").agg(F.max_by(F.struct("content_hash", "items", "at"), "at").alias("x")).select(*by, "key", "x.*")
    whole = invalidations.where(F.col(by[0]).isNull()).agg(F.max("at").alias("all_at"))  # one row
    files = invalidations.where(F.col(by[0]).isNotNull()).groupBy(*by).agg(F.max("at").alias("file_at"))
    t = last.join(files, by, "left").where("file_at is null or file_at < at").join(F.broadcast(whole), F.expr("all_at is null or all_at < at"))
    return t.select(*by, "key", "content_hash", "items", "at")


def cached_items(asked: DataFrame, puts: DataFrame, invalidations: DataFrame, by: list[str]) -> DataFrame:
    """asked (by, query, variant, content_hash) with items and hit: variant, legacy (the bare query, only for the first variant) or null. Entries of
    another content are no hits."""
    entries = live_entries(puts, invalidations, by).select(*by, "key", "content_hash", F.col("items").alias("found"))
    t = asked.withColumn("key", cache_key(F.col("query"), F.col("variant")))
    own = t.join(entries.withColumnRenamed("found", "own"), [*by, "key", "content_hash"], "left").drop("key")
    old = entries.select(*by, F.col("key").alias("query"), "content_hash", F.col("found").alias("old"))
    both = own.join(old, [*by, "query", "content_hash"], "left")
    legacy = F.col("own").isNull() & (_variant(F.col("variant")) == VARIANTS[0]) & F.col("old").isNotNull()
    return both.select(*asked.columns, F.when(legacy, F.col("old")).otherwise(F.col("own")).alias("items"), F.when(F.col("own").isNotNull(), "variant").when(legacy, "legacy").alias("hit"))


def cached_counts(asked: DataFrame, puts: DataFrame, by: list[str]) -> DataFrame:
    """asked (by, epoch) with the count that was put last for the key, if that was in the same epoch; else null: a count of another epoch is stale."""
    last = puts.groupBy(*by).agg(F.max_by(F.struct("epoch", "n"), "at").alias("x")).select(*by, F.col("x.epoch").alias("put_epoch"), F.col("x.n").alias("n"))
    return asked.join(last, by, "left").select(*asked.columns, F.when(F.col("put_epoch") == F.col("epoch"), F.col("n")).alias("n"))
