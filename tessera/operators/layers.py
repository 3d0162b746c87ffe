"""Layers of a file's analysis: snapshots at a content hash, upgrade candidates, de-duplication before writes, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ["repo_root", "relative_path", "content_hash"]


def upgrade_candidates(files: DataFrame, l4: DataFrame, l5: DataFrame, ready: DataFrame, calls: DataFrame) -> DataFrame:
    """Live files with an L4 row of their hash that lack L5, or whose L5 found relations that callers cannot use yet. A row
    for every L5 row of a file; relations are counted before they are joined."""
    related = calls.groupBy(*FILE).agg(F.count("*").alias("related"))
    t = files.where("not is_deleted").select(*FILE).join(l4.select(*FILE, "confidence"), FILE)
    t = t.join(l5.select(*FILE, F.coalesce(F.expr("try_cast(relations as int)"), F.lit(0)).alias("relations")), FILE, "left")
    t = t.join(ready.select(*FILE, "callers_ready"), FILE, "left").join(related, FILE, "left")
    usable = F.coalesce("callers_ready", F.lit(False)) & (F.coalesce("related", F.lit(0)) > 0)
    return t.where(F.col("relations").isNull() | ((F.col("relations") > 0) & ~usable)).select(*FILE, "confidence")


def snapshot(files: DataFrame, l4: DataFrame, l5: DataFrame) -> DataFrame:
    """Of every live file what is known of its current hash: L4 confidence, and the reasons of its L5 rows in order."""
    reasons = l5.groupBy(*FILE).agg(F.array_join(F.sort_array(F.collect_list("reason_code")), ",").alias("reasons"))
    return files.where("not is_deleted").select(*FILE).join(l4.select(*FILE, "confidence"), FILE, "left").join(reasons, FILE, "left")


def drop_stale(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a live file's current hash."""
    return rows.join(files.where("not is_deleted").select(*FILE), FILE, "left_semi")


def first_of_each(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row of each key in order. One aggregation, combined before the shuffle; no window over a hot key."""
    names = [f"key_{i}" for i in range(len(keys))]
    found = rows.groupBy(*(k.alias(n) for k, n in zip(keys, names, strict=True))).agg(F.min_by(F.struct(*rows.columns), order).alias("x"))
    return found.select("x.*")


def effective_cost(cost: Column, multiplier: Column, weight: Column) -> Column:
    """At least 1; multiplier and weight count from 0.1 to 10; halves go to the even."""
    clamp = lambda x: F.greatest(F.lit(0.1), F.least(F.lit(10.0), x))
    return F.greatest(F.lit(1), F.bround(F.greatest(F.lit(1.0), cost) * clamp(multiplier) * clamp(weight))).cast("bigint")


def admission(requests: DataFrame, total_most: float, batch_most: float, reserve: float = 0.1) -> DataFrame:
    """The first check that refuses a request, or null. requests: reason, enabled, allowed, known, mode, cooling,
    total_rate, batch_rate."""
    r = F.col
    interactive, batch = r("mode") == "interactive", r("mode") == "batch"
    starving = interactive & (r("total_rate") >= 0.95 * total_most) & (r("batch_rate") <= reserve * batch_most)
    verdict = (F.when(r("reason").isNull(), "reason_missing").when(~r("enabled"), "policy_disabled").when(~r("allowed"), "mode_not_allowed").when(batch & ~r("known"), "unknown_batch_index_build_blocked")
               .when(r("cooling"), "cooldown_active").when(starving, "starvation_guard_call_reserve").when(r("total_rate") > total_most, "pressure_rate_exceeded").when(batch & (r("batch_rate") > batch_most), "pressure_rate_exceeded"))
    return requests.withColumn("refused", verdict)


def language_cooldown(refusals: DataFrame, by: str, at: str, seconds: Column) -> DataFrame:
    """Until when each refusal keeps its language waiting: waits add up from the end of the one before, if it lasts still.
    That end is the greatest of (a refusal's time + all waits from it on), so running sums and a running maximum tell it."""
    order = Window.partitionBy(by).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = refusals.withColumn("start", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("wait", seconds * 1_000_000).withColumn("all", F.sum("wait").over(order))
    until = F.max(F.col("start") - F.col("all") + F.col("wait")).over(order) + F.col("all")
    return t.select("event_id", by, until.alias("until"))


def proxy_quality(found: DataFrame, known: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """By file: how many of the known symbols are found (equal name and kind, lines within the tolerance), as recall,
    precision and flags. Names that a file has once on both sides; an empty side counts as 1."""
    key = [*by, "name"]
    f = found.groupBy(*key).agg(F.count("*").alias("f"), F.min("line").alias("fl"), F.min("kind").alias("fk"))
    k = known.groupBy(*key).agg(F.count("*").alias("k"), F.min("line").alias("kl"), F.min("kind").alias("kk"))
    t = f.join(k, key, "full").withColumns({"both": F.least(F.coalesce("f", F.lit(0)), F.coalesce("k", F.lit(0))), "gap": F.abs(F.col("fl") - F.col("kl"))})
    t = t.groupBy(*by).agg(F.sum(F.coalesce("f", F.lit(0))).alias("found"), F.sum(F.coalesce("k", F.lit(0))).alias("known"), F.sum("both").alias("matched"),
                           F.sum(F.when(F.col("fk") == F.col("kk"), F.col("both")).otherwise(0)).alias("kinds"), F.sum(F.when(F.col("gap") <= tolerance, F.col("both")).otherwise(0)).alias("places"))
    rate = lambda part, of: F.round(F.coalesce(F.try_divide(F.col(part), F.col(of)), F.lit(1.0)), 6)
    flags = F.concat_ws(",", F.when(F.col("known") > F.col("found"), "ast_missing_symbols"), F.when(F.col("found") > F.col("known"), "ast_extra_symbols"), F.when((F.col("matched") > 0) & (F.col("kinds") < F.col("matched")), "kind_mismatch_present"),
                        F.when((F.col("matched") > 0) & (F.col("places") < F.col("matched")), "position_mismatch_present"), F.when((F.col("known") > 0) & (F.col("matched") == 0), "no_proxy_matches"))
    return t.select(*by, "found", "known", rate("matched", "known").alias("recall"), rate("matched", "found").alias("precision"), rate("kinds", "matched").alias("kind_rate"), rate("places", "matched").alias("place_rate"), flags.alias("flags"))
