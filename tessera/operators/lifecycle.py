"""The life of queue jobs and snapshots: enqueueing, back-off, deferral, recovery, health, admission, hysteresis."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C


def lane(reason: Column) -> Column:
    return F.when(F.coalesce(F.startswith(reason, F.lit("l5:")), F.lit(False)), "l5").otherwise("default")


def enqueue_many(queue: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests (keys, priority, content_hash, seq) are one a key, with the greatest priority and the last hash. The
    newest open job of the key takes them, or a new job does. Both sides are combined before they are shuffled."""
    wanted = requests.groupBy(*keys).agg(F.max("priority").alias("asked"), F.max_by("content_hash", "seq").alias("content_hash"))
    newest = queue.where("status in ('PENDING', 'FAILED')").groupBy(*keys).agg(F.max_by(F.struct("job_id", "priority"), F.struct("created_at", "job_id")).alias("job"))
    return wanted.join(newest, keys, "left").select(
        *keys, F.col("job.job_id").alias("job_id"), "content_hash", F.greatest("asked", "job.priority").alias("priority"), F.when(F.col("job").isNull(), "insert").otherwise("merge").alias("change"))


def fail_with_backoff(jobs: DataFrame, base_seconds: int, most: int) -> DataFrame:
    """One more attempt for each job (attempts, failed_at): DEAD at `most` attempts, else a wait that doubles."""
    t = jobs.withColumn("attempts", (F.col("attempts") + 1).cast("bigint"))
    wait = F.when(F.col("attempts") < most, (F.lit(base_seconds) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("bigint"))
    return t.withColumns({"status": F.when(F.col("attempts") >= most, "DEAD").otherwise("FAILED"), "wait_seconds": wait})


def defer(jobs: DataFrame, now: Column, ttl_hours: int, most_per_root: int) -> DataFrame:
    """job_id and state of deferred jobs: DROP_TTL if too old, DROP_CAP beyond the root's oldest `most_per_root`, else
    by defer_count. Only the jobs below the cap are ranked: the limit is applied before the shuffle."""
    fresh = F.timestamp_diff("HOUR", F.col("created_at"), now) <= ttl_hours
    w = Window.partitionBy("repo_root").orderBy("created_at", "job_id")
    below = jobs.where(fresh).select("job_id", "repo_root", "created_at").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_per_root).select("job_id", F.lit(True).alias("below"))
    state = F.when(~fresh, "DROP_TTL").when(F.col("below").isNull(), "DROP_CAP").when(F.col("defer_count") == 0, "NEW").when(F.col("defer_count") <= 2, "RETRY_WAIT").otherwise("BUMPED")
    return jobs.join(below, "job_id", "left").select("job_id", "repo_root", state.alias("state"))


def eligible_counts(jobs: DataFrame, ready: DataFrame, key: str, now: Column, permanent: list[str]) -> DataFrame:
    """Available, running, done (where ready) and failed jobs, without those that failed for good."""
    t = jobs.where(~F.coalesce(F.col("error_code").isin(permanent), F.lit(False))).join(ready.select(key).distinct().withColumn("ok", F.lit(True)), key, "left")
    s = F.col("status")
    t = t.agg(F.count_if((s == "PENDING") & (F.col("created_at") <= now)).alias("available"), F.count_if(s == "RUNNING").alias("running"), F.count_if((s == "DONE") & F.col("ok")).alias("done"), F.count_if(s == "FAILED").alias("failed"))
    return t.withColumn("total", F.col("available") + F.col("running") + F.col("done") + F.col("failed"))


def failure_streaks(events: DataFrame, by: str, order: str, failed: Column, degraded: int = 3) -> DataFrame:
    """The run of failures that each key ends in, and its state. No window: the last success is an aggregate."""
    last = events.groupBy(by).agg(F.max(F.when(~failed, F.col(order))).alias("last_ok"))
    t = events.where(failed).select(by, order).join(last, by, "right").groupBy(by).agg(F.count_if(F.col(order).isNotNull() & (F.col("last_ok").isNull() | (F.col(order) > F.col("last_ok")))).alias("streak"))
    return t.withColumn("state", F.when(F.col("streak") >= degraded, "DEGRADED").otherwise("ACTIVE"))


def fenced(old: DataFrame, new: DataFrame, key: str, generation: str) -> DataFrame:
    """A new row replaces an old one only with a greater generation."""
    both = old.select(key, F.struct(*old.columns).alias("old")).join(new.select(key, F.struct(*new.columns).alias("new")), key, "full")
    wins = F.col("old").isNull() | F.coalesce(F.col(f"new.{generation}") > F.col(f"old.{generation}"), F.lit(False))
    return both.select(F.when(wins, F.col("new")).otherwise(F.col("old")).alias("x")).select("x.*")


def hysteresis(samples: DataFrame, order: list[str], by: str, value: Column, enter: float, leave: float) -> DataFrame:
    """on: from a value of `enter` or more until one below `leave`. The last crossing decides, so a window suffices."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    crossing = F.when(value >= enter, True).when(value < leave, False)
    return samples.withColumn("on", F.coalesce(F.last(crossing, ignorenulls=True).over(w), F.lit(False)))


def token_bucket(events: DataFrame, by: str, key: str, second_per_token: int, most: int) -> DataFrame:
    """Admits an event if its key's bucket holds a token; buckets begin full and refill steadily. Rows come sorted by key
    and time, and one bucket is held at a time: memory is bounded however many events a key has. Amounts are whole
    microseconds, so results are exact. Decisions of one key depend on each other in turn."""
    cost, full = second_per_token * 1_000_000, most * second_per_token * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, level, last = None, 0, 0
        for batch in batches:
            admitted = []
            for k, at in zip(batch[by], batch["at"], strict=True):
                if k != now:
                    now, level, last = k, full, at
                level, last = min(full, level + at - last), at
                admitted.append(level >= cost)
                level -= cost * admitted[-1]
            yield pd.DataFrame({key: batch[key], by: batch[by], "admitted": admitted})

    t = events.select(key, by, F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).repartition(by).sortWithinPartitions(by, "at", key)
    return t.mapInPandas(run, f"{key} bigint, {by} bigint, admitted boolean")


def pipeline_metrics(jobs: DataFrame) -> DataFrame:
    """Depth, remaining jobs, progress and the range of the eight largest throughputs (jobs an hour)."""
    counts = jobs.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PENDING").alias("depth"), F.count_if(~F.col("status").isin("DONE", "DEAD")).alias("remaining"))
    hours = jobs.where("status = 'DONE'").groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("rate"))
    best = hours.orderBy(F.desc("rate")).limit(8).agg(F.min("rate").alias("low"), F.max("rate").alias("high"))
    # two tables of one row
    t = counts.crossJoin(F.broadcast(best))
    eta = lambda r: F.ceil(F.col("remaining") * 3600 / F.col(r)).cast("bigint")
    return t.select("depth", "remaining", F.round(100.0 * (F.col("n") - F.col("remaining")) / F.greatest("n", F.lit(1)), 6).alias("progress"), eta("high").alias("eta_low"), eta("low").alias("eta_high"))


def backfill_keys(edges: DataFrame, symbols: DataFrame, name: str, key: str, by: list[str]) -> DataFrame:
    """Edges without a key get that of their name where the name has one key only in its file."""
    one = symbols.groupBy(*by, name).agg(F.min(key).alias("__low"), F.max(key).alias("__high")).where("__low = __high").select(*by, name, F.col("__low").alias("__key"))
    return edges.join(one, [*by, name], "left").withColumn(key, F.coalesce(key, "__key")).drop("__key")


def replace_file_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a file that has new ones are replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def embed(text: Column, dim: int = 128) -> Column:
    """Hashed words (first 32 bits of SHA-256, modulo dim), counted and scaled to length one, as an array of doubles."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9_]+"), F.lit(0))
    cells = F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("bigint") % dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # counts are bound once: an inlined array would be counted anew for every cell
    return F.transform(F.array(counts), lambda v: F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm(v)), F.lit(0.0))))[0]


def bundle(items: DataFrame, by: str, order: str, key: str, most: int = 128) -> DataFrame:
    """By session the last `most` items in order of their first use and the digest of their keys, joined by commas. Older
    items leave first; only ranked items below the bound are collected."""
    first = items.groupBy(by, key).agg(F.min(order).alias("at"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("at"), F.desc(key)))).where(F.col("n") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", key))), lambda x: x[key])
    return kept.groupBy(by).agg(F.count("*").alias("items"), F.sha2(F.array_join(listed, ","), 256).alias("bundle_id"))


def escalate_scope(failed: DataFrame, now: Column, min_defer: int = 0, most_attempts: int = 2) -> DataFrame:
    """failed (job_id, repo_root, relative_path, scope_level, scope_attempts, message) whose error a wider scope may mend, as their rows stand
    afterwards: pending again at the next scope, with one more attempt, no reason to wait and a retry not before min_defer
    seconds from now. Jobs with most_attempts attempts, at the widest scope or with another error have no row. A repo scope begins at the file's first
    folder, a workspace scope (or a file without a folder) at the repository's root."""
    level = C.wider_scope(F.col("scope_level"))
    due = C.widens_scope(C.error_code(F.col("message")), F.col("message")) & (F.greatest(F.coalesce("scope_attempts", F.lit(0)), F.lit(0)) < most_attempts) & level.isNotNull()
    first = F.regexp_extract("relative_path", r"^([^/]+)/+[^/]", 1)
    root = F.when((level == "repo") & ~first.isin("", ".", ".."), F.concat_ws("/", "repo_root", first)).otherwise(F.col("repo_root"))
    return failed.where(due).select("job_id", F.lit("PENDING").alias("status"), level.alias("scope_level"), root.alias("scope_root"), (F.coalesce("scope_attempts", F.lit(0)) + 1).cast("int").alias("scope_attempts"),
                                    (now + F.make_interval(secs=F.lit(min_defer))).alias("next_retry_at"), F.lit(None).cast("string").alias("defer_reason"))
