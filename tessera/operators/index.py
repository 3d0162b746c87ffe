"""Files, symbols, call edges and the work queue: lookups, joins, dedupe, counts and operational statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.percentiles import exact_percentiles
from tessera.operators.running import same


def substring_scan(files: DataFrame, query: str, limit: int) -> DataFrame:
    hits = files.where(~F.col("is_deleted") & C.contains_ci(F.col("text"), query))
    return hits.orderBy("doc_id").limit(limit).select("doc_id", "relative_path", C.occurrences_ci(F.col("text"), query).alias("score"))


def list_files(files: DataFrame, root: str, limit: int, prefix: str | None = None, by: str = "repo_root") -> DataFrame:
    own = files.where((F.col(by) == root) & ~F.col("is_deleted"))
    if prefix:
        own = own.where(F.startswith(F.lower("relative_path"), F.lit(prefix.lower())))
    return own.orderBy("relative_path", "repo_root").limit(limit).select("repo_root", "relative_path", "size_bytes", "content_hash", "enrich_state")


def newest_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def state_counts(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_deleted")).groupBy("enrich_state").agg(F.count("*").alias("n"))


def repo_stats(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_deleted")).groupBy("repo_root").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def status_counts(queue: DataFrame, states: tuple[str, ...] = ("PENDING", "RUNNING", "FAILED", "DONE", "DEAD")) -> DataFrame:
    """A row for each state, zero if no job has it."""
    all_states = queue.sparkSession.createDataFrame([(s,) for s in states], "status string")
    return all_states.join(queue.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def pending_split(queue: DataFrame, now: Column) -> DataFrame:
    q, deferred = queue.where("status = 'PENDING'"), F.col("created_at") > now
    return q.agg(F.count_if(~deferred).alias("available"), F.count_if(deferred).alias("deferred"), F.count_if(F.coalesce(F.startswith("defer_reason", F.lit("l5:heavy")), F.lit(False))).alias("heavy"), F.count_if(F.col("defer_reason").isNull()).alias("fast"))


def pending_ages(queue: DataFrame, now: Column) -> DataFrame:
    age = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("created_at"), now))
    t = queue.where("status = 'PENDING'").select(age.alias("age"))
    p95 = exact_percentiles(t, [], F.col("age"), {"p95": 0.95}, discrete=True).agg(F.max("p95").cast("bigint").alias("p95_age"))
    # two tables of one row
    return t.agg(F.max("age").alias("max_age"), F.count("*").alias("n")).crossJoin(F.broadcast(p95))


def top_counts(df: DataFrame, key: Column, limit: int) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(limit)


def acquire(queue: DataFrame, limit: int) -> DataFrame:
    """The next pending jobs by priority, then age."""
    return queue.where("status = 'PENDING'").orderBy(F.desc("priority"), "created_at", "job_id").limit(limit).select("job_id", "repo_root", "priority", F.lit("RUNNING").alias("status"))


def alert_window(jobs: DataFrame, since: Column) -> DataFrame:
    t = jobs.where(F.col("ts") >= since)
    p95 = exact_percentiles(t, [], F.col("latency_ms"), {"p95": 0.95}, discrete=True).agg(F.max("p95").alias("p95"))
    # two tables of one row
    w = t.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "DEAD").alias("dead")).crossJoin(F.broadcast(p95))
    w = w.withColumn("dead_bps", C.basis_points(F.col("dead"), F.col("n")))
    return w.withColumn("state", F.when(F.col("dead_bps") > 1500, "critical").when(F.col("dead_bps") > 500, "warn").otherwise("ok"))


def trace_summary(jobs: DataFrame, by: list[str]) -> DataFrame:
    t = jobs.groupBy(*by).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total"), F.avg("latency_ms").alias("mean"), F.max("latency_ms").alias("longest"))
    p = exact_percentiles(jobs, by, F.col("latency_ms"), {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    p = p.select(*(F.col(x).alias(f"__{x}") for x in by), "p50", "p95", "p99")
    t = t.join(p, same(by, "__"), "left")
    return t.select(*by, "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"), "longest", *(F.round(x, 6).alias(x) for x in ("p50", "p95", "p99")))


def callers(edges: DataFrame, symbol: str, limit: int) -> DataFrame:
    path = F.coalesce("caller_relative_path", "relative_path")
    return edges.where(F.col("to_symbol") == symbol).withColumn("path", path).orderBy("path", "line", "from_symbol").limit(limit).select("from_symbol", "to_symbol", "path", "line")


def callees(edges: DataFrame, symbol: str, limit: int) -> DataFrame:
    return edges.where(F.col("from_symbol") == symbol).orderBy("to_symbol", "line").limit(limit).select("from_symbol", "to_symbol", "relative_path", "line")


def suffix_callers(edges: DataFrame, suffix: str, limit: int) -> DataFrame:
    """Callers of the symbol or, if it has none by its exact name, of symbols that end in it behind a separator. As in a
    LIKE pattern, _ and % of the name stand for any text there; short or qualified names match by the exact name alone."""
    path = F.coalesce("caller_relative_path", "relative_path")
    exact = edges.where(F.col("to_symbol") == suffix)
    found = exact
    if len(suffix) >= 3 and not any(x in suffix for x in (".", "::", "#")):
        none = exact.agg((F.count("*") == 0).alias("none"))  # one row
        ends = [F.col("to_symbol").ilike(f"%{x}{suffix}") for x in (".", "::", "#")]
        loose = edges.where(ends[0] | ends[1] | ends[2]).crossJoin(F.broadcast(none)).where("none").drop("none")
        found = exact.unionByName(loose)
    return found.withColumn("path", path).orderBy("path", "line", "from_symbol", "to_symbol").limit(limit).select("from_symbol", "to_symbol", "path", "line")


def call_graph(edges: DataFrame, most_paths: int = 100) -> DataFrame:
    """By symbol: distinct callers and files, greatest confidence, and the first `most_paths` of the paths. Distinct pairs
    are counted after a first aggregation, so no set of a hot symbol is held in a row; paths are cut by rank before they
    are collected."""
    pairs = edges.groupBy("to_symbol", "from_symbol").agg(F.max("confidence").alias("confidence"))
    callers = pairs.groupBy("to_symbol").agg(F.count("from_symbol").alias("callers"), F.max("confidence").alias("confidence"))
    paths = edges.groupBy("to_symbol", "relative_path").agg(F.lit(1).alias("one"))
    first = paths.withColumn("n", F.row_number().over(Window.partitionBy("to_symbol").orderBy("relative_path"))).where(F.col("n") <= most_paths)
    first = first.groupBy("to_symbol").agg(F.array_join(F.sort_array(F.collect_list("relative_path")), ",").alias("paths"))
    files = paths.groupBy("to_symbol").agg(F.count("relative_path").alias("files"))
    return callers.join(files, "to_symbol").join(first, "to_symbol").select("to_symbol", "callers", "files", "confidence", "paths")


def orphan_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges to a symbol that its file does not define."""
    return edges.join(symbols.select(F.col("symbol_key").alias("to_symbol"), "relative_path"), ["to_symbol", "relative_path"], "left_anti")


def graph_health(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    counted = edges.join(symbols.select(F.col("symbol_key").alias("to_symbol"), "relative_path", F.lit(1).alias("known")), ["to_symbol", "relative_path"], "left")
    return counted.agg(F.count("*").alias("relations"), F.count_if(F.col("known").isNull()).alias("orphans"))


def symbol_search(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    hit = F.contains(F.lower("name"), F.lit(query.lower())) | F.contains(F.lower("symbol_key"), F.lit(query.lower()))
    return symbols.where(hit).orderBy("relative_path", "line", "name").limit(limit).select("symbol_key", "name", "kind", "relative_path", "line")


def symbol_depth(symbols: DataFrame) -> DataFrame:
    """Length of the parent chain; parents that are not in the table end it, a chain that runs into a cycle has none (null).
    Each round is a join by key that doubles the steps taken, so the rounds follow the logarithm of the longest chain."""
    from tessera.sources.shared import materialize

    known = symbols.select(F.col("symbol_key").alias("at")).distinct()
    links = symbols.select("symbol_key", F.col("parent_key").alias("at")).join(known.withColumn("steps", F.lit(1).cast("bigint")), "at", "left")
    steps = F.coalesce("steps", F.lit(0).cast("bigint")).alias("steps")
    walk = materialize(links.select("symbol_key", F.when(F.col("steps") == 1, F.col("at")).alias("at"), steps), "depth")
    most, taken = walk.select("symbol_key").distinct().count(), 1
    while taken <= most and not walk.where("at is not null").isEmpty():
        further = walk.select(F.col("symbol_key").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
        ahead = walk.where("at is not null").join(further, "at").select("symbol_key", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"))
        walk = materialize(walk.where("at is null").unionByName(ahead).groupBy("symbol_key", "at").agg(F.max("steps").alias("steps")), "depth")
        taken *= 2
    return walk.groupBy("symbol_key").agg(F.when(F.count("at") == 0, F.max("steps")).alias("depth"))


def containers(symbols: DataFrame) -> DataFrame:
    up = symbols.select(F.col("symbol_key").alias("parent_key"), F.col("name").alias("container"))
    return symbols.join(up, "parent_key", "left").select("symbol_key", "name", "container")


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """The longest root that is an ancestor of each path: an equality join over the path's own prefixes, not a range join."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = paths.select(path, F.explode(prefixes).alias("__p")).join(roots.select(root), F.col("__p") == F.col(root))
    return hit.groupBy(path).agg(F.max_by(root, F.length(root)).alias("workspace"))


def round_robin(df: DataFrame, by: str, order: str) -> DataFrame:
    """Interleaves groups, one row of each in turn."""
    w = Window.partitionBy(by).orderBy(order)
    t = df.withColumns({"turn": F.row_number().over(w), "first": F.min(order).over(Window.partitionBy(by))})
    return t.orderBy("turn", "first")


def hotness(jobs: DataFrame, by: str, seconds: int, weights: dict[str, float]) -> DataFrame:
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("event_type")), F.lit(1.0))
    w = Window.partitionBy(by).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return jobs.select("event_id", by, F.round(F.sum(weight).over(w), 6).alias("hotness"))


def debounce(jobs: DataFrame, by: str, seconds: int) -> DataFrame:
    """The last event of each burst: one that no event of the same key follows within the gap."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.col("ts"), F.lead("ts").over(w))
    return jobs.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= seconds)).select("event_id", by, "event_type")


def precision_recall(found: DataFrame, golden: DataFrame, key: str, by: str) -> DataFrame:
    """found and golden: key and group. Empty denominators count as 100."""
    f = found.select(key, by).distinct().withColumn("f", F.lit(1))
    g = golden.select(key, by).distinct().withColumn("g", F.lit(1))
    t = f.join(g, [key, by], "full").groupBy(by).agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    rate = lambda d: F.round(F.when(F.col("tp") + F.col(d) == 0, 100.0).otherwise(100.0 * F.col("tp") / (F.col("tp") + F.col(d))), 6)
    return t.select(by, "tp", "fp", "fn", rate("fp").alias("precision"), rate("fn").alias("recall"))


def session_metrics(turns: DataFrame) -> DataFrame:
    """By conversation: searches (user turns), reads (assistant turns), lines read, the state of the budget."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    t = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("searches"), F.count_if(F.col("role") == "assistant").alias("reads"), F.sum(F.when(F.col("role") == "assistant", lines).otherwise(0)).alias("read_lines"))
    return t.withColumn("state", F.when((F.col("reads") >= 25) | (F.col("read_lines") >= 2500), "HARD_LIMIT").when((F.col("reads") >= 20) | (F.col("read_lines") >= 2000), "NEAR_LIMIT").otherwise("OK"))
