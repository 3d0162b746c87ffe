"""Queries over the life of jobs, snapshots, call edges and sessions, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import lifecycle as L
from tessera.operators import search as S
from tessera.operators import merge as M
from tessera.plans.registry import query
from tessera.streaming import folds

NOW = "timestamp_ntz '1996-06-30 00:00:00'"


# --- the queue


@query("""WITH r AS (SELECT '/ws/c' || doc_id % 25 AS repo_root, CASE WHEN doc_id % 2 = 0 THEN 'l5' ELSE 'default' END AS lane, max(doc_id % 97)::BIGINT AS asked, arg_max(content_hash, doc_id) AS content_hash FROM files GROUP BY 1, 2),
q AS (SELECT * FROM (SELECT *, CASE WHEN defer_reason LIKE 'l5:%' THEN 'l5' ELSE 'default' END AS lane FROM queue) WHERE status IN ('PENDING', 'FAILED') QUALIFY row_number() OVER (PARTITION BY repo_root, lane ORDER BY created_at DESC, job_id DESC) = 1)
SELECT r.repo_root, r.lane, q.job_id, r.content_hash, greatest(r.asked, q.priority)::BIGINT AS priority, CASE WHEN q.job_id IS NULL THEN 'insert' ELSE 'merge' END AS change FROM r LEFT JOIN q ON r.repo_root = q.repo_root AND r.lane = q.lane""", "queue", "files")
def q02_enqueue_many(queue, files):
    asked = files.select(F.concat(F.lit("/ws/c"), F.col("doc_id") % 25).alias("repo_root"), F.when(F.col("doc_id") % 2 == 0, "l5").otherwise("default").alias("lane"), (F.col("doc_id") % 97).alias("priority"), "content_hash", F.col("doc_id").alias("seq"))
    return L.enqueue_many(queue.withColumn("lane", L.lane(F.col("defer_reason"))), asked, ["repo_root", "lane"])


@query("SELECT job_id, lane FROM (SELECT *, CASE WHEN defer_reason LIKE 'l5:%' THEN 'l5' ELSE 'default' END AS lane FROM queue WHERE status = 'PENDING') QUALIFY row_number() OVER (PARTITION BY lane ORDER BY priority DESC, created_at, job_id) <= 16", "queue")
def q03_acquire_by_lane(queue):
    w = Window.partitionBy("lane").orderBy(F.desc("priority"), "created_at", "job_id")
    return queue.where("status = 'PENDING'").withColumn("lane", L.lane(F.col("defer_reason"))).withColumn("n", F.row_number().over(w)).where("n <= 16").select("job_id", "lane")


@query("SELECT job_id, a AS attempts, CASE WHEN a >= 5 THEN 'DEAD' ELSE 'FAILED' END AS status, CASE WHEN a < 5 THEN (30 * pow(2, a - 1))::BIGINT END AS wait_seconds FROM (SELECT job_id, job_id % 6 + 1 AS a FROM queue WHERE status = 'FAILED')", "queue")
def q05_fail_with_backoff(queue):
    jobs = queue.where("status = 'FAILED'").select("job_id", (F.col("job_id") % 6).alias("attempts"), "status")
    return L.fail_with_backoff(jobs, 30, 5)


@query("""SELECT job_id, repo_root, CASE WHEN NOT fresh THEN 'DROP_TTL' WHEN n > 20 THEN 'DROP_CAP' WHEN c = 0 THEN 'NEW' WHEN c <= 2 THEN 'RETRY_WAIT' ELSE 'BUMPED' END AS state FROM (
SELECT job_id, repo_root, job_id % 5 AS c, fresh, row_number() OVER (PARTITION BY repo_root, fresh ORDER BY created_at, job_id) AS n FROM (SELECT *, created_at >= TIMESTAMP '1994-06-30' AS fresh FROM queue WHERE status = 'PENDING'))""", "queue")
def q06_defer(queue):
    jobs = queue.where("status = 'PENDING'").withColumn("defer_count", F.col("job_id") % 5)
    return L.defer(jobs, F.expr(NOW), 24 * 731, 20)


@query("SELECT job_id, CASE WHEN created_at < TIMESTAMP '1995-01-01' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM queue WHERE status = 'RUNNING'", "queue")
def q09_recover_stale(queue):
    return queue.where("status = 'RUNNING'").select("job_id", F.when(F.expr("created_at < timestamp_ntz '1995-01-01 00:00:00'"), "FAILED").otherwise("RUNNING").alias("status"))


@query("SELECT job_id, 'PENDING' AS status FROM queue WHERE status = 'DEAD' AND repo_root = '/ws/c7' ORDER BY created_at, job_id LIMIT 30", "queue")
def q10_requeue_dead(queue):
    return queue.where("status = 'DEAD' and repo_root = '/ws/c7'").orderBy("created_at", "job_id").limit(30).select("job_id", F.lit("PENDING").alias("status"))


@query("""SELECT *, available + running + done + failed AS total FROM (SELECT count(*) FILTER (WHERE status = 'PENDING' AND created_at <= TIMESTAMP '1996-06-30') AS available, count(*) FILTER (WHERE status = 'RUNNING') AS running,
count(*) FILTER (WHERE status = 'DONE' AND job_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS done, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM queue WHERE defer_reason IS NULL OR defer_reason NOT IN ('budget'))""", "queue", "labels")
def q11_eligible_counts(queue, labels):
    ready = labels.where("quality = 1").select(F.col("doc_id").alias("job_id"))
    return L.eligible_counts(queue.withColumn("error_code", F.col("defer_reason")), ready, "job_id", F.expr(NOW), ["budget"])


@query("SELECT job_id, CASE WHEN defer_reason LIKE 'l5:heavy%' THEN 60 WHEN defer_reason = 'budget' THEN 10 ELSE 1 END AS seconds FROM queue WHERE status IN ('PENDING', 'FAILED')", "queue")
def q13_defer_delays(queue):
    seconds = F.when(F.startswith("defer_reason", F.lit("l5:heavy")), 60).when(F.col("defer_reason") == "budget", 10).otherwise(1)
    return queue.where("status in ('PENDING', 'FAILED')").select("job_id", seconds.alias("seconds"))


@query("SELECT q.job_id, CASE WHEN f.doc_id IS NULL OR f.is_deleted OR f.size_bytes % 7 <> q.job_id % 7 THEN 'DONE' ELSE 'RUN' END AS decision FROM queue q LEFT JOIN files f ON f.doc_id = q.job_id WHERE q.status = 'PENDING'", "queue", "files")
def q14_stale_guard(queue, files):
    t = queue.where("status = 'PENDING'").select("job_id").join(files.select(F.col("doc_id").alias("job_id"), "is_deleted", "size_bytes"), "job_id", "left")
    return t.select("job_id", F.expr("case when is_deleted is null or is_deleted or size_bytes % 7 <> job_id % 7 then 'DONE' else 'RUN' end").alias("decision"))


@query("""SELECT depth, remaining, round(100.0 * (n - remaining) / greatest(n, 1), 6)::DOUBLE AS progress, ceil(remaining * 3600 / high)::BIGINT AS eta_low, ceil(remaining * 3600 / low)::BIGINT AS eta_high FROM (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'PENDING') AS depth, count(*) FILTER (WHERE status NOT IN ('DONE', 'DEAD')) AS remaining FROM queue),
(SELECT min(rate) AS low, max(rate) AS high FROM (SELECT count(*) AS rate FROM queue WHERE status = 'DONE' GROUP BY date_trunc('hour', created_at) ORDER BY rate DESC LIMIT 8))""", "queue")
def g19_pipeline_metrics(queue):
    return L.pipeline_metrics(queue)


@query("SELECT kind, key, n FROM (SELECT 'reason' AS kind, coalesce(defer_reason, 'none') AS key, count(*) AS n FROM queue WHERE status = 'DEAD' GROUP BY ALL UNION ALL SELECT 'repo', repo_root, count(*) FROM queue WHERE status = 'DEAD' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) <= 3", "queue")
def g13_drop_breakdowns(queue):
    dead = queue.where("status = 'DEAD'").select(F.explode(F.array(F.struct(F.lit("reason").alias("kind"), F.coalesce("defer_reason", F.lit("none")).alias("key")), F.struct(F.lit("repo").alias("kind"), F.col("repo_root").alias("key")))).alias("x"))
    n = dead.groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))).where("r <= 3").drop("r")


@query("SELECT repo_root, sum(o_totalprice)::DECIMAL(38, 2)::VARCHAR AS cost, count(*) AS n FROM (SELECT repo_root, o_totalprice::DECIMAL(18, 2) AS o_totalprice FROM queue) GROUP BY 1", "queue")
def g32_costs(queue):
    return queue.groupBy("repo_root").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").cast("string").alias("cost"), F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM files WHERE NOT is_deleted) AS files, (SELECT count(DISTINCT repo_root) FROM files WHERE NOT is_deleted) AS roots, (SELECT count(*) FROM queue WHERE status = 'PENDING') AS pending, (SELECT count(*) FROM queue WHERE status = 'DEAD') AS dead""", "files", "queue")
def g36_integrity_snapshot(files, queue):
    live = files.where("not is_deleted").agg(F.count("*").alias("files"), F.countDistinct("repo_root").alias("roots"))
    # two tables of one row
    return live.crossJoin(F.broadcast(queue.agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "DEAD").alias("dead"))))


@query("SELECT array_to_string(list_sort(list(DISTINCT lang) FILTER (WHERE enrich_state = 'TOOL_READY')), ',') AS available, array_to_string(list_sort(list(DISTINCT lang) FILTER (WHERE enrich_state = 'FAILED')), ',') AS failed FROM files", "files")
def g31_language_sets(files):
    langs = lambda state: F.array_join(F.array_sort(F.collect_set(F.when(F.col("enrich_state") == state, F.col("lang")))), ",")
    return files.agg(langs("TOOL_READY").alias("available"), langs("FAILED").alias("failed"))


@query("SELECT substr(event_type, 1, 1) AS prefix, count(*) AS n, round(sum(latency_ms), 4) AS total FROM jobs WHERE event_type LIKE 's%' OR event_type LIKE 'p%' GROUP BY 1", "jobs")
def g26_prefix_families(jobs):
    own = jobs.where("startswith(event_type, 's') or startswith(event_type, 'p')")
    return own.groupBy(F.substring("event_type", 1, 1).alias("prefix")).agg(F.count("*").alias("n"), F.round(F.sum("latency_ms"), 4).alias("total"))


# --- health, admission and modes


@query("""SELECT user_id, count(*) FILTER (WHERE failed AND (last_ok IS NULL OR event_id > last_ok)) AS streak, CASE WHEN count(*) FILTER (WHERE failed AND (last_ok IS NULL OR event_id > last_ok)) >= 3 THEN 'DEGRADED' ELSE 'ACTIVE' END AS state
FROM (SELECT user_id, event_id, event_type IN ('error', 'click') AS failed, max(CASE WHEN event_type NOT IN ('error', 'click') THEN event_id END) OVER (PARTITION BY user_id) AS last_ok FROM jobs) GROUP BY 1""", "jobs")
def b92_failure_streaks(jobs):
    return L.failure_streaks(jobs, "user_id", "event_id", F.col("event_type").isin("error", "click"))


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL OR b.gen > a.gen THEN b.gen ELSE a.gen END AS gen FROM (SELECT user_id, max(event_id) % 10 AS gen FROM jobs WHERE user_id % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT user_id, max(event_id) % 7 AS gen FROM jobs WHERE user_id % 2 > 0 GROUP BY 1) b ON a.user_id = b.user_id", "jobs")
def b98_fenced_upsert(jobs):
    side = lambda m, d: jobs.where(F.col("user_id") % d > 0).groupBy("user_id").agg((F.max("event_id") % m).alias("gen"))
    return L.fenced(side(10, 3), side(7, 2), "user_id", "gen")


@query("SELECT name, CASE WHEN count(DISTINCT symbol_key) = 1 THEN min(symbol_key) END AS symbol_key FROM (SELECT split_part(name, ' ', 1) || ':' || line % 400 AS name, symbol_key FROM symbols) GROUP BY 1", "symbols")
def b83_label_lookup(symbols):
    t = symbols.select(F.concat(F.split_part("name", F.lit(" "), F.lit(1)), F.lit(":"), F.col("line") % 400).alias("name"), "symbol_key")
    return t.groupBy("name").agg(F.min("symbol_key").alias("low"), F.max("symbol_key").alias("high")).select("name", F.when(F.col("low") == F.col("high"), F.col("low")).alias("symbol_key"))


@query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN latency_ms >= 60 THEN true WHEN latency_ms < 20 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS "on" FROM jobs""", "jobs")
def r18_mode_hysteresis(jobs):
    return L.hysteresis(jobs, ["event_id"], "user_id", F.col("latency_ms"), 60, 20).select("event_id", "user_id", "on")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM jobs),
b AS (SELECT user_id, i, event_id, us, true AS admitted, 2 * 86400000000::BIGINT AS level FROM e WHERE i = 1
  UNION ALL SELECT user_id, i, event_id, us, have >= 86400000000, have - CASE WHEN have >= 86400000000 THEN 86400000000 ELSE 0 END FROM (SELECT e.*, least(3 * 86400000000::BIGINT, b.level + e.us - b.us) AS have FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
SELECT event_id, user_id, admitted FROM b""", "jobs")
def r09_token_bucket(jobs):
    return L.token_bucket(jobs, "user_id", "event_id", 86400, 3)


_KIND = "CASE event_type WHEN 'signup' THEN 'ok' WHEN 'view' THEN 'ok' WHEN 'click' THEN 'warn' WHEN 'error' THEN 'critical' ELSE CASE WHEN event_id % 2 = 0 THEN 'hold' ELSE 'release' END END"


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (SELECT event_id, user_id, ts, {_KIND} AS kind FROM jobs)),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::VARCHAR AS kind, false AS held, false AS own, NULL::VARCHAR AS action FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, i, event_id, kind, CASE action WHEN 'HOLD_ENABLED' THEN true WHEN 'HOLD_RELEASED' THEN false WHEN 'BY_HAND' THEN kind = 'hold' ELSE held END, CASE action WHEN 'HOLD_ENABLED' THEN true WHEN 'HOLD_RELEASED' THEN false ELSE own END, action
    FROM (SELECT e.*, r.held, r.own, CASE WHEN e.kind IN ('hold', 'release') THEN 'BY_HAND' WHEN e.kind IN ('warn', 'critical') AND NOT r.held THEN 'HOLD_ENABLED' WHEN e.kind = 'ok' AND r.own AND r.held THEN 'HOLD_RELEASED' ELSE 'NO_CHANGE' END AS action FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, id, kind, held, own, action FROM r WHERE i > 0""", "jobs")
def r16_auto_hold(jobs):
    return folds.fold_table(jobs.select("user_id", "ts", F.col("event_id").alias("id"), F.expr(_KIND).alias("kind")), "user_id", "ts", "id", folds.auto_hold())


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM (SELECT event_id, user_id, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'warm' WHEN 'purchase' THEN 'startup' WHEN 'error' THEN 'other' ELSE 'flush' END AS kind, event_id % 90 AS n FROM jobs)),
r AS (SELECT user_id, 0::BIGINT AS i, false AS opened, 0::BIGINT AS n, 0::BIGINT AS files, NULL::BIGINT AS due, NULL::BIGINT AS "at", NULL::VARCHAR AS cause, 0::BIGINT AS drained, 0::BIGINT AS taken FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, CASE WHEN rings THEN i ELSE i + 1 END, opened OR (NOT rings AND (kind = 'warm' OR kind = 'startup' AND new > 0)), CASE WHEN cause IS NOT NULL THEN 0 WHEN added > 0 THEN n + 1 ELSE n END, files + added - taken,
      CASE WHEN cause IS NOT NULL THEN CASE WHEN files > taken THEN moment + 43200000000 END WHEN added > 0 THEN CASE WHEN opened OR kind = 'startup' THEN least(moment + 21600000000, coalesce(due, moment + 21600000000)) END ELSE due END, moment, cause, n, taken
    FROM (SELECT *, CASE WHEN cause IS NULL THEN 0 ELSE least(50, files) END AS taken
      FROM (SELECT *, CASE WHEN rings THEN CASE WHEN n > 0 THEN 'flush' ELSE 'poll' END WHEN kind = 'warm' THEN 'warm' END AS cause, CASE WHEN NOT rings AND kind IN ('flush', 'startup') THEN new ELSE 0 END AS added, CASE WHEN rings THEN due ELSE arrived END AS moment
        FROM (SELECT r.user_id, r.i, r.opened, r.n, r.files, r.due, e.t AS arrived, e.kind, e.n AS new, r.due IS NOT NULL AND (e.t IS NULL OR r.due <= e.t) AS rings FROM r LEFT JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) WHERE rings OR arrived IS NOT NULL)))
SELECT user_id, "at", cause AS trigger, drained AS n, taken AS files FROM r WHERE taken > 0""", "jobs")
def r08_upgrade_batches(jobs):
    """A user stands for a repository; hours for seconds."""
    kind = F.when(F.col("event_type") == "signup", "warm").when(F.col("event_type") == "purchase", "startup").when(F.col("event_type") == "error", "other").otherwise("flush")
    t = jobs.select("user_id", "ts", "event_id", kind.alias("kind"), (F.col("event_id") % 90).alias("files"))
    return folds.fold_table(t, "user_id", "ts", "event_id", folds.upgrade_batches(6 * 3600_000_000, 12 * 3600_000_000))


_REFUSED = "CASE event_type WHEN 'error' THEN 'pressure_burst_exceeded' WHEN 'signup' THEN 'mode_not_allowed' END"


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM (SELECT event_id, user_id, epoch_us(ts) // 3600 AS t, event_id % 5 AS f, {_REFUSED} AS refused FROM jobs)),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS f, NULL::VARCHAR AS reason, NULL::BIGINT AS until, []::BIGINT[] AS admitted, [0, 0, 0, 0, 0]::BIGINT[] AS waits FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, i, event_id, f, reason, until, CASE WHEN reason IS NULL THEN list_append(recent, t) ELSE recent END, list_transform(waits, lambda w, k: CASE WHEN k = f + 1 THEN coalesce(until, 0) ELSE w END)
    FROM (SELECT *, CASE WHEN reason IS NOT NULL THEN greatest(t, waits[f + 1]) + CASE reason WHEN 'pressure_rate_exceeded' THEN 30000000 WHEN 'cooldown_active' THEN 15000000 ELSE 10000000 END END AS until
      FROM (SELECT *, CASE WHEN len(recent) >= 3 THEN 'pressure_rate_exceeded' WHEN refused IS NOT NULL THEN refused WHEN t < waits[f + 1] THEN 'cooldown_active' END AS reason
        FROM (SELECT e.*, r.waits, list_filter(r.admitted, lambda x: x >= e.t - 60000000) AS recent FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))))
SELECT user_id, id, 'f' || f AS file, reason, coalesce(until, 0) AS until FROM r WHERE i > 0""", "jobs")
def r11_admission_runtime(jobs):
    """A user stands for a language; hours for seconds."""
    t = jobs.select("user_id", F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 3600")).alias("ts"), F.col("event_id").alias("id"), F.concat(F.lit("f"), F.col("event_id") % 5).alias("file"), F.expr(_REFUSED).alias("refused"))
    return folds.fold_table(t, "user_id", "ts", "id", folds.admission(3)).fillna(0, ["until"])


@query("SELECT conv_id, round(CASE WHEN count(*) FILTER (WHERE role = 'user') = 0 THEN 0 ELSE count(*) FILTER (WHERE role = 'assistant') / count(*) FILTER (WHERE role = 'user') END, 6)::DOUBLE AS ratio, max(turn) AS last_turn FROM conversations GROUP BY 1", "conversations")
def v44_session_ratios(turns):
    reads, searches = (F.count_if(F.col("role") == x) for x in ("assistant", "user"))
    return turns.groupBy("conv_id").agg(F.round(F.coalesce(F.try_divide(reads, searches), F.lit(0.0)), 6).alias("ratio"), F.max("turn").alias("last_turn"))


@query("SELECT job_id, CASE WHEN defer_reason LIKE 'l5:%' THEN least(3600, 60 * pow(2, job_id % 8))::BIGINT WHEN defer_reason IS NULL THEN 5 ELSE 300 END AS seconds FROM queue WHERE status IN ('FAILED', 'DEAD')", "queue")
def v15_probe_backoff(queue):
    ladder = F.when(F.startswith("defer_reason", F.lit("l5:")), F.least(F.lit(3600), F.lit(60) * F.pow(F.lit(2), F.col("job_id") % 8)).cast("bigint")).when(F.col("defer_reason").isNull(), 5).otherwise(300)
    return queue.where("status in ('FAILED', 'DEAD')").select("job_id", ladder.cast("bigint").alias("seconds"))


# --- snapshots


@query("SELECT f.doc_id, f.is_deleted OR l.doc_id IS NULL AS is_deleted FROM files f LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = f.doc_id", "files", "labels")
def w02_tombstones(files, labels):
    return M.tombstone_missing(files.select("doc_id", "is_deleted"), labels, ["doc_id"])


@query("SELECT doc_id, is_deleted OR (repo_root <> '/ws/src1' AND scope_repo_root = '/ws') AS is_deleted FROM files", "files")
def w03_tombstone_scope(files):
    return files.select("doc_id", (F.col("is_deleted") | ((F.col("repo_root") != "/ws/src1") & (F.col("scope_repo_root") == "/ws"))).alias("is_deleted"))


@query("SELECT f.doc_id, CASE WHEN l.quality = 1 THEN 'TOOL_READY' WHEN l.quality = 0 THEN 'FAILED' ELSE f.enrich_state END AS enrich_state FROM files f LEFT JOIN labels l ON l.doc_id = f.doc_id", "files", "labels")
def w05_state_updates(files, labels):
    new = labels.select("doc_id", F.when(F.col("quality") == 1, "TOOL_READY").otherwise("FAILED").alias("new"))
    return files.select("doc_id", "enrich_state").join(new, "doc_id", "left").select("doc_id", F.coalesce("new", "enrich_state").alias("enrich_state"))


@query("SELECT from_symbol, line, confidence FROM edges WHERE line NOT IN (SELECT line FROM edges WHERE confidence > 0.09 AND line > 4) UNION ALL SELECT from_symbol, line, confidence FROM edges WHERE confidence > 0.09 AND line > 4", "edges")
def w07_replace_file_rows(edges):
    t = edges.select("from_symbol", "line", "confidence")
    return L.replace_file_rows(t, t.where("confidence > 0.09 and line > 4"), ["line"])


@query("""SELECT e.from_symbol, e.relative_path, coalesce(e.to_key, s.symbol_key) AS to_key FROM (SELECT from_symbol, relative_path, CASE WHEN line > 3 THEN to_symbol END AS to_key, 'p' || line * 13 AS name FROM edges) e
LEFT JOIN (SELECT relative_path, name, min(symbol_key) AS symbol_key FROM (SELECT relative_path, 'p' || line % 100 AS name, symbol_key FROM symbols) GROUP BY 1, 2 HAVING count(DISTINCT symbol_key) = 1) s ON s.relative_path = e.relative_path AND s.name = e.name""", "edges", "symbols")
def w29_backfill_keys(edges, symbols):
    e = edges.select("from_symbol", "relative_path", F.when(F.col("line") > 3, F.col("to_symbol")).alias("to_key"), F.concat(F.lit("p"), F.col("line") * 13).alias("name"))
    s = symbols.select("relative_path", F.concat(F.lit("p"), F.col("line") % 100).alias("name"), F.col("symbol_key").alias("to_key"))
    return L.backfill_keys(e, s, "name", "to_key", ["relative_path"]).select("from_symbol", "relative_path", "to_key")


@query("SELECT doc_id, relative_path, content_hash FROM files f WHERE NOT is_deleted AND (SELECT count(DISTINCT content_hash) FROM files g WHERE g.relative_path = f.relative_path AND NOT g.is_deleted) = 1", "files")
def w13_guarded(files):
    return M.guarded(files.where("not is_deleted").select("doc_id", "relative_path", "content_hash"), files, ["relative_path"])


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL OR (a.ready AND NOT b.ready AND a.h = b.h) THEN a.ready ELSE b.ready END AS ready FROM (SELECT doc_id, content_hash AS h, enrich_state = 'TOOL_READY' AS ready FROM files) a
FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE content_hash END AS h, doc_id % 5 = 0 AS ready FROM files WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id""", "files")
def w15_no_downgrade(files):
    old = files.select("doc_id", F.col("content_hash").alias("h"), (F.col("enrich_state") == "TOOL_READY").alias("ready"))
    new = files.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("content_hash")).alias("h"), (F.col("doc_id") % 5 == 0).alias("ready"))
    return M.keep_better(old, new, ["doc_id"], "old.ready and not new.ready and old.h = new.h").select("doc_id", "ready")


# --- lookups, matches and graph


@query("SELECT symbol_key, first(name) AS name FROM symbols WHERE symbol_key = 'sym_42' GROUP BY 1", "symbols")
def f06_name_of_key(symbols):
    return symbols.where("symbol_key = 'sym_42'").groupBy("symbol_key").agg(F.min("name").alias("name"))


@query("SELECT relative_path, symbol_key FROM (SELECT *, max(depth) OVER (PARTITION BY relative_path) AS newest FROM symbols) WHERE depth = newest", "symbols")
def f07_latest_symbols(symbols):
    newest = symbols.groupBy("relative_path").agg(F.max("depth").alias("depth"))
    return symbols.join(newest, ["relative_path", "depth"]).select("relative_path", "symbol_key")


@query("SELECT from_symbol, to_symbol, line FROM edges WHERE repo_root = '/ws/supp3' AND relative_path = 'm2.py' ORDER BY from_symbol, to_symbol LIMIT 200", "edges")
def f08_file_relations(edges):
    return edges.where("repo_root = '/ws/supp3' and relative_path = 'm2.py'").orderBy("from_symbol", "to_symbol").limit(200).select("from_symbol", "to_symbol", "line")


@query("SELECT count(*) AS n FROM files WHERE NOT regexp_matches(relative_path, '(^|/)(tests|app)/')", "files")
def f12_quality_scope(files):
    return files.where(~F.regexp_like("relative_path", F.lit("(^|/)(tests|app)/"))).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id FROM jobs WHERE status = 'DONE' AND user_id IN (SELECT user_id FROM jobs WHERE status = 'DEAD' AND latency_ms > 50)", "jobs")
def f15_active_probe(jobs):
    hit = jobs.where("status = 'DEAD' and latency_ms > 50").select("user_id").distinct()
    return jobs.where("status = 'DONE'").select("user_id", "event_id").join(hit, "user_id", "left_semi")


@query("SELECT event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM jobs) WHERE prev IS NOT NULL AND epoch_us(ts) - epoch_us(prev) <= 86400000000", "jobs")
def f16_recency_skip(jobs):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return jobs.withColumn("prev", F.lag("ts").over(w)).where("ts - prev <= interval 1 day").select("event_id")


@query("SELECT e.from_symbol, e.line, s.kind FROM edges e JOIN symbols s ON s.relative_path = e.relative_path AND s.symbol_key = e.to_symbol WHERE s.kind = 'class'", "edges", "symbols")
def j16_constructor_edges(edges, symbols):
    return edges.join(symbols.where("kind = 'class'").select("relative_path", F.col("symbol_key").alias("to_symbol"), "kind"), ["relative_path", "to_symbol"]).select("from_symbol", "line", "kind")


@query("""SELECT c.container_name FROM (SELECT container_name, list(DISTINCT kind) AS have FROM symbols GROUP BY 1) c WHERE list_has_all(c.have, ['class', 'method', 'field'])""", "symbols")
def j17_structural_matches(symbols):
    have = symbols.groupBy("container_name").agg(F.collect_set("kind").alias("have"))
    return have.where(F.size(F.array_except(F.array(*map(F.lit, ("class", "method", "field"))), F.col("have"))) == 0).select("container_name")


@query("""SELECT coalesce(a.lang, b.lang) AS lang, count(*) FILTER (WHERE a.h IS NOT NULL AND b.h IS NOT NULL) AS tp, count(*) FILTER (WHERE b.h IS NULL) AS fp, count(*) FILTER (WHERE a.h IS NULL) AS fn FROM (SELECT DISTINCT lang, content_hash AS h FROM files WHERE doc_id % 3 <> 0) a
FULL JOIN (SELECT DISTINCT lang, content_hash AS h FROM files WHERE doc_id % 4 <> 0) b ON a.h = b.h AND a.lang = b.lang GROUP BY 1""", "files")
def j14_set_difference(files):
    a = files.where("doc_id % 3 <> 0").select("lang", "content_hash").distinct().withColumn("a", F.lit(1))
    b = files.where("doc_id % 4 <> 0").select("lang", "content_hash").distinct().withColumn("b", F.lit(1))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, ["lang", "content_hash"], "full").groupBy("lang").agg(F.count_if(both).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))


@query(None, "symbols")
def j12_greedy_match(symbols):
    golden = symbols.select("relative_path", "name", "kind", (F.col("line") + F.col("line") % 4).alias("line"))
    return M.greedy_match(symbols.select("relative_path", "name", "kind", F.col("line")), golden, "relative_path")


@query("SELECT DISTINCT to_symbol, from_symbol, line FROM edges WHERE confidence > 0.08 OR line = 1 ORDER BY to_symbol, from_symbol, line LIMIT 100", "edges")
def u01_union_of_callers(edges):
    pick = lambda c: edges.where(c).select("to_symbol", "from_symbol", "line")
    return pick("confidence > 0.08").union(pick("line = 1")).distinct().orderBy("to_symbol", "from_symbol", "line").limit(100)


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM jobs WHERE status <> 'DEAD') WHERE n = 1", "jobs")
def t06_latest_active(jobs):
    x = F.max_by(F.struct("user_id", "event_id"), F.struct("ts", "event_id")).alias("x")
    return jobs.where("status <> 'DEAD'").groupBy("event_type").agg(x).select("event_type", "x.*")


@query("SELECT event_id, CASE WHEN h <= 24 THEN 1.5 WHEN h <= 168 THEN 1.3 WHEN h <= 720 THEN 1.1 ELSE 1.0 END::DOUBLE AS recency FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3600000000 AS h FROM jobs)", "jobs")
def k07_recency(jobs):
    t = jobs.select("event_id", ((F.lit(1706659200000000) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3600000000).alias("h"))
    return t.select("event_id", F.expr("case when h <= 24 then 1.5D when h <= 168 then 1.3D when h <= 720 then 1.1D else 1.0D end").alias("recency"))


@query("""SELECT item_id, cell, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM (SELECT item_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 128 AS cell, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS w FROM benchmark) GROUP BY 1, 2)""", "benchmark")
def k09_embedding(benchmark):
    t = benchmark.select("item_id", F.posexplode(L.embed(F.col("text"))).alias("cell", "weight")).where("weight > 0")
    return t.select("item_id", F.col("cell").cast("bigint").alias("cell"), F.round("weight", 6).alias("weight"))


@query("SELECT to_symbol, round(greatest(-3.0, least(3.0, ln(1 + abs(x)) * sign(x))), 6)::DOUBLE AS norm FROM (SELECT to_symbol, count(*)::DOUBLE - 25 AS x FROM edges GROUP BY 1)", "edges")
def n06_log_norm(edges):
    t = edges.groupBy("to_symbol").agg((F.count("*").cast("double") - 25).alias("x"))
    return t.select("to_symbol", F.round(S.log_norm("x", most=3.0), 6).alias("norm"))


@query("SELECT lang, count(*) AS asked, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS hits, floor(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) * 10000 / count(*))::BIGINT AS hit_bps FROM files GROUP BY 1", "files", "labels")
def v14_cache_hits(files, labels):
    t = files.select("lang", "doc_id").join(labels.select("doc_id").distinct().withColumn("hit", F.lit(True)), "doc_id", "left")
    hits = F.count_if(F.col("hit"))
    return t.groupBy("lang").agg(F.count("*").alias("asked"), hits.alias("hits"), C.basis_points(hits, F.count("*")).alias("hit_bps"))
