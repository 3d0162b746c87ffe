"""The registered queries over the model tables, each with its DuckDB form."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import index as I
from tessera.operators import lifecycle as L
from tessera.operators import search as S
from tessera.operators.percentiles import exact_percentiles
from tessera.operators.running import same, trailing_count
from tessera.plans import layers, lifecycle, maintenance, source_code  # noqa: F401 (register their queries)
from tessera.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from tessera.sources.shared import shared_dir

NOW = "timestamp_ntz '1996-06-30 00:00:00'"


@query("SELECT doc_id, relative_path, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS score FROM files WHERE NOT is_deleted AND contains(lower(text), 'the') ORDER BY doc_id LIMIT 50", "files")
def s07_substring_scan(files):
    return I.substring_scan(files, "the", 50)


@query("SELECT repo_root, relative_path, size_bytes, content_hash, enrich_state FROM files WHERE repo_root = '/ws/src3' AND NOT is_deleted AND starts_with(lower(relative_path), 'lib/') ORDER BY relative_path LIMIT 100", "files")
def s12_list_files(files):
    return I.list_files(files, "/ws/src3", 100, "LIB/")


@query("SELECT repo_root, relative_path, size_bytes, content_hash, enrich_state FROM files WHERE scope_repo_root = '/ws' AND NOT is_deleted ORDER BY relative_path, repo_root LIMIT 200", "files")
def s13_list_scope(files):
    return I.list_files(files, "/ws", 200, by="scope_repo_root")


@query("SELECT item_id, text FROM benchmark WHERE contains(lower(text), 'the') ORDER BY item_id DESC LIMIT 20", "benchmark")
def s19_snippet_search(snippets):
    return snippets.where(C.contains_ci(F.col("text"), "the")).orderBy(F.desc("item_id")).limit(20).select("item_id", "text")


@query("SELECT event_id, user_id, ts, latency_ms FROM jobs WHERE status = 'DEAD' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 10", "jobs")
def s24_events_page(jobs):
    return jobs.where("status = 'DEAD'").orderBy(F.desc("ts"), "event_id").offset(10).limit(25).select("event_id", "user_id", "ts", "latency_ms")


@query("SELECT event_id, status, latency_ms FROM jobs WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM jobs)", "jobs")
def s25_window_events(jobs):
    last = jobs.agg(F.max("ts").alias("last"))  # one row
    return jobs.join(F.broadcast(last), F.expr("ts >= last - interval 1 day")).select("event_id", "status", "latency_ms")


@query("SELECT ext, relative_path, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY size_bytes, relative_path, doc_id) AS n FROM (SELECT *, lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) AS ext FROM files WHERE NOT is_deleted)) WHERE n <= 3", "files")
def s26_sample_by_extension(files):
    t = files.where("not is_deleted").withColumn("ext", C.extension(F.col("relative_path")))
    return t.withColumn("n", F.row_number().over(Window.partitionBy("ext").orderBy("size_bytes", "relative_path", "doc_id"))).where("n <= 3").select("ext", "relative_path", "size_bytes")


@query("SELECT symbol_key, name, kind, relative_path, line FROM symbols WHERE contains(lower(name), 'a') OR contains(lower(symbol_key), 'a') ORDER BY relative_path, line, name LIMIT 50", "symbols")
def f01_symbol_search(symbols):
    return I.symbol_search(symbols, "a", 50)


@query("SELECT symbol_key, name, kind, relative_path, line FROM symbols WHERE contains(name, 'e') AND NOT regexp_matches(relative_path, '(site-packages|build|dist|venv)/') ORDER BY relative_path, line, name LIMIT 50", "symbols")
def f03_implementations(symbols):
    return I.symbol_search(symbols.where(F.contains("name", F.lit("e")) & ~F.regexp_like("relative_path", F.lit("(site-packages|build|dist|venv)/"))), "", 50)


@query("""SELECT from_symbol, to_symbol, coalesce(caller_relative_path, relative_path) AS path, line FROM calls WHERE to_symbol = 'src1' OR ((SELECT count(*) FROM calls WHERE to_symbol = 'src1') = 0 AND (to_symbol ILIKE '%.src1' OR to_symbol ILIKE '%::src1' OR to_symbol ILIKE '%#src1'))
ORDER BY path, line, from_symbol, to_symbol LIMIT 100""", "calls")
def f05_suffix_callers(calls):
    return I.suffix_callers(calls, "src1", 100)


@query("SELECT from_symbol, to_symbol, coalesce(caller_relative_path, relative_path) AS path, line FROM calls WHERE to_symbol = 'run_job' ORDER BY path, line, from_symbol, to_symbol LIMIT 100", "calls")
def h01_exact_before_suffix(calls):
    return I.suffix_callers(calls, "run_job", 100)


@query("SELECT CASE ext WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.md' THEN 'markdown' ELSE 'unknown' END AS language, count(*) AS n FROM (SELECT lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) AS ext FROM files) GROUP BY 1", "files")
def f09_language_of_path(files):
    return files.groupBy(C.language_of(F.col("relative_path")).alias("language")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_matches(relative_path, '(^|/)(test|tests)/|(^|/)test_[^/]*$|_test\\.[^/]*$') AS is_test FROM files", "files")
def f11_test_scope(files):
    return files.select("doc_id", C.is_test_path(F.col("relative_path")).alias("is_test"))


@query("SELECT doc_id FROM files WHERE ('0x' || substr(sha1(lang || '|' || repo_root || '|' || relative_path || '|' || content_hash), 1, 8))::BIGINT / 4294967295.0 < 0.1", "files")
def f14_hash_sample(files):
    return files.where(C.hash_fraction(F.col("lang"), F.col("repo_root"), F.col("relative_path"), F.col("content_hash")) < 0.1).select("doc_id")


@query("SELECT repo_root, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files WHERE NOT is_deleted GROUP BY 1", "files")
def g01_repo_stats(files):
    return I.repo_stats(files)


@query("SELECT enrich_state, count(*) AS n FROM files WHERE NOT is_deleted GROUP BY 1", "files")
def g02_state_histogram(files):
    return I.state_counts(files)


@query("SELECT count(DISTINCT repo_root) AS n FROM files WHERE NOT is_deleted AND scope_repo_root = '/ws'", "files")
def g03_repo_count(files):
    return files.where("not is_deleted and scope_repo_root = '/ws'").agg(F.countDistinct("repo_root").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT relative_path FROM symbols)", "symbols")
def g06_symbol_files(symbols):
    return symbols.select("relative_path").distinct().agg(F.count("*").alias("n"))


@query("SELECT to_symbol, count(DISTINCT repo_root || '::' || coalesce(caller_relative_path, relative_path)) AS fan_in FROM edges GROUP BY 1", "edges")
def g07_fan_in(edges):
    return S.fan_in(edges)


@query("SELECT relative_path, count(*) AS symbols FROM symbols GROUP BY 1", "symbols")
def g08_symbols_per_file(symbols):
    return symbols.groupBy("relative_path").agg(F.count("*").alias("symbols"))


@query("SELECT repo_root, relative_path, count(*) AS relations FROM edges GROUP BY 1, 2", "edges")
def g09_relations_per_file(edges):
    return edges.groupBy("repo_root", "relative_path").agg(F.count("*").alias("relations"))


@query("SELECT s AS status, count(q.status) AS n FROM (SELECT unnest(['PENDING', 'RUNNING', 'FAILED', 'DONE', 'DEAD']) AS s) LEFT JOIN queue q ON q.status = s GROUP BY s", "queue")
def g10_status_counts(queue):
    return I.status_counts(queue)


@query("SELECT count(*) FILTER (WHERE created_at <= TIMESTAMP '1996-06-30') AS available, count(*) FILTER (WHERE created_at > TIMESTAMP '1996-06-30') AS deferred, count(*) FILTER (WHERE defer_reason LIKE 'l5:heavy%') AS heavy, count(*) FILTER (WHERE defer_reason IS NULL) AS fast FROM queue WHERE status = 'PENDING'", "queue")
def g11_pending_split(queue):
    return I.pending_split(queue, F.expr(NOW))


@query("SELECT max(age)::BIGINT AS max_age, count(*) AS n, quantile_disc(age, 0.95)::BIGINT AS p95_age FROM (SELECT greatest(0, date_diff('second', created_at, TIMESTAMP '1996-06-30')) AS age FROM queue WHERE status = 'PENDING')", "queue")
def g12_pending_age(queue):
    return I.pending_ages(queue, F.expr(NOW))


@query("SELECT coalesce(defer_reason, 'none') AS key, count(*) AS n FROM queue WHERE status = 'DEAD' GROUP BY 1 ORDER BY n DESC, key LIMIT 10", "queue")
def g13_drop_topk(queue):
    return I.top_counts(queue.where("status = 'DEAD'"), F.coalesce("defer_reason", F.lit("none")), 10)


@query("SELECT count(*) AS n FROM queue WHERE status = 'PENDING' AND defer_reason LIKE 'l5:heavy%'", "queue")
def g14_ignorable_heavy(queue):
    return queue.where("status = 'PENDING' and startswith(defer_reason, 'l5:heavy')").agg(F.count("*").alias("n"))


@query("SELECT *, CASE WHEN dead_bps > 1500 THEN 'critical' WHEN dead_bps > 500 THEN 'warn' ELSE 'ok' END AS state FROM (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'DEAD') AS dead, quantile_disc(latency_ms, 0.95) AS p95, floor(count(*) FILTER (WHERE status = 'DEAD') * 10000 / count(*))::BIGINT AS dead_bps FROM jobs WHERE ts >= TIMESTAMP '2024-01-01')", "jobs")
def g17_alert_window(jobs):
    return I.alert_window(jobs, F.expr("timestamp_ntz '2024-01-01 00:00:00'"))


@query("SELECT floor(count(*) FILTER (WHERE enrich_state <> 'PENDING') * 10000 / count(*))::BIGINT AS l2_bps, floor(count(*) FILTER (WHERE enrich_state IN ('LSP_READY', 'TOOL_READY')) * 10000 / count(*))::BIGINT AS l3_bps FROM files WHERE NOT is_deleted", "files")
def g18_coverage_bps(files):
    return files.where("not is_deleted").agg(C.basis_points(F.count_if(F.col("enrich_state") != "PENDING"), F.count("*")).alias("l2_bps"), C.basis_points(F.count_if(F.col("enrich_state").isin("LSP_READY", "TOOL_READY")), F.count("*")).alias("l3_bps"))


@query("""WITH t AS (SELECT lang, quality = 0 AS g, length(text) < 1000 AS f FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE f AND g) AS tp, count(*) FILTER (WHERE f AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT f) AS fn FROM t WHERE f OR g GROUP BY lang)
SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 100.0 ELSE 100.0 * tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 100.0 ELSE 100.0 * tp / (tp + fn) END, 6) AS recall FROM c""", "documents", "labels")
def g20_precision_recall(documents, labels):
    t = documents.join(labels, "doc_id").select("doc_id", "lang", "quality", F.length("text").alias("n"))
    return I.precision_recall(t.where("n < 1000"), t.where("quality = 0"), "doc_id", "lang")


@query("SELECT event_type, count(*) AS n, round(sum(latency_ms), 6) AS total, round(avg(latency_ms), 6) AS mean, max(latency_ms) AS longest, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM jobs GROUP BY 1", "jobs")
def g28_trace_percentiles(jobs):
    return I.trace_summary(jobs, ["event_type"])


@query("SELECT event_type, round(median(latency_ms), 6) AS median_ms, round(avg(CASE WHEN status = 'DONE' THEN 1.0 ELSE 0.0 END), 6) AS success FROM jobs GROUP BY 1", "jobs")
def g29_medians(jobs):
    p = exact_percentiles(jobs, ["event_type"], F.col("latency_ms"), {"p": 0.5}).select(F.col("event_type").alias("__event_type"), "p")
    t = jobs.groupBy("event_type").agg(F.avg(F.when(F.col("status") == "DONE", 1.0).otherwise(0.0)).alias("success"))
    return t.join(p, same(["event_type"], "__"), "left").select("event_type", F.round("p", 6).alias("median_ms"), F.round("success", 6).alias("success"))


@query("SELECT count(*) AS relations, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.symbol_key = e.to_symbol AND s.relative_path = e.relative_path)) AS orphans FROM edges e", "edges", "symbols")
def g33_graph_health(edges, symbols):
    return I.graph_health(edges, symbols)


@query("SELECT to_symbol, count(DISTINCT from_symbol) AS callers, count(DISTINCT relative_path) AS files, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(relative_path))), ',') AS paths FROM edges GROUP BY 1", "edges")
def g34_call_graph(edges):
    return I.call_graph(edges)


@query("SELECT to_symbol, fan_in FROM (SELECT to_symbol, count(DISTINCT repo_root || '::' || coalesce(caller_relative_path, relative_path)) AS fan_in FROM edges GROUP BY 1) ORDER BY fan_in DESC, to_symbol LIMIT 20", "edges")
def g35_top_symbols(edges):
    return S.fan_in(edges).orderBy(F.desc("fan_in"), "to_symbol").limit(20)


@query("SELECT e.repo_root, e.relative_path, e.from_symbol, e.to_symbol, e.line FROM edges e WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.symbol_key = e.to_symbol AND s.relative_path = e.relative_path)", "edges", "symbols")
def j06_orphan_edges(edges, symbols):
    return I.orphan_edges(edges, symbols).select("repo_root", "relative_path", "from_symbol", "to_symbol", "line")


@query("SELECT from_symbol, to_symbol, line FROM edges WHERE to_symbol IN (SELECT symbol_key FROM symbols WHERE kind = 'class')", "edges", "symbols")
def j07_scope_semi(edges, symbols):
    return edges.join(symbols.where("kind = 'class'").select(F.col("symbol_key").alias("to_symbol")), "to_symbol", "left_semi").select("from_symbol", "to_symbol", "line")


@query("SELECT p.repo_root || '/' || p.relative_path AS path, arg_max(r.root, length(r.root)) AS workspace FROM files p JOIN (SELECT DISTINCT repo_root AS root FROM files UNION SELECT DISTINCT repo_root || '/lib' FROM files) r ON starts_with(p.repo_root || '/' || p.relative_path, r.root || '/') GROUP BY 1", "files")
def j11_longest_prefix(files):
    roots = files.select(F.col("repo_root").alias("root")).distinct()
    roots = roots.union(roots.select(F.concat("root", F.lit("/lib"))))
    return I.longest_prefix(files.select(F.concat_ws("/", "repo_root", "relative_path").alias("path")), roots, "path", "root")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM jobs) WHERE n = 1", "jobs")
def n01_latest_row(jobs):
    return I.newest_per(jobs, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT content_hash, doc_id, repo_root FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY repo_root <> '/ws/src1', length(relative_path), doc_id) AS n FROM files) WHERE n = 1", "files")
def n02_cross_root_dedupe(files):
    return I.newest_per(files.select("content_hash", "doc_id", "repo_root", "relative_path"), ["content_hash"], F.col("repo_root") != "/ws/src1", F.length("relative_path"), "doc_id").select("content_hash", "doc_id", "repo_root")


@query("SELECT doc_id, lang, turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM files)", "files")
def n07_round_robin(files):
    return I.round_robin(files.select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", F.col("turn").cast("bigint").alias("turn"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM jobs", "jobs")
def n10_trailing_count(jobs):
    return trailing_count(jobs.select("event_id", "user_id", "ts"), ["user_id"], "ts", 3600, "n").drop("ts")


@query("SELECT event_id, user_id, round(sum(CASE event_type WHEN 'signup' THEN 1.25 WHEN 'purchase' THEN 1.5 ELSE 1.0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 6)::DOUBLE AS hotness FROM jobs", "jobs")
def n11_hotness(jobs):
    return I.hotness(jobs, "user_id", 86400, {"signup": 1.25, "purchase": 1.5})


@query("SELECT job_id, repo_root, priority, 'RUNNING' AS status FROM queue WHERE status = 'PENDING' ORDER BY priority DESC, created_at, job_id LIMIT 64", "queue")
def t01_acquire(queue):
    return I.acquire(queue, 64)


@query("SELECT job_id, repo_root, created_at FROM queue WHERE status = 'DEAD' ORDER BY created_at, job_id LIMIT 50", "queue")
def t02_dead_jobs(queue):
    return queue.where("status = 'DEAD'").orderBy("created_at", "job_id").limit(50).select("job_id", "repo_root", "created_at")


@query("SELECT from_symbol, to_symbol, coalesce(caller_relative_path, relative_path) AS path, line FROM edges WHERE to_symbol = 'sym_7' ORDER BY path, line, from_symbol LIMIT 100", "edges")
def h01_callers(edges):
    return I.callers(edges, "sym_7", 100)


@query("SELECT from_symbol, to_symbol, relative_path, line FROM edges WHERE from_symbol = 'fn_7' ORDER BY to_symbol, line LIMIT 100", "edges")
def h03_callees(edges):
    return I.callees(edges, "fn_7", 100)


@query("WITH r AS (SELECT symbol_key, parent_key AS at, 0 AS depth FROM symbols UNION ALL SELECT r.symbol_key, s.parent_key, r.depth + 1 FROM r JOIN symbols s ON s.symbol_key = r.at) SELECT symbol_key, max(depth)::BIGINT AS depth FROM r GROUP BY 1", "symbols")
def h08_symbol_depth(symbols):
    return I.symbol_depth(symbols)


@query("SELECT s.symbol_key, s.name, p.name AS container FROM symbols s LEFT JOIN symbols p ON p.symbol_key = s.parent_key", "symbols")
def h09_containers(symbols):
    return I.containers(symbols)


_FIELD = """SELECT doc_id, {0} AS field, len(w) AS len, len(list_filter(w, lambda x: x = 'and')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b FROM (SELECT doc_id, list_transform(regexp_extract_all({1}, '[0-9a-zA-Z_]+'), lambda x: lower(x)) AS w FROM files WHERE NOT is_deleted)"""
_BM25 = f"""WITH t AS ({_FIELD.format(1, 'text')} UNION ALL {_FIELD.format(2, 'relative_path')}),
s AS (SELECT field, count(*) AS n, avg(len) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t GROUP BY field),
k AS (SELECT doc_id, round(sum(CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END), 6) AS score FROM t JOIN s USING (field) WHERE a > 0 OR b > 0 GROUP BY doc_id)"""

_INDEXES: dict[tuple, S.Index] = {}


def _index(files):
    """The index of the live files, written once a session for the same files."""
    spark, live = files.sparkSession, files.where("not is_deleted")
    key = (spark.sparkContext.applicationId, live.semanticHash(), tuple(sorted(files.inputFiles())))
    if key not in _INDEXES:
        _INDEXES[key] = S.Index.write(live, "doc_id", ("text", "relative_path"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return _INDEXES[key]


@query(_BM25 + " SELECT doc_id, score FROM k ORDER BY score DESC, doc_id LIMIT 50", "files")
def k01_bm25(files):
    t = S.bm25(_index(files), "the and").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return S.top(t, 50, F.desc("score"), "doc_id")


_PATH = """(CASE WHEN list_has_any(string_split(lower(relative_path), '/'), ['src', 'app', 'core']) THEN 0.6 ELSE 0 END - CASE WHEN list_has_any(string_split(lower(relative_path), '/'), ['test', 'tests', 'build', 'dist']) THEN 0.7 ELSE 0 END
 + CASE WHEN regexp_matches(relative_path, '\\.(py|java)$') THEN 0.3 WHEN relative_path LIKE '%.lock' THEN -1.0 ELSE 0 END)::DOUBLE"""


@query(f"SELECT doc_id, round({_PATH}, 6) AS score FROM files", "files")
def k06_path_score(files):
    return files.select("doc_id", F.round(C.path_score(F.col("relative_path"), "the and"), 6).alias("score"))


@query("SELECT to_symbol, round((CASE kind WHEN 'class' THEN 600.0 WHEN 'function' THEN 500.0 WHEN 'interface' THEN 450.0 WHEN 'method' THEN 350.0 ELSE 0.0 END + 24 * count(DISTINCT repo_root || '::' || coalesce(caller_relative_path, e.relative_path)))::DOUBLE, 6) AS importance FROM edges e JOIN symbols s ON s.symbol_key = e.to_symbol GROUP BY to_symbol, kind", "edges", "symbols")
def k04_importance(edges, symbols):
    t = S.fan_in(edges).join(symbols.select(F.col("symbol_key").alias("to_symbol"), "kind"), "to_symbol")
    return t.select("to_symbol", F.round(C.kind_score(F.col("kind")) + 24 * F.col("fan_in"), 6).alias("importance"))


@query("SELECT symbol_key, round(least(5.0, 1.0 / (1.0 + greatest(0, depth)) + CASE WHEN parent_key IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(container_name), 'brand#1') THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS score FROM symbols", "symbols")
def k08_hierarchy(symbols):
    return symbols.select("symbol_key", F.round(C.hierarchy_score(F.col("depth"), F.col("parent_key"), F.col("container_name"), "Brand#1"), 6).alias("score"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT any_value(embedding)::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20", "embeddings")
def k10_cosine(embeddings):
    q = embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    t = embeddings.join(F.broadcast(q)).select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return t.orderBy(F.desc("similarity"), "vec_id").limit(20)


_CELL = "('0x' || substr(sha256({0}), 1, 8))::BIGINT % 128"


@query(_BM25 + f""", x AS (SELECT doc_id::VARCHAR AS id, k.score, repo_root, relative_path FROM k JOIN files f USING (doc_id)),
tx AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, 'file:' || id AS item, repo_root || '/' || relative_path AS label, {_PATH} AS base, 0.0::DOUBLE AS hierarchy FROM (SELECT * FROM x ORDER BY score DESC, id LIMIT 50)),
fi AS (SELECT to_symbol, count(DISTINCT repo_root || '::' || coalesce(caller_relative_path, relative_path)) AS n FROM edges GROUP BY 1),
im AS (SELECT s.*, (CASE kind WHEN 'class' THEN 600.0 WHEN 'function' THEN 500.0 WHEN 'interface' THEN 450.0 WHEN 'method' THEN 350.0 ELSE 0.0 END + 24 * coalesce(fi.n, 0))::DOUBLE AS base FROM symbols s LEFT JOIN fi ON fi.to_symbol = s.symbol_key WHERE contains(lower(name), 'widget') OR contains(lower(name), 'the') OR contains(lower(name), 'and')),
sy AS (SELECT row_number() OVER (ORDER BY base DESC, symbol_key) AS rank, 'symbol:' || symbol_key AS item, name AS label, base, least(5.0, 1.0 / (1.0 + greatest(0, depth)) + CASE WHEN parent_key IS NOT NULL THEN 0.2 ELSE 0 END)::DOUBLE AS hierarchy FROM (SELECT * FROM im ORDER BY base DESC, symbol_key LIMIT 50)),
i AS (SELECT *, round(1.0::DOUBLE / (60 + rank), 9) AS rrf, greatest(-200.0, least(200.0, ln(1 + abs(base)) * sign(base)))::DOUBLE AS imp FROM (SELECT * FROM tx UNION ALL SELECT * FROM sy)),
r AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, item) AS p FROM i),
q AS (SELECT cell, count(*) AS n FROM (SELECT {_CELL.format('w')} AS cell FROM (SELECT unnest(['the', 'and', 'widget']) AS w)) GROUP BY 1),
c AS (SELECT item, cell, count(*) AS n FROM (SELECT item, {_CELL.format('w')} AS cell FROM (SELECT item, unnest(regexp_extract_all(lower(label), '[a-zA-Z0-9_]+')) AS w FROM r WHERE p <= 20)) GROUP BY 1, 2),
v AS (SELECT item, round(coalesce(sum(c.n * q.n), 0) / sqrt(sum(c.n * c.n)) / (SELECT sqrt(sum(n * n)) FROM q), 6) AS v FROM c LEFT JOIN q USING (cell) GROUP BY item),
w AS (SELECT r.*, coalesce(v, 0)::DOUBLE AS vec FROM r LEFT JOIN v USING (item)),
b AS (SELECT *, round(0.55 * (CASE WHEN max(rrf) OVER () > min(rrf) OVER () THEN (rrf - min(rrf) OVER ()) / (max(rrf) OVER () - min(rrf) OVER ()) ELSE 0 END) + 0.30 * (CASE WHEN max(imp) OVER () > min(imp) OVER () THEN (imp - min(imp) OVER ()) / (max(imp) OVER () - min(imp) OVER ()) ELSE 0 END)
 + 0.15 * (CASE WHEN max(vec) OVER () > min(vec) OVER () THEN (vec - min(vec) OVER ()) / (max(vec) OVER () - min(vec) OVER ()) ELSE 0 END) + 0.15 * (CASE WHEN max(hierarchy) OVER () > min(hierarchy) OVER () THEN (hierarchy - min(hierarchy) OVER ()) / (max(hierarchy) OVER () - min(hierarchy) OVER ()) ELSE 0 END), 9) AS final FROM w)
SELECT item, label, round(rrf, 6) AS rrf, round(final, 6) AS final FROM b ORDER BY b.final DESC, p LIMIT 20""", "files", "symbols", "edges")
def search_ranked(files, symbols, edges):
    return S.search_ranked(_index(files), files, symbols, edges, "the and widget")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM jobs) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 3600 * 1000000::BIGINT", "jobs")
def r02_debounce(jobs):
    return I.debounce(jobs, "user_id", 3600)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (WHERE status = 'DEAD') AS dead FROM jobs GROUP BY 1", "jobs")
def r15_alert_buckets(jobs):
    return jobs.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "DEAD").alias("dead")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "dead")


@query("""SELECT *, CASE WHEN reads >= 25 OR read_lines >= 2500 THEN 'HARD_LIMIT' WHEN reads >= 20 OR read_lines >= 2000 THEN 'NEAR_LIMIT' ELSE 'OK' END AS state FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS searches, count(*) FILTER (WHERE role = 'assistant') AS reads,
sum(CASE WHEN role = 'assistant' THEN len(string_split(coalesce(text, ''), chr(10))) ELSE 0 END)::BIGINT AS read_lines FROM conversations GROUP BY conv_id)""", "conversations")
def r19_session_metrics(conversations):
    return I.session_metrics(conversations)


# --- point lookups, counts and trailing statistics


@query("SELECT doc_id, enrich_state, size_bytes FROM files WHERE repo_root = '/ws/src2' AND relative_path = 'app/core/es/doc_42.md'", "files")
def s15_point_lookup(files):
    return files.where("repo_root = '/ws/src2' and relative_path = 'app/core/es/doc_42.md'").select("doc_id", "enrich_state", "size_bytes")


@query("SELECT repo_root, relative_path, is_deleted FROM files WHERE scope_repo_root = '/ws' AND relative_path LIKE 'src/en/%' ORDER BY is_deleted, doc_id DESC LIMIT 10", "files")
def s16_scope_candidates(files):
    return files.where("scope_repo_root = '/ws' and startswith(relative_path, 'src/en/')").orderBy("is_deleted", F.desc("doc_id")).limit(10).select("repo_root", "relative_path", "is_deleted")


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, array_to_string(string_split(text, chr(10))[3:5], chr(10)) AS part FROM files WHERE NOT is_deleted", "files")
def s18_line_range(files):
    lines = F.split("text", "\n")
    return files.where("not is_deleted").select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.array_join(F.slice(lines, 3, 3), "\n").alias("part"))


@query("SELECT language, round(n * w, 6)::DOUBLE AS score FROM (SELECT CASE lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' ELSE 'other' END AS language, count(*) AS n FROM files GROUP BY 1) JOIN (VALUES ('python', 1.2), ('java', 1.5)) v(language, w) USING (language) ORDER BY score DESC LIMIT 2", "files")
def s27_language_ranking(files):
    weights = files.sparkSession.createDataFrame([("python", 1.2), ("java", 1.5)], "language string, w double")
    n = files.groupBy(C.language_of(F.col("relative_path")).alias("language")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(weights), "language").select("language", F.round(F.col("n") * F.col("w"), 6).alias("score")).orderBy(F.desc("score")).limit(2)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE scope_repo_root = '/ws') AS in_scope FROM files WHERE NOT is_deleted", "files")
def g04_live_counts(files):
    return files.where("not is_deleted").agg(F.count("*").alias("n"), F.count_if(F.col("scope_repo_root") == "/ws").alias("in_scope"))


@query("SELECT enrich_state = 'TOOL_READY' AS ready, count(*) AS n FROM files GROUP BY 1", "files")
def g15_readiness(files):
    return files.groupBy((F.col("enrich_state") == "TOOL_READY").alias("ready")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(avg(latency_ms) FILTER (WHERE user_id % 2 = 0), 6) AS a, round(avg(latency_ms) FILTER (WHERE user_id % 2 = 1), 6) AS b,
round(avg(latency_ms) FILTER (WHERE user_id % 2 = 1) - avg(latency_ms) FILTER (WHERE user_id % 2 = 0), 6) AS delta FROM jobs GROUP BY 1""", "jobs")
def g25_case_deltas(jobs):
    a, b = (F.avg(F.when(F.col("user_id") % 2 == i, F.col("latency_ms"))) for i in (0, 1))
    return jobs.groupBy("event_type").agg(F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(b - a, 6).alias("delta"))


@query("""WITH m AS (SELECT event_type, avg(latency_ms) FILTER (WHERE user_id % 2 = 0) AS base, avg(latency_ms) FILTER (WHERE user_id % 2 = 1) AS cand FROM jobs GROUP BY 1)
SELECT event_type, CASE WHEN base > 0 THEN round_even((base - cand) / base * 10000, 0) ELSE 0 END::BIGINT AS bps, CASE WHEN base > 0 THEN round_even((base - cand) / base * 10000, 0) ELSE 0 END > 500 AS fails FROM m""", "jobs")
def g27_regression_bps(jobs):
    base, cand = (F.avg(F.when(F.col("user_id") % 2 == i, F.col("latency_ms"))) for i in (0, 1))
    t = jobs.groupBy("event_type").agg(base.alias("base"), cand.alias("cand")).withColumn("bps", C.regression_bps(F.col("base"), F.col("cand")))
    return t.select("event_type", "bps", (F.col("bps") > 500).alias("fails"))


@query("""SELECT lang, count(*) AS n, round(100.0 * count(*) FILTER (WHERE enrich_state = 'TOOL_READY') / count(*), 6)::DOUBLE AS available_pct, 100.0 * count(*) FILTER (WHERE enrich_state = 'TOOL_READY') / count(*) >= 98 AS passes FROM files GROUP BY lang""", "files")
def g30_language_matrix(files):
    pct = 100.0 * F.count_if(F.col("enrich_state") == "TOOL_READY") / F.count("*")
    return files.groupBy("lang").agg(F.count("*").alias("n"), F.round(pct.cast("double"), 6).alias("available_pct"), (pct >= 98).alias("passes"))


@query("SELECT content_hash, CASE WHEN count(DISTINCT repo_root) = 1 THEN min(repo_root) END AS root FROM files WHERE NOT is_deleted GROUP BY 1", "files")
def j05_effective_root(files):
    return files.where("not is_deleted").groupBy("content_hash").agg(F.when(F.countDistinct("repo_root") == 1, F.min("repo_root")).alias("root"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')", "orders", "customer")
def j08_integrity(orders, customer):
    return orders.select("o_orderkey", "o_custkey").join(customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


@query("SELECT name, min(symbol_key) AS symbol_key FROM (SELECT name || ':' || line % 997 AS name, symbol_key FROM symbols) GROUP BY name HAVING count(DISTINCT symbol_key) = 1", "symbols")
def w10_name_map(symbols):
    from tessera.operators.merge import unambiguous

    return unambiguous(symbols.withColumn("name", F.concat("name", F.lit(":"), F.col("line") % 997)), "name", "symbol_key")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM jobs GROUP BY 1", "jobs")
def w19_coalesce_changes(jobs):
    from tessera.operators.merge import coalesce_changes

    return coalesce_changes(jobs.select("user_id", "event_id", "event_type", F.col("event_id").alias("seq")), ["user_id"], "seq").drop("seq")


@query("SELECT event_id, ts FROM jobs WHERE status = 'DEAD' ORDER BY ts DESC, event_id DESC LIMIT 40", "jobs")
def w21_prune_events(jobs):
    from tessera.operators.merge import prune

    return prune(jobs.where("status = 'DEAD'"), F.lit(True), 40, F.desc("ts"), F.desc("event_id")).select("event_id", "ts")


@query("""SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'upsert' WHEN a.doc_id IS NULL THEN 'delete' ELSE 'upsert' END AS change FROM (SELECT doc_id, size_bytes FROM files WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, size_bytes + (doc_id % 3 = 0)::INT AS size_bytes FROM files WHERE doc_id % 7 <> 0) b USING (doc_id)
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.size_bytes <> b.size_bytes""", "files")
def w27_sync_plan(files):
    from tessera.operators.merge import sync_plan

    found = files.where("doc_id % 5 <> 0").select("doc_id", "size_bytes")
    indexed = files.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"))
    return sync_plan(found, indexed, ["doc_id"], ["size_bytes"])


@query("""SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, count(*) AS lists FROM (SELECT doc_id, row_number() OVER (ORDER BY size_bytes DESC, doc_id) AS rank FROM (SELECT * FROM files ORDER BY size_bytes DESC, doc_id LIMIT 30)
UNION ALL SELECT doc_id, row_number() OVER (ORDER BY content_hash, doc_id) FROM (SELECT * FROM files ORDER BY content_hash, doc_id LIMIT 30)) GROUP BY doc_id""", "files")
def k02_rrf(files):
    slim = files.select("doc_id", "size_bytes", "content_hash")
    a = S.ranked(S.top(slim, 30, F.desc("size_bytes"), "doc_id"), "rank", F.desc("size_bytes"), "doc_id")
    b = S.ranked(S.top(slim, 30, "content_hash", "doc_id"), "rank", "content_hash", "doc_id")
    return S.fuse_rrf([a, b], "doc_id").withColumn("rrf", F.round("rrf", 9))


@query("""WITH h AS (SELECT to_symbol, count(DISTINCT repo_root || '::' || coalesce(caller_relative_path, relative_path)) AS n FROM edges GROUP BY 1), t AS (SELECT * FROM h ORDER BY n DESC, to_symbol LIMIT 100)
SELECT to_symbol, n AS fan_in, round(CASE WHEN max(n) OVER () > min(n) OVER () THEN (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) ELSE 0 END::DOUBLE, 6) AS norm, round(ln(1 + n), 6) AS log_norm FROM t""", "edges")
def n05_normalised(edges):
    t = S.fan_in(edges).orderBy(F.desc("fan_in"), "to_symbol").limit(100)
    return t.select("to_symbol", "fan_in", F.round(S.minmax("fan_in").cast("double"), 6).alias("norm"), F.round(F.log1p("fan_in"), 6).alias("log_norm"))


@query("SELECT repo_root, lang, min(doc_id) AS first_seen, count(*) AS n FROM files GROUP BY 1, 2", "files")
def n08_stable_groups(files):
    return files.groupBy("repo_root", "lang").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id, latency_ms, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM jobs WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(sum(pow(0.8, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.2 END * latency_ms), 6) AS ema FROM t GROUP BY 1""", "jobs")
def n09_ema(jobs):
    from tessera.operators.merge import ema

    return ema(jobs, "user_id", "event_id", "latency_ms").withColumn("ema", F.round("ema", 6))


@query("SELECT to_symbol, from_symbol, 'lsp' AS origin, line FROM edges WHERE confidence >= 0.05 UNION ALL SELECT to_symbol, from_symbol, 'semantic', line FROM edges e WHERE confidence < 0.05 AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.to_symbol = e.to_symbol AND x.confidence >= 0.05)", "edges")
def h05_callers_by_source(edges):
    strong, weak = edges.where("confidence >= 0.05"), edges.where("confidence < 0.05")
    rest = weak.join(strong.select("to_symbol").distinct(), "to_symbol", "left_anti")
    pick = lambda df, name: df.select("to_symbol", "from_symbol", F.lit(name).alias("origin"), "line")
    return pick(strong, "lsp").unionByName(pick(rest, "semantic"))


@query("SELECT event_type, CASE event_type WHEN 'error' THEN 'FATAL' ELSE 'RECOVERABLE' END AS severity, count(*) AS n FROM jobs GROUP BY 1, 2", "jobs")
def k15_error_severity(jobs):
    return jobs.groupBy("event_type", F.when(F.col("event_type") == "error", "FATAL").otherwise("RECOVERABLE").alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs FROM pages", "pages")
def e02_page_outline(pages):
    return pages.select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"))


@query("""WITH k AS (SELECT lang, content_hash, min(doc_id) AS seen FROM files GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY seen DESC, content_hash DESC) AS n FROM k)
SELECT lang, count(*) AS items, sha256(string_agg(content_hash, ',' ORDER BY seen, content_hash)) AS bundle_id FROM r WHERE n <= 128 GROUP BY 1""", "files")
def r21_bundle_items(files):
    return L.bundle(files, "lang", "doc_id", "content_hash")
