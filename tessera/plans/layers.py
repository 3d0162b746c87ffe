"""Queries over layers, call edges, callers, write-side de-duplication, admission and reports, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import layers as Y
from tessera.operators import lifecycle as L
from tessera.operators import merge as M
from tessera.operators import search as S
from tessera.operators.running import trailing_count
from tessera.plans.registry import query

_ON = "f.repo_root = {0}.repo_root AND f.relative_path = {0}.relative_path AND f.content_hash = {0}.content_hash"


# --- layers at a content hash


@query(f"SELECT f.repo_root, f.relative_path, q.confidence FROM files f JOIN l4 q ON {_ON.format('q')} WHERE NOT f.is_deleted", "files", "l4")
def j01_live_layer_join(files, l4):
    return files.where("not is_deleted").select(*Y.FILE).join(l4.select(*Y.FILE, "confidence"), Y.FILE).select("repo_root", "relative_path", "confidence")


_UPGRADE = f"""FROM files f JOIN l4 q ON {_ON.format('q')} LEFT JOIN l5 s ON {_ON.format('s')} LEFT JOIN ready t ON {_ON.format('t')}
LEFT JOIN (SELECT repo_root, relative_path, content_hash, count(*) AS n FROM calls GROUP BY ALL) c ON {_ON.format('c')}
WHERE NOT f.is_deleted AND (s.repo_root IS NULL OR (coalesce(try_cast(s.relations AS INTEGER), 0) > 0 AND (t.repo_root IS NULL OR NOT t.callers_ready OR coalesce(c.n, 0) = 0)))"""


@query(f"SELECT f.repo_root, f.relative_path, q.confidence {_UPGRADE} AND f.repo_root = '/ws/src2' ORDER BY q.confidence, f.relative_path LIMIT 50", "files", "l4", "l5", "ready", "calls")
def j02_upgrade_candidates(files, l4, l5, ready, calls):
    found = Y.upgrade_candidates(files.where("repo_root = '/ws/src2'"), l4, l5, ready, calls)
    return found.orderBy("confidence", "relative_path").limit(50).select("repo_root", "relative_path", "confidence")


@query(f"SELECT f.repo_root, count(*) AS n {_UPGRADE} GROUP BY 1", "files", "l4", "l5", "ready", "calls")
def j03_upgrade_count(files, l4, l5, ready, calls):
    return Y.upgrade_candidates(files, l4, l5, ready, calls).groupBy("repo_root").agg(F.count("*").alias("n"))


@query(f"""SELECT f.repo_root, f.relative_path, q.confidence, s.reasons FROM files f LEFT JOIN l4 q ON {_ON.format('q')}
LEFT JOIN (SELECT repo_root, relative_path, content_hash, string_agg(reason_code, ',' ORDER BY reason_code) AS reasons FROM l5 GROUP BY ALL) s ON {_ON.format('s')} WHERE NOT f.is_deleted""", "files", "l4", "l5")
def j04_effective_snapshot(files, l4, l5):
    return Y.snapshot(files, l4, l5).select("repo_root", "relative_path", "confidence", "reasons")


@query(f"SELECT s.repo_root, s.relative_path, s.reason_code FROM l5 s WHERE EXISTS (SELECT 1 FROM files f WHERE {_ON.format('s')} AND NOT f.is_deleted)", "l5", "files")
def w14_drop_stale_l5(l5, files):
    return Y.drop_stale(l5, files).select("repo_root", "relative_path", "reason_code")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN a.confidence ELSE b.confidence END AS confidence FROM (SELECT doc_id, confidence FROM l4) a FULL JOIN (SELECT doc_id, 0.5::DOUBLE AS confidence FROM files WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id""", "l4", "files")
def w12_layer_upsert(l4, files):
    return M.upsert(l4.select("doc_id", "confidence"), files.where("doc_id % 2 = 0").select("doc_id", F.lit(0.5).alias("confidence")), ["doc_id"])


@query("SELECT repo_root, relative_path, reason_code, content_hash = 'older' AS stale FROM l5 WHERE NOT EXISTS (SELECT 1 FROM ready t WHERE t.repo_root = l5.repo_root AND t.relative_path = l5.relative_path AND t.content_hash = l5.content_hash)", "l5", "ready")
def b20_layers_without_readiness(l5, ready):
    return l5.join(ready.select(*Y.FILE), Y.FILE, "left_anti").select("repo_root", "relative_path", "reason_code", (F.col("content_hash") == "older").alias("stale"))


@query(f"""SELECT f.doc_id, symbol, q.confidence FROM (SELECT * FROM (SELECT doc_id, repo_root, relative_path, content_hash, text, n FROM (SELECT *, row_number() OVER (ORDER BY doc_id DESC) AS n FROM files WHERE NOT is_deleted) WHERE n <= 500)) f
LEFT JOIN l4 q ON {_ON.format('q')}, unnest(string_split(f.text, ' ')[1:4]) u(symbol) WHERE contains(lower(symbol), 'an') ORDER BY f.doc_id DESC, symbol LIMIT 60""", "files", "l4")
def f02_symbol_search(files, l4):
    """The newest files' symbols, exploded, whose name holds the query, with what L4 says of their file's hash."""
    newest = files.where("not is_deleted").orderBy(F.desc("doc_id")).limit(500).select(*Y.FILE, "doc_id", F.explode(F.slice(F.split("text", " "), 1, 4)).alias("symbol"))
    hit = newest.where(C.contains_ci(F.col("symbol"), "an")).orderBy(F.desc("doc_id"), "symbol").limit(60)
    return hit.join(l4.select(*Y.FILE, "confidence"), Y.FILE, "left").select("doc_id", "symbol", "confidence")


@query(f"""SELECT i.to_symbol, q.confidence, q.degraded FROM (SELECT to_symbol, repo_root, relative_path, content_hash FROM calls WHERE line < 10) i LEFT JOIN l4 q ON i.repo_root = q.repo_root AND i.relative_path = q.relative_path AND i.content_hash = q.content_hash""", "calls", "l4")
def j15_item_with_layer(calls, l4):
    return calls.where("line < 10").select("to_symbol", *Y.FILE).join(l4.select(*Y.FILE, "confidence", "degraded"), Y.FILE, "left").select("to_symbol", "confidence", "degraded")


# --- callers


@query("SELECT from_symbol, to_symbol, relative_path, line, confidence FROM calls WHERE to_symbol = 'run_job' ORDER BY confidence DESC, relative_path, line LIMIT 40", "calls")
def h04_semantic_callers(calls):
    return calls.where("to_symbol = 'run_job'").orderBy(F.desc("confidence"), "relative_path", "line").limit(40).select("from_symbol", "to_symbol", "relative_path", "line", "confidence")


@query("""WITH s AS (SELECT container_name AS spec, unnest([kind, split_part(name, ' ', 1)]) AS base, symbol_key FROM symbols)
SELECT DISTINCT s.spec, p.kind AS protocol FROM s JOIN (SELECT DISTINCT kind FROM symbols WHERE kind LIKE 'i%') p ON p.kind = s.base""", "symbols")
def j18_nominal_match(symbols):
    bases = symbols.select(F.col("container_name").alias("spec"), F.explode(F.array("kind", F.split_part("name", F.lit(" "), F.lit(1)))).alias("protocol")).distinct()
    return bases.join(symbols.where("startswith(kind, 'i')").select(F.col("kind").alias("protocol")).distinct(), "protocol", "left_semi").select("spec", "protocol")


@query("""SELECT item_id, w AS to_symbol, 'token_reference' AS evidence_type, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text, '[0-9a-zA-Z_]+')) AS w FROM benchmark) WHERE w IN (SELECT split_part(name, ' ', 1) FROM symbols UNION SELECT 'the' UNION SELECT 'and') GROUP BY ALL""", "benchmark", "symbols")
def h11_token_references(benchmark, symbols):
    names = symbols.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("to_symbol")).union(symbols.sparkSession.createDataFrame([("the",), ("and",)], "to_symbol string")).distinct()
    tokens = benchmark.select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9a-zA-Z_]+"), F.lit(0))).alias("to_symbol"))
    return tokens.groupBy("item_id", "to_symbol").agg(F.count("*").alias("n")).join(names, "to_symbol", "left_semi").select("item_id", "to_symbol", F.lit("token_reference").alias("evidence_type"), "n")


@query("""SELECT to_symbol, to_symbol || CASE WHEN contains(to_symbol, '::') THEN '|' || split_part(to_symbol, '::', -1) ELSE '' END || CASE WHEN contains(to_symbol, '.') THEN '|' || split_part(to_symbol, '.', -1) ELSE '' END AS names FROM (SELECT DISTINCT to_symbol FROM calls)""", "calls")
def v07_base_names(calls):
    t = calls.select("to_symbol").distinct()
    return t.select("to_symbol", F.array_join(C.base_names(F.col("to_symbol")), "|").alias("names"))


@query("SELECT DISTINCT to_symbol FROM calls WHERE split_part(to_symbol, '.', -1) IN ('src0', 'src4')", "calls")
def v08_target_match(calls):
    return calls.select("to_symbol").distinct().where(C.matches_target(F.col("to_symbol"), ["src0", "other.src4"]))


# --- writes


@query("""SELECT symbol_key, name, kind, line, end_line, position FROM (SELECT *, row_number() OVER (PARTITION BY symbol_key, CASE WHEN symbol_key IS NULL THEN name END, CASE WHEN symbol_key IS NULL THEN kind END, CASE WHEN symbol_key IS NULL THEN line END, CASE WHEN symbol_key IS NULL THEN end_line END ORDER BY position) AS n FROM (
  SELECT CASE WHEN line % 3 = 0 THEN symbol_key END AS symbol_key, name, kind, line, line + depth AS end_line, 2 * line AS position FROM symbols UNION ALL SELECT CASE WHEN line % 3 = 0 THEN symbol_key END, name, kind, line, line + CASE WHEN line % 2 = 0 THEN depth ELSE 9 END, 2 * line + 1 FROM symbols)) WHERE n = 1""", "symbols")
def w08_dedupe_symbols(symbols):
    """The first of each key by position in the delivery; symbols without a key by name, kind, line and end. Every symbol comes twice, some of them with
    another end: those without a key are overloads and stay."""
    key = F.when(F.col("line") % 3 == 0, F.col("symbol_key")).alias("symbol_key")
    side = lambda end, at: symbols.select(key, "name", "kind", "line", (F.col("line") + end).alias("end_line"), (2 * F.col("line") + at).alias("position"))
    rows = side(F.col("depth"), 0).unionAll(side(F.when(F.col("line") % 2 == 0, F.col("depth")).otherwise(9), 1))
    loose = [F.when(F.col("symbol_key").isNull(), F.col(c)) for c in ("name", "kind", "line", "end_line")]
    return Y.first_of_each(rows, [F.col("symbol_key"), *loose], "position")


@query("SELECT DISTINCT from_symbol, to_symbol, line, caller_relative_path FROM edges", "edges")
def w09_dedupe_relations(edges):
    return edges.select("from_symbol", "to_symbol", "line", "caller_relative_path").distinct()


@query("SELECT doc_id, CASE WHEN lang = 'en' OR r.name IS NULL OR r.name IS NOT DISTINCT FROM lang THEN lang ELSE r.name END AS label, lang IS DISTINCT FROM CASE WHEN lang = 'en' OR r.name IS NULL THEN lang ELSE r.name END AS changed FROM files LEFT JOIN (SELECT '/ws/src' || r_regionkey AS root, r_name AS name FROM region) r ON r.root = repo_root", "files", "region")
def w04_identity_sync(files, region):
    names = region.select(F.concat(F.lit("/ws/src"), "r_regionkey").alias("repo_root"), F.col("r_name").alias("new"))
    label = F.when((F.col("lang") == "en") | F.col("new").isNull(), F.col("lang")).otherwise(F.col("new"))
    return files.select("repo_root", "doc_id", "lang").join(names, "repo_root", "left").select("doc_id", label.alias("label"), (~F.col("lang").eqNullSafe(label)).alias("changed"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN -o_custkey ELSE c.c_custkey END AS repo_id, o_custkey % 4 = 0 AND c.c_custkey IS NOT NULL AS filled FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey", "orders", "customer")
def w30_backfill_ids(orders, customer):
    """A missing id (every fourth customer's) is taken from the registry, one that is there stays; rows that the registry does not know stay without."""
    stored = F.when(F.col("o_custkey") % 4 > 0, -F.col("o_custkey"))
    rows = orders.select("o_orderkey", "o_custkey", stored.alias("repo_id"))
    missing = rows.where("repo_id is null").join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("known")), "o_custkey", "left")
    there = rows.where("repo_id is not null").select("o_orderkey", "repo_id", F.lit(False).alias("filled"))
    return there.unionByName(missing.select("o_orderkey", F.col("known").alias("repo_id"), F.col("known").isNotNull().alias("filled")))


@query("SELECT v.vec_id, CASE WHEN v.vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS model, len(embedding) AS dim FROM embeddings v WHERE v.vec_id % 3 = 0 OR v.vec_id % 5 = 0", "embeddings")
def w16_embedding_upsert(embeddings):
    side = lambda d, name: embeddings.where(F.col("vec_id") % d == 0).select("vec_id", F.lit(name).alias("model"), F.size("embedding").cast("bigint").alias("dim"))
    return M.upsert(side(5, "old"), side(3, "new"), ["vec_id"])


@query("""SELECT job_id, 'PENDING' AS status, CASE WHEN job_id % 4 < 2 THEN 'repo' ELSE 'workspace' END AS scope_level, CASE WHEN job_id % 4 = 1 THEN repo_root || '/src' ELSE repo_root END AS scope_root, (job_id % 3 + 1)::INTEGER AS scope_attempts, TIMESTAMP '1996-06-30 00:00:30' AS next_retry_at, NULL::VARCHAR AS defer_reason
FROM queue WHERE status = 'FAILED' AND job_id % 4 < 3 AND job_id % 3 < 2 AND job_id % 7 <> 3 AND job_id % 7 <> 4""", "queue")
def q07_scope_escalation(queue):
    """Failed jobs with errors of seven kinds at four scopes, after up to two attempts."""
    id_ = F.col("job_id")
    texts = ["[ERR_LSP_FILE_NOT_IN_SCOPE] x", "ERR_CONFIG_INVALID: y", "LSP: No workspace contains this", "soft limit of lsp", "anything else", "the Scope Root is odd", "[err_lsp_document_symbol_failed] Project not found"]
    failed = queue.where("status = 'FAILED'").select("job_id", "repo_root", F.when(id_ % 2 == 1, "src/in/m.py").otherwise("m.py").alias("relative_path"), F.element_at(F.array(F.lit(None), F.lit("module"), F.lit(" Repo"), F.lit("workspace")), (id_ % 4 + 1).cast("int")).alias("scope_level"),
                                                     (id_ % 3).cast("int").alias("scope_attempts"), F.element_at(F.array(*map(F.lit, texts)), (id_ % 7 + 1).cast("int")).alias("message"))
    return L.escalate_scope(failed, F.expr("timestamp_ntz '1996-06-30 00:00:00'"), 30)


@query("SELECT job_id, greatest(created_at, TIMESTAMP '1996-06-30' + INTERVAL 30 SECOND) AS next_retry_at FROM queue WHERE status = 'PENDING'", "queue")
def q08_min_defer(queue):
    return queue.where("status = 'PENDING'").select("job_id", F.greatest("created_at", F.expr("timestamp_ntz '1996-06-30 00:00:30'")).alias("next_retry_at"))


@query("SELECT job_id, greatest(priority, 45) AS priority, 'L3' AS stage FROM queue WHERE status = 'PENDING' AND defer_reason IS NULL", "queue")
def q04_promote(queue):
    return queue.where("status = 'PENDING' and defer_reason is null").select("job_id", F.greatest("priority", F.lit(45)).alias("priority"), F.lit("L3").alias("stage"))


@query("SELECT job_id FROM queue WHERE status = 'PENDING' AND defer_reason LIKE 'l5:heavy%' ORDER BY job_id LIMIT 256", "queue")
def t03_ignorable_ids(queue):
    return queue.where("status = 'PENDING' and startswith(defer_reason, 'l5:heavy')").orderBy("job_id").limit(256).select("job_id")


@query("SELECT event_id, user_id FROM jobs WHERE status = 'DONE' ORDER BY event_id LIMIT 64", "jobs")
def t04_pending_changes(jobs):
    return jobs.where("status = 'DONE'").orderBy("event_id").limit(64).select("event_id", "user_id")


@query("SELECT count(*) AS n, count(*) > 0 AS any FROM jobs WHERE status = 'DONE'", "jobs")
def g16_pending_changes(jobs):
    return jobs.where("status = 'DONE'").agg(F.count("*").alias("n")).select("n", (F.col("n") > 0).alias("any"))


@query("SELECT scope_repo_root, count(*) AS n FROM files WHERE NOT is_deleted GROUP BY 1", "files")
def g05_live_by_scope(files):
    return files.where("not is_deleted").groupBy("scope_repo_root").agg(F.count("*").alias("n"))


@query("SELECT job_id, CASE WHEN f.doc_id IS NULL THEN 'MISSING' WHEN f.is_deleted THEN 'DELETED' WHEN f.enrich_state = 'FAILED' THEN 'FAILED' ELSE 'BODY_READY' END AS outcome FROM queue q LEFT JOIN files f ON f.doc_id = q.job_id WHERE status = 'PENDING'", "queue", "files")
def q17_job_outcome(queue, files):
    t = queue.where("status = 'PENDING'").select("job_id").join(files.select(F.col("doc_id").alias("job_id"), "is_deleted", "enrich_state"), "job_id", "left")
    return t.select("job_id", F.when(F.col("is_deleted").isNull(), "MISSING").when(F.col("is_deleted"), "DELETED").when(F.col("enrich_state") == "FAILED", "FAILED").otherwise("BODY_READY").alias("outcome"))


@query("""SELECT doc_id, confidence, round(1 - confidence, 6) AS ambiguity, coverage FROM (SELECT doc_id, CASE WHEN d IS NOT NULL AND NOT degraded AND d = 'L3_ONLY' THEN 0.9 ELSE 0.35 END::DOUBLE AS confidence, CASE WHEN d = 'DEFERRED_HEAVY' THEN 0.0 WHEN degraded THEN 0.6 ELSE 1.0 END::DOUBLE AS coverage
FROM (SELECT doc_id, doc_id % 7 = 0 AS degraded, CASE WHEN size_bytes > 8000 THEN 'DEFERRED_HEAVY' WHEN doc_id % 5 > 0 THEN 'L3_ONLY' ELSE 'NEEDS_L5' END AS d FROM files))""", "files")
def q16_l4_confidence(files):
    d = F.when(F.col("size_bytes") > 8000, "DEFERRED_HEAVY").when(F.col("doc_id") % 5 > 0, "L3_ONLY").otherwise("NEEDS_L5")
    t = files.select("doc_id", (F.col("doc_id") % 7 == 0).alias("degraded"), d.alias("d"))
    t = t.withColumn("confidence", F.when(~F.col("degraded") & (F.col("d") == "L3_ONLY"), 0.9).otherwise(0.35))
    return t.select("doc_id", "confidence", F.round(1 - F.col("confidence"), 6).alias("ambiguity"), F.when(F.col("d") == "DEFERRED_HEAVY", 0.0).when(F.col("degraded"), 0.6).otherwise(1.0).alias("coverage"))


# --- admission


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN 'reason_missing' WHEN user_id % 11 = 0 THEN 'policy_disabled' WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'mode_not_allowed' WHEN user_id % 2 = 1 AND user_id % 7 = 0 THEN 'unknown_batch_index_build_blocked'
WHEN user_id % 13 = 0 THEN 'cooldown_active' WHEN user_id % 2 = 0 AND total >= 0.95 * 3 AND batch <= 0.1 * 20 THEN 'starvation_guard_call_reserve' WHEN total > 3 THEN 'pressure_rate_exceeded' WHEN user_id % 2 = 1 AND batch > 20 THEN 'pressure_rate_exceeded' END AS refused
FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS total, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS batch FROM jobs)""", "jobs")
def r10_admission(jobs):
    t = trailing_count(trailing_count(jobs, ["user_id"], "ts", 86400, "total_rate"), ["user_id", "event_type"], "ts", 86400, "batch_rate")
    batch = F.col("user_id") % 2 == 1
    t = t.withColumns({"reason": F.when(F.col("event_type") != "signup", F.col("event_type")), "enabled": F.col("user_id") % 11 != 0, "allowed": batch | (F.col("event_type") != "error"), "known": F.col("user_id") % 7 != 0, "mode": F.when(batch, "batch").otherwise("interactive"), "cooling": F.col("user_id") % 13 == 0})
    return Y.admission(t, 3, 20).select("event_id", "refused")


@query("""WITH e AS (SELECT event_id, user_id % 3 AS language, epoch_us(ts) AS s, (CASE event_type WHEN 'error' THEN 30 WHEN 'click' THEN 10 WHEN 'view' THEN 20 ELSE 15 END) * 1000000::BIGINT AS w, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS i FROM jobs WHERE user_id < 60),
r AS (SELECT event_id, language, i, s + w AS until FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.language, e.i, greatest(e.s, r.until) + e.w FROM r JOIN e ON e.language = r.language AND e.i = r.i + 1)
SELECT event_id, language, until FROM r""", "jobs")
def r11_language_cooldown(jobs):
    wait = F.when(F.col("event_type") == "error", 30).when(F.col("event_type") == "click", 10).when(F.col("event_type") == "view", 20).otherwise(15).cast("bigint")
    return Y.language_cooldown(jobs.where("user_id < 60").withColumn("language", F.col("user_id") % 3), "language", "ts", wait)


@query("SELECT event_id, user_id % 2 = 0 AND n >= 0.95 * 4 AND b <= 2 AS starving FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id) AS b FROM jobs)", "jobs")
def r12_starvation(jobs):
    n = jobs.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("b"))
    return jobs.select("event_id", "user_id").join(n, "user_id").select("event_id", ((F.col("user_id") % 2 == 0) & (F.col("n") >= 0.95 * 4) & (F.col("b") <= 2)).alias("starving"))


@query("SELECT l_orderkey, l_linenumber, greatest(1, round_even(greatest(1.0::DOUBLE, l_quantity) * greatest(0.1::DOUBLE, least(10.0::DOUBLE, l_discount * 20)) * greatest(0.1::DOUBLE, least(10.0::DOUBLE, l_tax * 10)), 0))::BIGINT AS cost FROM lineitem", "lineitem")
def r13_effective_cost(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", Y.effective_cost(F.col("l_quantity"), F.col("l_discount") * 20, F.col("l_tax") * 10).alias("cost"))


# --- errors


_MESSAGE = "CASE event_id % 8 WHEN 0 THEN 'lsp [err_rpc_timeout] late' WHEN 1 THEN 'ERR_CONFIG_INVALID: no model' WHEN 2 THEN 'LSP soft limit reached' WHEN 3 THEN 'no workspace contains the file' WHEN 4 THEN 'project model missing' WHEN 5 THEN 'lsp slot exhausted' WHEN 6 THEN 'other [note] text' ELSE 'project not found' END"


@query(f"""SELECT event_id, code, CASE WHEN code IN ('ERR_LSP_SERVER_MISSING', 'ERR_LSP_SERVER_SPAWN_FAILED', 'ERR_RUNTIME_MISMATCH', 'ERR_CONFIG_INVALID', 'ERR_LSP_WORKSPACE_MISMATCH') THEN 'PERMANENT_UNAVAILABLE' ELSE 'TRANSIENT_FAIL' END AS kind FROM (
SELECT event_id, CASE WHEN starts_with(upper(trim(regexp_extract(m, '^[^\\[]*\\[([^\\]]*)\\]', 1))), 'ERR_') THEN upper(trim(regexp_extract(m, '^[^\\[]*\\[([^\\]]*)\\]', 1))) WHEN starts_with(m, 'ERR_') THEN trim(split_part(m, ':', 1)) WHEN contains(lower(m), 'soft limit') AND contains(lower(m), 'lsp') THEN 'ERR_LSP_GLOBAL_SOFT_LIMIT'
WHEN contains(lower(m), 'slot exhausted') AND contains(lower(m), 'lsp') THEN 'ERR_LSP_SLOT_EXHAUSTED' WHEN contains(lower(m), 'workspace contains') AND contains(lower(m), 'no ') THEN 'ERR_LSP_WORKSPACE_MISMATCH' WHEN contains(lower(m), 'project model missing') THEN 'ERR_CONFIG_INVALID' WHEN contains(lower(m), 'project not found') THEN 'ERR_LSP_DOCUMENT_SYMBOL_FAILED' ELSE 'ERR_LSP_EXTRACT_FAILED' END AS code FROM (SELECT event_id, {_MESSAGE} AS m FROM jobs))""", "jobs")
def e19_error_codes(jobs):
    t = jobs.select("event_id", C.error_code(F.expr(_MESSAGE)).alias("code"))
    return t.select("event_id", "code", C.failure_kind(F.col("code")).alias("kind"))


# --- reports


@query("SELECT user_id, arg_max(event_id, struct_pack(ts, event_id)) AS event_id, max(ts) AS started FROM jobs GROUP BY 1", "jobs")
def s21_latest_run(jobs):
    return jobs.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("started"))


@query("SELECT item_id, text FROM benchmark WHERE item_id % 2 = 0 AND (text ILIKE '%the%' OR text ILIKE '%an_d%') ORDER BY item_id DESC LIMIT 15", "benchmark")
def s20_knowledge_search(benchmark):
    hit = F.col("text").ilike("%the%") | F.col("text").ilike("%an_d%")
    return benchmark.where((F.col("item_id") % 2 == 0) & hit).orderBy(F.desc("item_id")).limit(15).select("item_id", "text")


@query("""WITH a AS (SELECT relative_path, name, min(line) AS fl, min(kind) AS fk, count(*) AS f FROM symbols GROUP BY 1, 2), b AS (SELECT relative_path, name, min(line + line % 4) AS kl, min(CASE WHEN line % 9 = 0 THEN 'class' ELSE kind END) AS kk, count(*) AS k FROM symbols WHERE line % 10 > 0 GROUP BY 1, 2),
t AS (SELECT coalesce(a.relative_path, b.relative_path) AS relative_path, coalesce(f, 0) AS f, coalesce(k, 0) AS k, least(coalesce(f, 0), coalesce(k, 0)) AS m, fk = kk AS same, abs(fl - kl) <= 2 AS near FROM a FULL JOIN b ON a.relative_path = b.relative_path AND a.name = b.name),
g AS (SELECT relative_path, sum(f)::BIGINT AS found, sum(k)::BIGINT AS known, sum(m)::BIGINT AS m, coalesce(sum(m) FILTER (WHERE same), 0)::BIGINT AS kinds, coalesce(sum(m) FILTER (WHERE near), 0)::BIGINT AS places FROM t GROUP BY 1)
SELECT relative_path, found, known, round(CASE WHEN known = 0 THEN 1 ELSE m / known END, 6)::DOUBLE AS recall, round(CASE WHEN found = 0 THEN 1 ELSE m / found END, 6)::DOUBLE AS precision, round(CASE WHEN m = 0 THEN 1 ELSE kinds / m END, 6)::DOUBLE AS kind_rate, round(CASE WHEN m = 0 THEN 1 ELSE places / m END, 6)::DOUBLE AS place_rate,
concat_ws(',', CASE WHEN known > found THEN 'ast_missing_symbols' END, CASE WHEN found > known THEN 'ast_extra_symbols' END, CASE WHEN m > 0 AND kinds < m THEN 'kind_mismatch_present' END, CASE WHEN m > 0 AND places < m THEN 'position_mismatch_present' END, CASE WHEN known > 0 AND m = 0 THEN 'no_proxy_matches' END) AS flags FROM g""", "symbols")
def g21_proxy_quality(symbols):
    known = symbols.where("line % 10 > 0").select("relative_path", "name", F.when(F.col("line") % 9 == 0, "class").otherwise(F.col("kind")).alias("kind"), (F.col("line") + F.col("line") % 4).alias("line"))
    return Y.proxy_quality(symbols, known, ["relative_path"], 2)


@query("""SELECT lang, count(*) AS files, round(avg(size_bytes), 6) AS mean_bytes, count(*) FILTER (WHERE enrich_state = 'FAILED') AS failed, arg_max(repo_root, struct_pack(n, repo_root)) AS top_root FROM (SELECT *, count(*) OVER (PARTITION BY lang, repo_root) AS n FROM files WHERE NOT is_deleted) GROUP BY lang""", "files")
def g22_shadow_summary(files):
    """By language: means and counts, and the most frequent root, from one aggregation by both and one over it."""
    by = files.where("not is_deleted").groupBy("lang", "repo_root").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("enrich_state") == "FAILED").alias("failed"))
    return by.groupBy("lang").agg(F.sum("n").alias("files"), F.round(F.sum("bytes") / F.sum("n"), 6).alias("mean_bytes"), F.sum("failed").alias("failed"), F.max_by("repo_root", F.struct("n", "repo_root")).alias("top_root"))


@query("""SELECT event_type, done, dead, round(CASE WHEN done + dead = 0 THEN 0 ELSE 100.0 * dead / (done + dead) END, 6)::DOUBLE AS error_pct, round(done / wall, 4)::DOUBLE AS per_second, done / wall >= 0.00001 AND 100.0 * dead / (done + dead) <= 0.5 AS passes
FROM (SELECT event_type, count(*) FILTER (WHERE status = 'DONE') AS done, count(*) FILTER (WHERE status = 'DEAD') AS dead, epoch_us(max(ts)) / 1000000 - epoch_us(min(ts)) / 1000000 AS wall FROM jobs GROUP BY 1)""", "jobs")
def g23_dataset_result(jobs):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    t = jobs.groupBy("event_type").agg(F.count_if(F.col("status") == "DONE").alias("done"), F.count_if(F.col("status") == "DEAD").alias("dead"), (F.max(at) - F.min(at)).alias("wall"))
    pct = F.coalesce(F.try_divide(100.0 * F.col("dead"), F.col("done") + F.col("dead")), F.lit(0.0))
    return t.select("event_type", "done", "dead", F.round(pct, 6).alias("error_pct"), F.round(F.col("done") / F.col("wall"), 4).alias("per_second"), ((F.col("done") / F.col("wall") >= 0.00001) & (pct <= 0.5)).alias("passes"))


# --- sessions


@query("""SELECT c.conv_id, c.turn, CASE WHEN c.role <> 'assistant' OR s.turn IS NULL THEN 'OK' WHEN contains(c.text, split_part(s.text, ' ', 1)) THEN 'OK' ELSE 'LOW_RELEVANCE' END AS relevance FROM conversations c
LEFT JOIN (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1) s ON s.conv_id = c.conv_id""", "conversations")
def f13_read_relevance(conversations):
    last = conversations.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("asked"), F.max_by("text", "turn").alias("query"))
    ok = (F.col("role") != "assistant") | F.col("asked").isNull() | F.contains("text", F.split_part("query", F.lit(" "), F.lit(1)))
    return conversations.join(last, "conv_id", "left").select("conv_id", "turn", F.when(ok, "OK").otherwise("LOW_RELEVANCE").alias("relevance"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS searches, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_query FROM conversations GROUP BY 1", "conversations")
def r20_search_metrics(conversations):
    user = F.col("role") == "user"
    return conversations.groupBy("conv_id").agg(F.count_if(user).alias("searches"), F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("last_query"))


@query("SELECT repo_root, substr(sha256(repo_root), 1, 12) AS uid FROM (SELECT DISTINCT repo_root FROM files)", "files")
def v49_workspace_hash(files):
    return files.select("repo_root").distinct().select("repo_root", F.substring(F.sha2("repo_root", 256), 1, 12).alias("uid"))


@query("SELECT doc_id, substr(text, 1, 400) AS preview, length(text) > 400 AS cut FROM files WHERE NOT is_deleted", "files")
def v52_preview(files):
    return files.where("not is_deleted").select("doc_id", F.substring("text", 1, 400).alias("preview"), (F.length("text") > 400).alias("cut"))


@query("SELECT user_id, bool_or(event_type = 'error') AS fatal FROM jobs GROUP BY 1", "jobs")
def v04_any_fatal(jobs):
    return jobs.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("fatal"))


@query("""SELECT repo_root, lang, n, hot, row_number() OVER (ORDER BY CASE WHEN n >= 20 THEN 0 ELSE 1 END, -hot, repo_root, lang) AS place FROM (SELECT repo_root, lang, count(*) AS n, count(*) FILTER (WHERE enrich_state = 'PENDING') AS hot FROM files GROUP BY 1, 2)""", "files")
def v16_group_order(files):
    g = files.groupBy("repo_root", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("enrich_state") == "PENDING").alias("hot"))
    # a row a group of files
    w = Window.orderBy(F.when(F.col("n") >= 20, 0).otherwise(1), F.desc("hot"), "repo_root", "lang")
    return g.select("repo_root", "lang", "n", "hot", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'hit' ELSE 'miss' END AS cache FROM files f LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE NOT is_deleted", "files", "labels")
def v13_extraction_cache(files, labels):
    """Files whose hash has stored symbols are hits and are not extracted again."""
    known = labels.select("doc_id").distinct().withColumn("known", F.lit(True))
    return files.where("not is_deleted").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.when(F.col("known"), "hit").otherwise("miss").alias("cache"))


# --- ranked items


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'symbol:' || repo_root || ':' || relative_path || ':' || lang ELSE 'file:' || repo_root || ':' || relative_path END AS key FROM files", "files")
def k03_item_key(files):
    file = F.concat_ws(":", F.lit("file"), "repo_root", "relative_path")
    return files.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat_ws(":", F.lit("symbol"), "repo_root", "relative_path", "lang")).otherwise(file).alias("key"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), t AS (SELECT vec_id, label, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM (SELECT * FROM embeddings ORDER BY label DESC, vec_id LIMIT 50))
SELECT t.vec_id, t.rank, CASE WHEN rank <= 20 THEN round(list_cosine_similarity(e.embedding::DOUBLE[], q.q), 6) END AS similarity FROM t JOIN embeddings e USING (vec_id), q""", "embeddings")
def k11_vector_window(embeddings):
    """Only the first 20 of the items have a similarity; the order stays."""
    items = S.ranked(S.top(embeddings, 50, F.desc("label"), "vec_id"), "rank", F.desc("label"), "vec_id")
    q = embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    near = F.when(F.col("rank") <= 20, F.round(C.cosine(F.col("embedding"), F.col("q")), 6))
    return items.crossJoin(F.broadcast(q)).select("vec_id", F.col("rank").cast("bigint").alias("rank"), near.alias("similarity"))


@query("""SELECT doc_id, rank AS place, CASE WHEN rank <= 20 THEN size_bytes END AS score FROM (SELECT doc_id, size_bytes, row_number() OVER (ORDER BY size_bytes DESC, doc_id) AS rank FROM files) WHERE rank <= 60""", "files")
def u02_merge_window(files):
    """The first 20 get a score of their own, the rest follows without; the order stays."""
    t = S.ranked(S.top(files.select("doc_id", "size_bytes"), 60, F.desc("size_bytes"), "doc_id"), "rank", F.desc("size_bytes"), "doc_id")
    return t.select("doc_id", F.col("rank").cast("bigint").alias("place"), F.when(F.col("rank") <= 20, F.col("size_bytes")).alias("score"))


@query("""WITH c AS (SELECT to_symbol, n, row_number() OVER (ORDER BY n DESC, to_symbol) AS rank FROM (SELECT to_symbol, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, to_symbol LIMIT 100))
SELECT c.rank, s.symbol_key, s.name FROM c JOIN symbols s ON s.symbol_key = c.to_symbol WHERE contains(lower(s.name), 'a') ORDER BY rank, symbol_key LIMIT 30""", "edges", "symbols")
def k14_symbol_resolution(edges, symbols):
    """Symbols of the candidates whose name holds the query, in the candidates' order."""
    top = S.top(edges.groupBy("to_symbol").agg(F.count("*").alias("n")), 100, F.desc("n"), "to_symbol")
    c = S.ranked(top, "rank", F.desc("n"), "to_symbol").select(F.col("to_symbol").alias("symbol_key"), F.col("rank").cast("bigint").alias("rank"))
    return symbols.where(C.contains_ci(F.col("name"), "a")).join(F.broadcast(c), "symbol_key").orderBy("rank", "symbol_key").limit(30).select("rank", "symbol_key", "name")
