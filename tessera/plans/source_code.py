"""Queries over source text: outlines, names and kinds, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import outline as O
from tessera.operators import python_code as P
from tessera.operators import quality as Q
from tessera.plans.registry import query
from tessera.sources.shared import materialize

# Line by line, in place of offsets: a match begins after the last line that is not empty.
_LINES = """WITH l AS (SELECT repo_root, relative_path, lang, i, line, coalesce(max(CASE WHEN trim(line) <> '' THEN i END) OVER (PARTITION BY relative_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start
  FROM (SELECT repo_root, relative_path, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM sources)),
s AS (SELECT repo_root, relative_path, start, i, line, unnest(CASE lang
    WHEN 'python' THEN [('class', regexp_extract(line, '^\\s*class\\s+(\\w+)\\s*[(:]', 1)), ('function', regexp_extract(line, '^\\s*def\\s+(\\w+)\\s*\\(', 1))]
    WHEN 'java' THEN [('class', regexp_extract(line, '^\\s*(?:public\\s+)?(?:abstract\\s+)?class\\s+(\\w+)\\b', 1)), ('method', regexp_extract(line, '^\\s*(?:public|protected|private)?\\s*(?:static\\s+)?[A-Za-z_$][A-Za-z0-9_$.<>\\[\\], ?]*\\s+(\\w+)\\s*\\(', 1))]
    WHEN 'typescript' THEN [('class', regexp_extract(line, '^\\s*(?:export\\s+)?class\\s+(\\w+)\\b', 1)), ('function', regexp_extract(line, '^\\s*(?:export\\s+)?(?:async\\s+)?function\\s+(\\w+)\\s*\\(', 1))]
    ELSE [('module', regexp_extract(line, '^\\s*package\\s+([\\w.]+)\\b', 1)), ('class', regexp_extract(line, '^\\s*(?:sealed\\s+|final\\s+|case\\s+|abstract\\s+)*(?:class|trait|object|enum)\\s+(\\w+)\\b', 1)),
      ('method', regexp_extract(line, '^\\s*def\\s+(\\w+)\\s*[[(]', 1)), ('field', regexp_extract(line, '^\\s*(?:lazy\\s+)?va[lr]\\s+(\\w+)\\b', 1))] END) AS x FROM l),
o AS (SELECT DISTINCT repo_root, relative_path, x[2] AS name, x[1] AS kind, start AS line FROM s WHERE x[2] <> '' AND NOT (x[1] = 'method' AND start = i AND regexp_matches(trim(line), '^(return|new|if|for|while|switch|catch|throw)\\b')))
"""


@query(_LINES + "SELECT repo_root, relative_path, name, kind, line::INTEGER AS line, line::INTEGER AS end_line, name || ':' || line AS symbol_key FROM o", "sources")
def e02_outline(sources):
    return O.outline(sources, ["repo_root", "relative_path"])


@query("""SELECT relative_path, regexp_extract(line, '(\\S+)\\(', 1) AS name, 'method' AS kind, i::INTEGER AS line, i::INTEGER AS end_line, regexp_extract(line, '(\\S+)\\(', 1) || ':' || i AS symbol_key
FROM (SELECT relative_path, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM sources) WHERE lang = 'java' AND contains(line, 'größe')""", "sources")
def e04_unicode_methods(sources):
    return O.unicode_methods(sources, ["relative_path"])


@query(_LINES + """SELECT relative_path, CASE WHEN lang = 'typescript' THEN 'l3_preprocess_tsls_fast_path' WHEN coalesce(n, 0) = 0 THEN 'l3_preprocess_no_symbols' ELSE 'l3_preprocess_supported_language' END AS reason, CASE WHEN lang = 'typescript' THEN 'none' ELSE 'regex_outline' END AS source, 'needs_l5' AS decision
FROM sources LEFT JOIN (SELECT relative_path, count(*) AS n FROM o GROUP BY 1) USING (relative_path)""", "sources")
def e01_preprocess(sources):
    n = O.outline(sources, ["relative_path"]).groupBy("relative_path").agg(F.count("*").alias("n"))
    t = sources.join(n, "relative_path", "left")
    return t.select("relative_path", O.decision(F.col("relative_path"), F.col("text"), F.col("lang"), F.coalesce("n", F.lit(0))).alias("x")).select("relative_path", "x.*")


_BUCKET = """CASE WHEN kind IN ('5', 'class') THEN 'class' WHEN kind IN ('6', '9', 'method') THEN 'method' WHEN kind = '12' THEN 'function' WHEN kind = 'variable' OR (kind = '13' AND lang = 'python') THEN 'field' WHEN kind = '13' THEN 'variable' END"""
_NAME = """CASE WHEN lang = 'java' AND starts_with(name, 'new ') THEN '' WHEN lang = 'java' THEN regexp_replace(regexp_replace(name, '\\(.*', ''), '<.*', '') ELSE name END"""


@query(f"SELECT lang, kind, {_NAME} AS symbol, {_BUCKET} AS bucket, count(*) AS n FROM known GROUP BY ALL", "known")
def e07_buckets_and_names(known):
    return known.groupBy("lang", "kind", O.symbol_name(F.col("lang"), F.col("name")).alias("symbol"), O.kind_bucket(F.col("lang"), F.col("kind")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""SELECT lang, CASE WHEN lang = 'java' AND kind = '9' THEN 'missing_constructor' WHEN lang = 'java' AND bucket = 'class' AND contains(name, '$') THEN 'missing_nested_type'
  WHEN lang = 'scala' AND bucket = 'class' THEN 'missing_type' ELSE 'missing_' || bucket END AS pattern, count(*) AS n FROM (SELECT *, {_BUCKET} AS bucket FROM known) GROUP BY ALL""", "known")
def e09_missing_patterns(known):
    bucket = O.kind_bucket(F.col("lang"), F.col("kind"))
    return known.groupBy("lang", O.missing_pattern(F.col("lang"), F.col("kind"), bucket, F.col("name")).alias("pattern")).agg(F.count("*").alias("n"))


# --- Python sources: the edges that each kind of file was made to hold


_PY = "SELECT repo_root, relative_path, {0} AS from_symbol, {1} AS to_symbol, {2}::INTEGER AS line, '{3}' AS evidence, {4}::DOUBLE AS confidence, CASE WHEN starts_with(relative_path, 'tests/') THEN 'tests' ELSE 'production' END AS scope FROM pyfiles WHERE p_partkey % 6 = {5}"
_EDGES = " UNION ALL ".join(_PY.format(*x) for x in (
    ("'router.get'", "'read_' || g", 4, "python_route_decorator", 0.8, 0), ("'app.post'", "'write'", 10, "python_route_decorator", 0.8, 0),
    ("'build'", "'show'", 4, "python_route_registration", 0.9, 1), ("'build'", "'home'", 5, "python_route_registration", 0.9, 1),
    ("'Service' || g || '.run'", "'Tool.call'", 8, "python_mcp_dispatch", 0.85, 2), ("'Service' || g || '.run'", "'Repo.find'", 9, "python_bound_attribute_call", 0.9, 2),
    ("'Service' || g || '.run'", "'Tool.call'", 11, "python_registry_dispatch", 0.8, 2), ("'Service' || g || '.run'", "'plain'", 12, "python_registry_dispatch", 0.8, 2)))


@query(_EDGES, "pyfiles")
def e11_call_edges(pyfiles):
    return P.call_edges(P.facts(pyfiles))


@query(_PY.format("'build'", "'read_' || g", 3, "python_include_router", 0.75, 1) + " AND NOT starts_with(relative_path, 'tests/') AND EXISTS (SELECT 1 FROM part x WHERE x.p_partkey = pyfiles.p_partkey - 1)", "pyfiles")
def e17_router_edges(pyfiles):
    return P.router_edges(P.facts(pyfiles))


_IMPLEMENTS = """SELECT repo_root, 'Store' || g AS protocol, relative_path, x.name, x.line::INTEGER AS line, x.end_line::INTEGER AS end_line, x.evidence, x.confidence::DOUBLE AS confidence
FROM pyfiles, (VALUES ('Disk', 1, 2, 'python_protocol_base', 0.9), ('Mem', 3, 7, 'python_structural_protocol_match', 0.8)) x(name, line, end_line, evidence, confidence) WHERE p_partkey % 6 = 5 AND EXISTS (SELECT 1 FROM part y WHERE y.p_partkey = pyfiles.p_partkey - 1)"""


@query(_IMPLEMENTS, "pyfiles")
def e18_protocol_implementations(pyfiles):
    return P.protocol_implementations(P.class_specs(pyfiles))


@query(f"""SELECT repo_root, relative_path, name, line::BIGINT AS line, evidence, confidence FROM ({_IMPLEMENTS}) WHERE protocol = 'Store6' AND NOT EXISTS (SELECT 1 FROM symbols WHERE contains(lower(name), 'store6')) ORDER BY confidence DESC, relative_path, line LIMIT 20""", "pyfiles", "symbols")
def h06_implementations(pyfiles, symbols):
    named = I.symbol_search(symbols.where(F.contains(F.lower("name"), F.lit("store6"))), "", 20).withColumn("repo_root", F.lit("/ws"))
    return P.implementations(named, P.protocol_implementations(P.class_specs(pyfiles)), "Store6", 20)


# --- found against known symbols

# A file knows each name once here, so the first found symbol that may take it does; gaps by language and bucket as they stand in the operator.
_MATCH = _LINES + f""", f AS (SELECT relative_path, lang, name, CASE WHEN lang = 'scala' AND kind = 'function' THEN 'method' ELSE kind END AS bucket, kind, line, line AS end_line FROM o JOIN (SELECT relative_path, lang FROM sources) USING (relative_path)),
k AS (SELECT relative_path, lang, {_NAME} AS name, {_BUCKET} AS bucket, kind, line, end_line FROM known WHERE {_NAME} <> ''),
p AS (SELECT f.relative_path, f.name, f.line, f.kind, f.bucket = k.bucket AS same, CASE WHEN f.line BETWEEN k.line AND k.end_line THEN 0 ELSE least(abs(f.line - k.line), abs(f.line - k.end_line)) END AS gap, k.lang, f.bucket FROM f JOIN k ON f.relative_path = k.relative_path AND f.name = k.name),
c AS (SELECT *, CASE WHEN lang = 'java' AND bucket IN ('class', 'method') THEN 12 WHEN lang = 'python' AND bucket IN ('class', 'method', 'function') THEN 6 WHEN lang = 'scala' AND bucket IN ('module', 'class', 'method', 'field') THEN 8 ELSE 2 END AS most FROM p),
b AS (SELECT relative_path, name, min((line, kind)) AS first, arg_min(same, (line, kind)) AS same, arg_min(gap, (line, kind)) AS gap, arg_min(most, (line, kind)) AS most FROM c WHERE gap <= 2 OR (same AND gap <= most) GROUP BY ALL),
m AS (SELECT 'found' AS side, f.*, b.same, b.gap, b.most FROM f LEFT JOIN b ON f.relative_path = b.relative_path AND f.name = b.name AND f.line = b.first[1] AND f.kind = b.first[2]
  UNION ALL SELECT 'known', k.*, b.same, b.gap, b.most FROM k LEFT JOIN b ON k.relative_path = b.relative_path AND k.name = b.name)
"""


@query(_MATCH + "SELECT side, relative_path, name, bucket, line::INTEGER AS line, gap IS NOT NULL AS matched, coalesce(same, false) AS same_kind, gap::INTEGER AS gap FROM m", "sources", "known")
def j13_tolerance_match(sources, known):
    return _matches(sources, known).select("side", "relative_path", "name", "bucket", "line", "matched", "same_kind", "gap")


def _matches(sources, known):
    found = O.outline(sources, ["relative_path", "lang"])
    return Q.tolerance_match(Q.normalised(found, ["relative_path"]), Q.normalised(known, ["relative_path"]), ["relative_path"])


_QUALITY = _MATCH + """, y AS (SELECT *, side = 'known' AND gap IS NULL AND lang = 'java' AND regexp_matches(name, '^[A-Za-z_]\\w*Builder(Impl)?$') AS made,
  CASE WHEN lang = 'java' AND kind = '9' THEN 'missing_constructor' WHEN lang = 'java' AND bucket = 'class' AND contains(name, '$') THEN 'missing_nested_type' WHEN lang = 'scala' AND bucket = 'class' THEN 'missing_type' ELSE 'missing_' || bucket END AS pattern FROM m),
q AS (SELECT relative_path, lang, count(*) FILTER (side = 'found') AS found, count(*) FILTER (side = 'known') AS al, count(*) FILTER (side = 'known' AND NOT made) AS known, count(*) FILTER (side = 'found' AND gap IS NOT NULL) AS matched,
  count(*) FILTER (side = 'found' AND same) AS kinds, count(*) FILTER (side = 'found' AND gap <= 2) AS places, count(*) FILTER (side = 'found' AND gap <= most) AS loose FROM y GROUP BY ALL),
r AS (SELECT *, CASE WHEN known = 0 THEN 1 ELSE matched / known END AS recall, CASE WHEN found = 0 THEN 1 ELSE matched / found END AS precision, CASE WHEN matched = 0 THEN 1 ELSE kinds / matched END AS kind_rate, CASE WHEN matched = 0 THEN 1 ELSE places / matched END AS place_rate,
  CASE WHEN matched = 0 THEN 1 ELSE loose / matched END AS loose_rate,
  list_filter([CASE WHEN known > found THEN 'ast_missing_symbols' END, CASE WHEN found > al THEN 'ast_extra_symbols' END, CASE WHEN matched > 0 AND kinds < matched THEN 'kind_mismatch_present' END, CASE WHEN matched > 0 AND places < matched THEN 'position_mismatch_present' END, CASE WHEN known > 0 AND matched = 0 THEN 'no_proxy_matches' END], lambda x: x IS NOT NULL) AS flags FROM q)
"""


@query(_QUALITY + """SELECT relative_path, lang, found, known, matched, round(recall, 6)::DOUBLE AS recall, round(precision, 6)::DOUBLE AS precision, round(kind_rate, 6)::DOUBLE AS kind_rate, round(place_rate, 6)::DOUBLE AS place_rate, round(loose_rate, 6)::DOUBLE AS loose_rate, array_to_string(flags, ',') AS flags FROM r""", "sources", "known")
def g21_file_quality(sources, known):
    t = Q.file_quality(_matches(sources, known), ["relative_path"])
    return t.select("relative_path", "lang", "found", "known", "matched", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "kind_rate", "place_rate", "loose_rate")), F.array_join("flags", ",").alias("flags"))


@query(_QUALITY + """, x AS (SELECT lang, pattern, count(*) AS n FROM y WHERE side = 'known' AND gap IS NULL AND NOT made GROUP BY lang, pattern QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, pattern) <= 10),
z AS (SELECT lang, flag, count(*) AS n FROM (SELECT lang, unnest(flags) AS flag FROM r) GROUP BY ALL)
SELECT r.lang, count(*) AS files, round(avg(round(recall, 9)), 6) AS recall, round(avg(round(precision, 9)), 6) AS precision, round(avg(round(kind_rate, 9)), 6) AS kind_rate, round(avg(round(place_rate, 9)), 6) AS place_rate, round(avg(round(loose_rate, 9)), 6) AS loose_rate,
  coalesce((SELECT string_agg(flag || '=' || n, ',' ORDER BY flag) FROM z WHERE z.lang = r.lang), '') AS flags, coalesce((SELECT string_agg(pattern || '=' || n, ',' ORDER BY n DESC, pattern) FROM x WHERE x.lang = r.lang), '') AS top_missing FROM r GROUP BY r.lang""", "sources", "known")
def g22_shadow_languages(sources, known):
    """Two halves of the files are summed apart and added up."""
    files = materialize(Q.file_quality(_matches(sources, known), ["relative_path"]), "quality")
    half = lambda n: Q.shadow_counts(files.where(F.pmod(F.xxhash64("relative_path"), F.lit(2)) == n))
    t = Q.shadow_summary(Q.merge_shadow(half(0).unionByName(half(1))))
    return t.withColumns({c: F.array_join(c, ",") for c in ("flags", "top_missing")})


@query(_QUALITY + """, g AS (SELECT lang, count(*) AS files, round(avg(round(recall, 9)), 6) AS recall FROM r GROUP BY lang), v AS (SELECT (SELECT 100.0 * count(*) FILTER (WHERE enrich_state <> 'FAILED') / count(*) FROM files WHERE NOT is_deleted) AS parse_pct,
  (SELECT 100.0 * count(*) FILTER (WHERE enrich_state = 'L3_SKIPPED') / count(*) FROM files WHERE NOT is_deleted) AS degraded_pct, (SELECT 100.0 * count(*) FILTER (WHERE degraded) / count(*) FROM l4) AS admission_pct,
  (SELECT 100 * (1 - sum(recall * files) / sum(files)) FROM g) AS regression_pct, (SELECT count(*) FROM queue WHERE status = 'PENDING') AS pending)
SELECT round(parse_pct, 6)::DOUBLE AS parse_pct, round(degraded_pct, 6)::DOUBLE AS degraded_pct, round(admission_pct, 6)::DOUBLE AS admission_pct, round(regression_pct, 4)::DOUBLE AS regression_pct, pending,
  parse_pct >= 95 AND degraded_pct <= 10 AND admission_pct <= 30 AS a_to_b, regression_pct <= 1 AND pending = 0 AND admission_pct <= 5 AS b_to_c FROM v""", "files", "l4", "queue", "sources", "known")
def g24_stage_exit(files, l4, queue, sources, known):
    """Each value is one row."""
    pct = lambda c: 100.0 * F.count_if(c) / F.count("*")
    live = files.where("not is_deleted").agg(pct(F.col("enrich_state") != "FAILED").alias("parse_pct"), pct(F.col("enrich_state") == "L3_SKIPPED").alias("degraded_pct"))
    summary = Q.shadow_summary(Q.shadow_counts(Q.file_quality(_matches(sources, known), ["relative_path"])))
    rows = (live, l4.agg(pct(F.col("degraded")).alias("admission_pct")), Q.recall_regression(summary), queue.where("status = 'PENDING'").agg(F.count("*").alias("pending")))
    values = rows[0]
    for x in rows[1:]:
        values = values.join(F.broadcast(x), F.lit(True))
    none = F.lit(None).cast("double")
    t = Q.stage_exit(values.withColumns({"admission_base": none, "pending_base": none, "pending_p95": none}))
    return t.select(*(F.round(c, 6).alias(c) for c in ("parse_pct", "degraded_pct", "admission_pct")), F.round("regression_pct", 4).alias("regression_pct"), "pending", "a_to_b", "b_to_c")
