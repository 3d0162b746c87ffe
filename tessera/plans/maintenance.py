"""Queries over an index that is kept up to date, and tables that are committed together, each with its DuckDB form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import caches as K
from tessera.operators import collect as L
from tessera.operators import commits
from tessera.operators import search as S
from tessera.operators import segments as G
from tessera.plans.registry import query
from tessera.sources.shared import shared_dir

_SCORE = """w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[0-9a-zA-Z_]+'), lambda x: lower(x)) AS w FROM d), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
t AS (SELECT doc_id, len(w) AS len, term, CASE WHEN contains(term, ' ') THEN len(list_filter(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1] = term)) ELSE len(list_filter(w, lambda x: x = term)) END AS tf FROM w, (SELECT unnest({terms}) AS term)),
i AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM w, s, (SELECT unnest({words}) AS word) WHERE list_contains(w, word) GROUP BY word, n),
k AS (SELECT doc_id, sum((SELECT sum(idf) FROM i WHERE list_contains(string_split(term, ' '), word)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM t, s WHERE tf > 0 GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM k ORDER BY round(score, 6) DESC, doc_id LIMIT 50"""
_CHANGED = "CASE WHEN doc_id % 5 = 1 AND doc_id % 3 > 0 THEN concat('the and ', text) ELSE text END"


def _open(files) -> G.SegmentIndex:
    spark = files.sparkSession
    return G.SegmentIndex(spark, f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}", ("text",))


def _changed(files):
    """An index of all files; then a fifth of them is deleted, a fifth changed, of which a third with a payload that no longer fits; then its segments are merged."""
    index = _open(files)
    index.update(files.select(F.col("doc_id").alias("key"), "text"))
    now = files.select(F.col("doc_id").alias("key"), F.concat(F.lit("h"), "doc_id").alias("content_hash"), (F.col("doc_id") * 10).alias("mtime"), F.col("size_bytes").alias("size"), F.expr(_CHANGED).alias("text"))
    kind = F.when(F.col("key") % 5 == 0, "DELETE").otherwise("UPSERT")
    pending = now.where("key % 5 < 2").select(F.col("key").alias("change_id"), kind.alias("change_type"), "key", F.when(F.col("key") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), "mtime", "size")
    return index, G.apply_pending(index, pending, now, most=1 << 30, batch=1 << 20)


@query(f"WITH d AS (SELECT doc_id, {_CHANGED} AS text FROM files WHERE doc_id % 5 > 0), " + _SCORE.format(terms="['the', 'and']", words="['the', 'and']"), "files")
def w28_index_changes(files):
    index, _ = _changed(files)
    index.merge(1 << 30)
    return S.top(S.bm25(index, "the and").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")), 50, F.desc("score"), "doc_id")


@query("SELECT doc_id AS change_id, CASE WHEN doc_id % 5 = 1 AND doc_id % 3 = 0 THEN 'FAILED' ELSE 'APPLIED' END AS status, CASE WHEN doc_id % 5 = 1 AND doc_id % 3 = 0 THEN 'content hash mismatch' END AS reason FROM files WHERE doc_id % 5 < 2", "files")
def w28_change_status(files):
    return _changed(files)[1]


@query("WITH d AS (SELECT doc_id, text FROM files WHERE NOT is_deleted), " + _SCORE.format(terms="['the and', 'is']", words="['the', 'and', 'is']"), "files")
def s09_phrase_search(files):
    index = _open(files)
    index.update(files.where("not is_deleted").select(F.col("doc_id").alias("key"), "text"))
    return S.top(G.search(index, '"the and" is').select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")), 50, F.desc("score"), "doc_id")


@query("SELECT 'files' AS name, lang, count(*) AS n, sum(size_bytes)::BIGINT AS total FROM files GROUP BY ALL UNION ALL SELECT 'layers', lang, count(*), sum(doc_id)::BIGINT FROM l4 JOIN (SELECT doc_id, lang FROM files) USING (doc_id) GROUP BY ALL", "files", "l4")
def w26_flush(files, l4):
    """Two flushes of both tables; between them a writer stops after its first table, which is not seen."""
    spark = files.sparkSession
    tables = commits.TableSet(spark, f"{shared_dir(spark)}/flush-{uuid.uuid4().hex}")
    a = files.select("doc_id", "lang", "size_bytes")
    b = l4.select("doc_id").join(files.select("doc_id", "lang"), "doc_id")
    half = lambda df, n: df.where(F.col("doc_id") % 2 == n)
    commits.flush(tables, {"files": half(a, 0), "layers": half(b, 0)})
    tables.write(half(a, 1), "files")
    tables.clean()
    commits.flush(tables, {"files": half(a, 1), "layers": half(b, 1)})
    total = lambda t, c: tables.read(t).groupBy(F.lit(t).alias("name"), "lang").agg(F.count("*").alias("n"), F.sum(c).alias("total"))
    return total("files", "size_bytes").unionByName(total("layers", "doc_id"))


_IGNORES = ["*.lock", "!app/**/doc_?5*.lock", "/tests/de/", "lib/**"]


@query("""SELECT repo_root, relative_path, CASE WHEN size_bytes > 5000 THEN 'size' WHEN CASE WHEN starts_with(relative_path, 'lib/') THEN NOT (repo_root = '/ws/src1' AND regexp_matches(relative_path, '^lib/en/[^/]*\\.py$')) ELSE starts_with(relative_path, 'tests/de/') OR (relative_path LIKE '%.lock' AND NOT regexp_matches(relative_path, '^app/(.*/)?doc_.5[^/]*\\.lock$')) END THEN 'ignored'
  WHEN NOT regexp_matches(relative_path, '\\.(py|java|lock)$') THEN 'extension' WHEN regexp_matches(relative_path, '^src/(.*/)?doc_[^/]*7\\.py$') THEN 'excluded' END AS reason FROM files""", "files")
def s04_collectible(files):
    """Every repository has the same ignore file at its root; one has another in lib that takes a part of it back."""
    roots = files.select("repo_root").distinct()
    rules = roots.select("repo_root", F.lit("").alias("folder"), F.lit("\n".join(_IGNORES)).alias("text")).unionByName(roots.where("repo_root = '/ws/src1'").select("repo_root", F.lit("lib").alias("folder"), F.lit("!en/*.py").alias("text")))
    t = L.collectible(files.select("repo_root", "relative_path", "size_bytes"), rules, (".py", ".java", ".lock"), ("src/**/doc_*7.py",), most_bytes=5000)
    return t.select("repo_root", "relative_path", "reason")


@query("""SELECT doc_id, hit, CASE WHEN hit IS NOT NULL THEN 'items ' || doc_id END AS items FROM (SELECT doc_id, CASE WHEN doc_id % 10 > 1 AND NOT (doc_id % 11 = 0 AND doc_id % 10 <= 5) AND doc_id % 7 > 0 THEN
  CASE WHEN (doc_id % 3 = 0 AND doc_id % 2 = 0) OR (doc_id % 3 = 2 AND doc_id % 2 = 1) THEN 'variant' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'legacy' END END AS hit FROM files)""", "files")
def w17_cache_lookup(files):
    """Entries under both variants and under bare queries; a tenth of the files and, earlier, everything is made invalid; a seventh is of an older content."""
    id_ = F.col("doc_id")
    by = ["repo_root", "relative_path"]
    query_, content = F.lit("query"), F.concat(F.lit("h"), id_)
    key = F.when(id_ % 3 == 0, K.cache_key(query_, F.lit("list"))).when(id_ % 3 == 1, query_).otherwise(K.cache_key(query_, F.lit("detail")))
    puts = files.select(*by, key.alias("key"), F.when(id_ % 7 == 0, "older").otherwise(content).alias("content_hash"), F.concat(F.lit("items "), id_).alias("items"), (id_ % 10).alias("at"))
    gone = files.where("doc_id % 11 = 0").select(*by, F.lit(5).cast("bigint").alias("at"))
    gone = gone.unionByName(files.sparkSession.createDataFrame([(None, None, 1)], "repo_root string, relative_path string, at bigint"))
    asked = files.select("doc_id", *by, query_.alias("query"), F.when(id_ % 2 == 0, " List").otherwise("detail").alias("variant"), content.alias("content_hash"))
    return K.cached_items(asked, puts, gone, by).select("doc_id", "hit", "items")


@query("SELECT to_symbol, CASE WHEN count(*) % 3 = 0 THEN count(*) END AS n FROM edges GROUP BY to_symbol", "edges")
def b52_cached_fan_in(edges):
    """Counts are cached under the epoch of their time, twice each; where the later one is of another epoch nothing is found."""
    counts = edges.groupBy("to_symbol").agg(F.count("*").alias("n"))
    put = lambda epoch, n, at: counts.select("to_symbol", epoch.alias("epoch"), n.alias("n"), F.lit(at).alias("at"))
    puts = put(F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"), 1).unionByName(put(F.col("n") % 3, F.col("n"), 2))
    return K.cached_counts(counts.select("to_symbol", F.lit(0).cast("bigint").alias("epoch")), puts, ["to_symbol"]).select("to_symbol", "n")


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'GLOBAL' ELSE 'REPO' END AS scope, CASE WHEN user_id % 5 > 0 THEN user_id END AS repo_id, event_type AS code FROM jobs WHERE status = 'DEAD'""", "jobs")
def w22_error_events(jobs):
    """Errors are appended in two commits, those without a repository as global; the log is read back."""
    spark = jobs.sparkSession
    tables = commits.TableSet(spark, f"{shared_dir(spark)}/errors-{uuid.uuid4().hex}")
    repo = F.when(F.col("user_id") % 5 > 0, F.col("user_id"))
    events = jobs.where("status = 'DEAD'").select("event_id", F.when(repo.isNull(), "GLOBAL").otherwise("REPO").alias("scope"), repo.alias("repo_id"), F.col("event_type").alias("code"))
    for n in (0, 1):
        commits.flush(tables, {"error_events": events.where(F.col("event_id") % 2 == n)})
    return tables.read("error_events")
