import datetime
import random

from pyspark.sql import functions as F

from tessera.operators import lifecycle as L


def test_token_bucket_equals_a_loop(spark):
    rng, at = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(4), at + datetime.timedelta(seconds=rng.randrange(4000))) for i in range(400)] + [(900, 9, at), (901, 9, at), (902, 9, at)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp")
    got = {r["event_id"]: r["admitted"] for r in L.token_bucket(df, "user_id", "event_id", 60, 2).collect()}
    want, state = {}, {}
    for i, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        level, last = state.get(user, (2.0, ts))
        level = min(2.0, level + (ts - last).total_seconds() / 60)
        want[i] = level >= 1 - 1e-9
        state[user] = (level - want[i], ts)
    assert got == want
    assert L.token_bucket(df.limit(0), "user_id", "event_id", 60, 2).count() == 0


def test_deferral_drops_old_and_surplus_jobs(spark):
    rows = [(i, "r", datetime.datetime(2024, 1, 1 + i), i) for i in range(8)]
    jobs = spark.createDataFrame(rows, "job_id int, repo_root string, created_at timestamp_ntz, defer_count int")
    got = [r["state"] for r in L.defer(jobs, F.expr("timestamp_ntz '2024-01-08 00:00:00'"), 120, 4).orderBy("job_id").collect()]
    assert got == ["DROP_TTL", "DROP_TTL", "RETRY_WAIT", "BUMPED", "BUMPED", "BUMPED", "DROP_CAP", "DROP_CAP"]


def test_streaks_and_fences(spark):
    rows = [("a", 1, "x"), ("a", 2, "e"), ("a", 3, "e"), ("b", 1, "e"), ("b", 2, "e"), ("b", 3, "e"), ("c", 1, "e"), ("c", 2, "x"), ("d", 1, "e"), ("d", 2, None)]
    df = spark.createDataFrame(rows, "k string, i int, t string")
    got = {r["k"]: (r["streak"], r["state"]) for r in L.failure_streaks(df, "k", "i", F.coalesce(F.col("t") == "e", F.lit(False))).collect()}
    assert got == {"a": (2, "ACTIVE"), "b": (3, "DEGRADED"), "c": (0, "ACTIVE"), "d": (0, "ACTIVE")}
    old = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "k int, g int")
    new = spark.createDataFrame([(1, 6), (2, 5), (3, 1), (4, None)], "k int, g int")
    assert {tuple(r) for r in L.fenced(old, new, "k", "g").collect()} == {(1, 6), (2, 5), (3, None), (4, None)}


def test_embedding_has_length_one(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", L.embed(F.col("t")).alias("v")).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-12 and not any(got[2]) and len(got[1]) == 128 and (got[3] is None or not any(x or 0 for x in got[3]))


def test_scopes_widen_twice_at_most(spark):
    rows = [(1, "src/a.py", None, None, "[ERR_CONFIG_INVALID] x"), (2, "src/a.py", "repo", 1, "not in scope"), (3, "a.py", "module", 0, "project model missing"), (4, "a.py", "workspace", 0, "not in scope"), (5, "a.py", "repo", 2, "not in scope"),
            (6, "a.py", "repo", 0, None), (7, "a.py", "odd", 0, "not in scope"), (8, "../a.py", "module", -1, "ERR_LSP_DOCUMENT_SYMBOL_FAILED: project not found"), (9, "a.py", "module", 0, "ERR_LSP_DOCUMENT_SYMBOL_FAILED: broken")]
    failed = spark.createDataFrame([(i, "/r", *x) for i, *x in rows], "job_id int, repo_root string, relative_path string, scope_level string, scope_attempts int, message string")
    got = {r.job_id: (r.scope_level, r.scope_root, r.scope_attempts) for r in L.escalate_scope(failed, F.expr("timestamp_ntz '2020-01-01 00:00:00'")).collect()}
    assert got == {1: ("repo", "/r/src", 1), 2: ("workspace", "/r", 2), 3: ("repo", "/r", 1), 8: ("repo", "/r", 0)}
