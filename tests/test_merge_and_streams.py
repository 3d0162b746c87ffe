import datetime
import random

from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import merge as M
from tessera.streaming import changes


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 2), (3, "c", 2)], "k int, v string, n int")
    assert {tuple(r) for r in M.upsert(old, new, ["k"]).collect()} == {(1, "a", 1), (2, None, 2), (3, "c", 2)}
    kept = M.keep_better(old, new, ["k"], "old.v is not null and new.v is null")
    assert {tuple(r) for r in kept.collect()} == {(1, "a", 1), (2, "b", 1), (3, "c", 2)}
    plan = M.sync_plan(new, old, ["k"], ["v", "n"])
    assert {tuple(r) for r in plan.collect()} == {(1, "delete"), (2, "upsert"), (3, "upsert")}
    files = spark.createDataFrame([("f", "h1", False), ("g", "h1", False), ("g", "h2", False)], "p string, content_hash string, is_deleted boolean")
    assert [r["p"] for r in M.guarded(files.select("p", "content_hash"), files, ["p"]).collect()] == ["f"]
    gone = M.tombstone_missing(files, spark.createDataFrame([("f",)], "p string"), ["p"])
    assert {(r["p"], r["is_deleted"]) for r in gone.collect()} == {("f", False), ("g", True)}


def test_greedy_match(spark):
    schema = "f string, name string, kind string, line int"
    predicted = spark.createDataFrame([("a", "x", "function", 10), ("a", "x", "class", 11), ("a", "y", "function", 5), ("b", "z", "field", 1)], schema)
    golden = spark.createDataFrame([("a", "x", "class", 10), ("a", "x", "class", 12), ("a", "y", "function", 9), ("b", "z", "field", 400), ("c", "q", "class", 1)], schema)
    got = {r["f"]: (r["tp"], r["fp"], r["fn"]) for r in M.greedy_match(predicted, golden, "f").collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 0, 0), "c": (0, 0, 1)}


def test_greedy_match_in_bounded_groups(spark):
    rng = random.Random(3)
    kinds = ("field", "class", "function")
    draw = lambda n: [(rng.choice("ab"), rng.choice("xy"), rng.choice(kinds), rng.choice((rng.randrange(60), rng.randrange(6000)))) for _ in range(n)]
    p, g = draw(500), draw(500)
    hits = {"a": 0, "b": 0}
    free = list(p)
    for f, name, kind, line in sorted(g, key=lambda x: (x[3], x[2])):
        most = 512 if kind == "field" else 2
        near = [x for x in free if x[:2] == (f, name) and abs(x[3] - line) <= most]
        if near:
            free.remove(max(near, key=lambda x: (10 * (x[2] == kind) + most - abs(x[3] - line), -x[3], x[2])))
            hits[f] += 1
    schema = "f string, name string, kind string, line int"
    found = M.greedy_match(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema), "f")
    size = lambda rows, f: sum(x[0] == f for x in rows)
    assert {tuple(r) for r in found.collect()} == {(f, n, size(p, f) - n, size(g, f) - n) for f, n in hits.items()}
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()


def test_depth_of_long_chains(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else "gone") for i in range(40)] + [("p", "q"), ("q", "p"), ("r", "p"), ("t", None)]
    got = {r["symbol_key"]: r["depth"] for r in I.symbol_depth(spark.createDataFrame(rows, "symbol_key string, parent_key string")).collect()}
    assert got == {f"s{i}": i for i in range(40)} | {"p": None, "q": None, "r": None, "t": 0}


def test_decode_and_ema(spark):
    rows = spark.createDataFrame([(1, "é".encode()), (2, "한".encode("cp949")), (3, None)], "i int, raw binary")
    assert [(r["text"], r["encoding"]) for r in M.decode_bytes(rows, "raw").orderBy("i").collect()] == [("é", "utf-8"), ("한", "cp949"), (None, None)]
    xs = [3.0, 5.0, 1.0, 8.0]
    want = xs[0]
    for x in xs[1:]:
        want = 0.2 * x + 0.8 * want
    got = M.ema(spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, i int, x double"), "k", "i", "x").first()["ema"]
    assert abs(got - want) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 7, at + datetime.timedelta(minutes=i), ["created", "modified", "deleted"][i % 3]) for i in range(60)]
    batch = spark.createDataFrame(rows, "event_id bigint, file bigint, ts timestamp, change string")
    for i in range(3):
        batch.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = changes.read_events(spark, f"{tmp_path}/in/*", batch.schema)
    changes.keep_last_change(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = {tuple(r) for r in changes.latest(spark, f"{tmp_path}/out").select("file", "event_id", "ts", "change").collect()}
    assert got == {tuple(r) for r in M.coalesce_changes(batch, ["file"], "event_id").select("file", "event_id", "ts", "change").collect()}
    assert changes.latest(spark, f"{tmp_path}/none") is None
    assert changes.alert_windows(batch).agg(F.sum("n")).first()[0] == 60
