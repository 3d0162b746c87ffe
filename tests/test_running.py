import datetime
import random

from pyspark.sql import functions as F

from tessera.operators.running import running_sum, trailing_count


def test_trailing_counts_equal_a_loop(spark):
    rng, start = random.Random(8), datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), start + datetime.timedelta(seconds=rng.choice((rng.randrange(300), rng.randrange(30_000)))), i) for i in range(700)] + [(1000, "b", None, 1), (1001, "b", None, 1)]
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp, n int")
    got = {r["i"]: r["seen"] for r in trailing_count(df, ["k"], "ts", 60, "seen").collect()}
    late = lambda a, b: (a - b).total_seconds()
    assert got == {i: sum(k == k2 and (ts == ts2 if ts is None or ts2 is None else 0 <= late(ts, ts2) <= 60) for _, k2, ts2, _ in rows) for i, k, ts, _ in rows}
    assert trailing_count(df.limit(0), ["k"], "ts", 60, "seen").count() == 0


def test_running_sums_across_pieces(spark):
    rows = [("a", x, x % 3 - 1) for x in range(-50, 50)] + [("b", 7, 5), ("b", 7, 6), (None, 0, 1)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    got = {(r["k"], r["t"]): r["s"] for r in running_sum(df, ["k"], "t", "v", "s", 8).collect()}
    assert got == {(k, t): sum(v for k2, t2, v in rows if k2 == k and t2 <= t) for k, t, _ in rows}
    assert running_sum(df, [], "t", "v", "s", 8).orderBy(F.desc("t")).first()["s"] == sum(v for *_, v in rows)
