import math
import random

from pyspark.sql import functions as F

from tessera.operators.percentiles import exact_percentiles, value_bin


def test_percentiles_equal_a_sort(spark):
    rng = random.Random(1)
    draw = [lambda: rng.gauss(0, 5), lambda: 7.0, lambda: rng.choice([0.0, -0.0, -3.0, 1e300, -1e-300, float("inf")]), lambda: float(rng.randrange(9)), lambda: rng.uniform(1000, 1001)]
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(draw)()) for _ in range(3000)] + [("one", 4.0), ("none", None), ("two", 1.0), ("two", 2.0), ("two", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    asked = {"low": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "high": 1.0}
    smooth, steps = ({r["k"]: r for r in exact_percentiles(df, ["k"], F.col("v"), asked, d).collect()} for d in (False, True))
    groups = {k: sorted(v for g, v in rows if g == k and v is not None) for k in ("a", "b", None, "one", "two")}
    assert set(smooth) == set(steps) == set(groups)
    for k, vs in groups.items():
        for name, p in asked.items():
            at = p * (len(vs) - 1)
            a, b = vs[math.floor(at)], vs[math.ceil(at)]
            want = a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b if math.ceil(at) > at else a
            assert math.isclose(smooth[k][name], want, rel_tol=1e-9) or smooth[k][name] == want
            assert steps[k][name] == vs[max(1, math.ceil(p * len(vs))) - 1]
    assert exact_percentiles(df.limit(0), ["k"], F.col("v"), asked).count() == 0
    everything = sorted(v for _, v in rows if v is not None)
    assert exact_percentiles(df, [], F.col("v"), {"p": 0.5}, True).first()["p"] == everything[math.ceil(len(everything) / 2) - 1]


def test_bins_keep_the_order(spark):
    rng = random.Random(2)
    vs = sorted([rng.choice([-1, 1]) * 10 ** rng.uniform(-320, 308) for _ in range(500)] + [0.0, 5e-324, -5e-324, 1.7e308, float("inf"), float("-inf"), 1.0, 1.0000001]) + [float("nan")]
    bins = [r[1] for r in spark.createDataFrame(list(enumerate(vs)), "i int, v double").select("i", value_bin(F.col("v"))).orderBy("i").collect()]
    assert bins == sorted(bins) and bins[-1] > bins[-2]
