"""Tolerance matches against a plain greedy matcher, proxies and mergeable summaries."""

import random

from pyspark.sql import functions as F

from tessera.operators import quality as Q

SCHEMA = "path string, lang string, name string, bucket string, kind string, line int, end_line int"


def symbols(rng, n, spread):
    buckets = ["class", "method", "field", "function", "other"]
    rows = []
    for _ in range(n):
        line = rng.randrange(spread)
        rows.append((f"p{rng.randrange(2)}", rng.choice(["java", "python", "go"]), rng.choice("ab"), rng.choice(buckets), rng.choice(["5", "6", None]), line, line + rng.choice((0, 0, 1, 5, 40))))
    return rows


def brute(found, known, tolerance=2):
    """Found symbols in order, each over all free known ones."""
    key = lambda x: (x[5], x[6], x[4] is not None, x[4] or "", x[3])
    free, out = sorted(known, key=key), []
    for f in sorted(((*x[:6], x[5]) for x in found), key=key):
        most = max(tolerance, Q.GAPS.get(f[1], {}).get(f[3], 0))
        best = None
        for i, k in enumerate(free):
            if k[:3] == f[:3]:
                gap = 0 if k[5] <= f[5] <= k[6] else min(abs(f[5] - k[5]), abs(f[5] - k[6]))
                same = k[3] == f[3]
                rank = 0 if same and gap <= tolerance else 1 if same and gap <= most else 2 if gap <= tolerance else None
                if rank is not None and (best is None or (rank, gap) < best[:2]):
                    best = (rank, gap, i)
        if best:
            k = free.pop(best[2])
            out += [("found", *f, True, k[3] == f[3], best[1]), ("known", *k, True, k[3] == f[3], best[1])]
        else:
            out.append(("found", *f, False, False, None))
    return out + [("known", *k, False, False, None) for k in free]


def test_matches_equal_the_plain_matcher(spark):
    for seed, n, spread in ((1, 60, 40), (2, 80, 2000), (3, 40, 8)):
        rng = random.Random(seed)
        found, known = symbols(rng, n, spread), symbols(rng, n, spread)
        df = Q.tolerance_match(spark.createDataFrame(found, SCHEMA).repartition(3), spark.createDataFrame(known, SCHEMA).repartition(2), ["path"])
        got = [(r.side, r.path, r.lang, r.name, r.bucket, r.kind, r.line, r.end_line, r.matched, r.same_kind, r.gap) for r in df.collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(found, known)))
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.tolerance_match(empty, empty, ["path"]).collect() == []
    assert [r.matched for r in Q.tolerance_match(empty, spark.createDataFrame(known[:3], SCHEMA), ["path"]).collect()] == [False] * 3


def test_normalised_symbols(spark):
    rows = [("a", "java", "x", "field", 5, 1), ("a", "java", "x", "7", 3, None), ("a", "java", "f()", "METHOD ", None, None), ("a", "java", "new T", "5", 1, 1), ("a", "python", "x", "field", 1, 1), ("a", "python", "x", "field", 9, 9), ("a", "python", None, "5", 1, 1), ("a", None, "y", None, -4, -9)]
    got = Q.normalised(spark.createDataFrame(rows, "path string, lang string, name string, kind string, line int, end_line int"), ["path"]).collect()
    assert sorted(str((r.lang, r.name, r.bucket, r.kind, r.line, r.end_line)) for r in got) == sorted(map(str, [
        ("java", "x", "field", "7", 3, 3), ("java", "f", "method", "method", 0, 0), ("python", "x", "field", "field", 1, 1), ("python", "x", "field", "field", 9, 9), (None, "y", "other", None, 0, 0)]))


def test_quality_of_files_and_halves_of_a_summary(spark):
    rng = random.Random(9)
    found, known = symbols(rng, 80, 60), symbols(rng, 70, 60)
    known += [("p0", "java", "MadeBuilder", "class", "5", 1, 1), ("p1", "java", "Out$In", "class", "5", 1, 1), ("p3", "python", "z", "class", "5", 1, 1)]
    matches = Q.tolerance_match(spark.createDataFrame(found, SCHEMA), spark.createDataFrame(known, SCHEMA), ["path"])
    files = Q.file_quality(matches, ["path"]).collect()
    plain = brute(found, known)
    for r in files:
        mine = [x for x in plain if x[1:3] == (r.path, r.lang)]
        made = [x for x in mine if x[0] == "known" and not x[8] and r.lang == "java" and x[3] == "MadeBuilder"]
        f, k, hits = [x for x in mine if x[0] == "found"], [x for x in mine if x[0] == "known"], [x for x in mine if x[0] == "found" and x[8]]
        assert (r.found, r.known, r.matched) == (len(f), len(k) - len(made), len(hits))
        assert r.recall == (len(hits) / r.known if r.known else 1) and r.precision == (len(hits) / len(f) if f else 1)
        assert r.place_rate == (sum(x[10] <= 2 for x in hits) / len(hits) if hits else 1)
        assert ("no_proxy_matches" in r.flags) == (r.known > 0 and not hits) and ("ast_missing_symbols" in r.flags) == (r.known > len(f))
        assert sum(x.n for x in r.missing) == sum(not x[8] for x in k) - len(made)
        assert {"missing_nested_type"} <= {x.pattern for x in r.missing} if (r.path, r.lang) == ("p1", "java") else True
    t = Q.file_quality(matches, ["path"])
    whole = Q.shadow_counts(t)
    halves = Q.merge_shadow(Q.shadow_counts(t.where("path = 'p0'")).unionByName(Q.shadow_counts(t.where("path <> 'p0'"))))
    assert sorted(map(str, whole.collect())) == sorted(map(str, halves.collect()))
    summary = {r.lang: r for r in Q.shadow_summary(halves, top=2).collect()}
    assert summary["go"].files == 2 and abs(summary["go"].recall - sum(r.recall for r in files if r.lang == "go") / 2) < 1e-6
    counts = {}
    for r in files:
        for x in r.missing if r.lang == "java" else ():
            counts[x.pattern] = counts.get(x.pattern, 0) + x.n
    assert summary["java"].top_missing == [f"{p}={n}" for p, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2]]
    assert Q.shadow_summary(whole.limit(0)).collect() == [] and Q.shadow_counts(t.where(F.lit(False))).collect() == []


def test_stage_exit(spark):
    summary = spark.createDataFrame([("a", 0.5, 3), ("b", 90.0, 1), ("c", None, 9), ("d", 1.0, 0)], "lang string, recall double, files int")
    assert abs(Q.recall_regression(summary).first()[0] - 100 * (1 - (1.5 + 0.9 + 1.0) / 5)) < 1e-9
    assert Q.recall_regression(summary.limit(0)).first()[0] is None
    rows = [(95.0, 10.0, 30.0, None, 1.0, 10.0, None, 4), (95.0, 10.0, 6.0, 4.0, 0.0, 13.0, 11.0, 4), (99.0, 0.0, 5.2, 4.0, 1.1, 1.0, None, 0), (99.0, 0.0, 5.0, 5.0, 1.0, None, None, 0), (None, 0.0, None, None, None, 1.0, None, 0), (99.0, 0.0, 5.0, None, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, "parse_pct double, degraded_pct double, admission_pct double, admission_base double, regression_pct double, pending_p95 double, pending_base double, pending int")
    assert [(r.a_to_b, r.b_to_c) for r in Q.stage_exit(df).collect()] == [(True, False), (False, False), (True, False), (True, True), (False, False), (True, False)]
