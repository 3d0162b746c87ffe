"""Cache entries against a plain replay of the log."""

import random


from tessera.operators import caches as K


def test_lookups_equal_a_replay(spark):
    rng = random.Random(4)
    by, key = ["repo", "path"], lambda q, v: q + K.KEY + v
    puts = [(rng.choice("rs"), rng.choice("ab"), rng.choice([key("q", "list"), key("q", "detail"), "q", key("x", "list")]), rng.choice("hk"), f"items{i}", i) for i in range(90)]
    gone = [(None, None, 11), ("r", "a", 30), ("s", "b", 33), ("s", "b", 12), ("z", "z", 99)]
    table, log = {}, sorted([(p[-1], 0, p) for p in puts] + [(g[-1], 1, g) for g in gone])
    for at, kind, x in log:
        if kind == 0:
            table[x[:3]] = x[3:5]
        else:
            table = {k: v for k, v in table.items() if x[0] is not None and k[:2] != x[:2]}
    asked = [(r, p, q, v, h) for r in "rsz" for p in "ab" for q in "qx" for v in ("list", " DETAIL", "other", None) for h in "hk"]
    expected = set()
    for r, p, q, v, h in asked:
        variant = "detail" if (v or "").strip().lower() == "detail" else "list"
        own, old = table.get((r, p, key(q, variant))), table.get((r, p, q))
        hit = ("variant", own[1]) if own and own[0] == h else ("legacy", old[1]) if variant == "list" and old and old[0] == h else (None, None)
        expected.add((r, p, q, v, h, hit[1], hit[0]))
    frames = [spark.createDataFrame(rows, schema).repartition(2) for rows, schema in ((asked, "repo string, path string, query string, variant string, content_hash string"), (puts, "repo string, path string, key string, content_hash string, items string, at int"), (gone, "repo string, path string, at int"))]
    assert {tuple(r) for r in K.cached_items(*frames, by).collect()} == expected and {x[-1] for x in expected} == {None, "variant", "legacy"}
    assert {tuple(r) for r in K.cached_items(frames[0], frames[1].limit(0), frames[2], by).select("hit").distinct().collect()} == {(None,)}
    everything = K.live_entries(frames[1], frames[2].limit(0), by).select(*by, "key").collect()
    assert {tuple(r) for r in everything} == {p[:3] for p in puts}


def test_counts_of_another_epoch_are_stale(spark):
    puts = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, 6, 2), ("b", 2, 7, 1), ("b", 1, 8, 2)], "name string, epoch int, n int, at int")
    asked = spark.createDataFrame([("a", 2), ("a", 1), ("b", 2), ("c", 1), ("a", None)], "name string, epoch int")
    assert {(r["name"], r.epoch): r.n for r in K.cached_counts(asked, puts, ["name"]).collect()} == {("a", 2): 6, ("a", 1): None, ("b", 2): None, ("c", 1): None, ("a", None): None}
