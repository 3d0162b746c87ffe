import datetime
import random

import pytest

from tessera.streaming import folds

AT = datetime.datetime(2024, 1, 1)
S = 1_000_000


def us(seconds):
    return int((AT - datetime.datetime(1970, 1, 1)).total_seconds() * S) + round(seconds * S)


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def upgrade_rows(n, seed=3):
    """Events of four keys (one has half of them) in bursts, with ties and a key that is null."""
    rng = random.Random(seed)
    kinds = ["flush"] * 8 + ["warm", "startup", "odd", None]
    return [(i, rng.choice(["a", "a", "a", "b", "c", None]), AT + datetime.timedelta(milliseconds=100 * rng.randrange(8 * n)), rng.choice(kinds), rng.choice([0, 3, 40, 90, None])) for i in range(n)]


UPGRADES = "id bigint, repo string, ts timestamp, kind string, files bigint"


def test_upgrades_wait_for_a_warm_repository(spark):
    rows = [(1, "a", 0, "flush", 4), (2, "a", 1, "flush", 5), (3, "a", 3, "warm", None), (4, "a", 10, "flush", 70), (5, "a", 10.5, "flush", 1), (6, "a", 11, "flush", 2), (7, "b", 0, "flush", 9), (8, "c", 0, "startup", 3), (9, "c", 2, "startup", 0)]
    df = spark.createDataFrame([(i, r, AT + datetime.timedelta(seconds=s), k, n) for i, r, s, k, n in rows], UPGRADES)
    got = {tuple(r) for r in folds.fold_table(df, "repo", "ts", "id", folds.upgrade_batches()).collect()}
    # the flush at 11 s comes as the batch of 10 s closes: it is drained with what that batch left
    assert got == {("a", us(3), "warm", 2, 9), ("a", us(11), "flush", 2, 50), ("a", us(12), "flush", 1, 23), ("c", us(1), "flush", 1, 3)}
    assert folds.fold_table(df.limit(0), "repo", "ts", "id", folds.upgrade_batches()).count() == 0


def test_no_file_is_lost_or_taken_twice(spark):
    rows = upgrade_rows(400)
    got = folds.fold_table(spark.createDataFrame(rows, UPGRADES), "repo", "ts", "id", folds.upgrade_batches(most=50)).collect()
    for repo in ("a", "b", "c", None):
        mine = sorted((r for r in rows if r[1] == repo), key=lambda r: (r[2], r[0]))
        opened = any(r[3] == "warm" or r[3] == "startup" and (r[4] or 0) > 0 for r in mine)
        total = sum(r[4] or 0 for r in mine if r[3] in ("flush", "startup"))
        assert opened and sum(r["files"] for r in got if r["repo"] == repo) == total
    assert max(r["files"] for r in got) == 50


def run_stream(spark, folder, rows, schema, key, machine, parts, late="30 seconds", stop=None):
    """The stream's rows; written by `parts` files in turn, each within the lateness; at last an event far ahead of another key."""
    df = spark.createDataFrame(rows, schema)
    (folder / "in").mkdir(exist_ok=True)
    ordered = sorted(rows, key=lambda r: r[2])
    size = -(-len(ordered) // parts)
    for i in range(parts):
        part = ordered[i * size:(i + 1) * size]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/p={i:02d}")
    end = max(r[2] for r in rows) + datetime.timedelta(days=2)
    spark.createDataFrame([(10**6, "end", end, *[None] * (len(schema.split(",")) - 3))], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/p={parts:02d}")
    out = []
    for glob in [f"{folder}/in/p=0[0-{stop}]", f"{folder}/in/*"] if stop is not None else [f"{folder}/in/*"]:
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(glob)
        folded = folds.fold_stream(source, key, "ts", "id", machine, late)
        query = folded.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        out.append(query.lastProgress)
    return spark.read.parquet(f"{folder}/out"), out


def test_stream_with_timers_equals_the_table_and_survives_a_restart(rocks, tmp_path):
    rows = upgrade_rows(120)
    machine = folds.upgrade_batches(most=50, idle=60 * S)
    want = folds.fold_table(rocks.createDataFrame(rows, UPGRADES), "repo", "ts", "id", machine)
    got, progress = run_stream(rocks, tmp_path, rows, UPGRADES, "repo", machine, 4, stop=1)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert order(got) == order(want) and want.count() > 10
    # every key but that of the last event, which still waits, was idle and has left the store
    assert progress[-1]["stateOperators"][0]["customMetrics"]["numDeletedTimers"] >= 0
    state = rocks.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "kept").load()
    assert state.count() == 0


def test_stream_of_admissions_equals_a_loop(rocks, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice("ppj"), AT + datetime.timedelta(milliseconds=rng.randrange(300_000)), f"f{rng.randrange(6)}", rng.choice([None, None, None, "pressure_burst_exceeded", "mode_not_allowed"])) for i in range(150)]
    want, calls, waits = set(), {}, {}
    for i, lang, ts, file, refused in sorted(rows, key=lambda r: (r[2], r[0])):
        at = us((ts - AT).total_seconds())
        recent = [x for x in calls.get(lang, []) if at - x <= 60 * S]
        if len(recent) >= 3:
            reason, more = "pressure_rate_exceeded", 30
        elif refused:
            reason, more = refused, 10
        elif waits.get((lang, file), 0) > at:
            reason, more = "cooldown_active", 15
        else:
            calls[lang] = [*recent, at]
            waits.pop((lang, file), None)
            want.add((lang, i, file, None, None))
            continue
        waits[lang, file] = max(at, waits.get((lang, file), 0)) + more * S
        want.add((lang, i, file, reason, waits[lang, file]))
    schema = "id bigint, lang string, ts timestamp, file string, refused string"
    table = folds.fold_table(rocks.createDataFrame(rows, schema), "lang", "ts", "id", folds.admission(3))
    assert {tuple(r) for r in table.collect()} == want
    got, _ = run_stream(rocks, tmp_path, rows, schema, "lang", folds.admission(3), 3)
    assert {tuple(r) for r in got.collect() if r["lang"] != "end"} == want


def test_hold_by_hand_is_not_released(spark):
    kinds = ["ok", "hold", "warn", "ok", "release", "critical", "warn", "ok", "auto_off", "warn", "auto_on", "warn", None, "ok"]
    df = spark.createDataFrame([(i, "p", AT + datetime.timedelta(seconds=i), k) for i, k in enumerate(kinds)], "id bigint, scope string, ts timestamp, kind string")
    got = [(r["held"], r["action"]) for r in folds.fold_table(df, "scope", "ts", "id", folds.auto_hold()).orderBy("id").collect()]
    assert got == [(False, "NO_CHANGE"), (True, "BY_HAND"), (True, "NO_CHANGE"), (True, "NO_CHANGE"), (False, "BY_HAND"), (True, "HOLD_ENABLED"), (True, "NO_CHANGE"), (False, "HOLD_RELEASED"),
                   (False, "SWITCHED"), (False, "AUTO_DISABLED"), (False, "SWITCHED"), (True, "HOLD_ENABLED"), (True, "NO_CHANGE"), (False, "HOLD_RELEASED")]
