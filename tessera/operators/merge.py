"""Keyed merges of snapshots, tombstones, guarded and anti-downgrade updates, change coalescing and matching."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key. One full join by key; no window over a hot key."""
    n = new.select(*keys, F.struct(*new.columns).alias("__new"))
    o = old.select(*keys, F.struct(*old.columns).alias("__old"))
    both = o.join(n, keys, "full")
    return both.select(F.coalesce("__new", "__old").alias("x")).select("x.*")


def tombstone_missing(files: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Live files that a scan has not seen become deleted."""
    marked = files.join(seen.select(*keys).distinct().withColumn("__seen", F.lit(True)), keys, "left")
    return marked.withColumn("is_deleted", F.col("is_deleted") | F.col("__seen").isNull()).drop("__seen")


def guarded(rows: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose content hash is the only live one of their file."""
    live = files.where("not is_deleted").groupBy(*keys).agg(F.min("content_hash").alias("low"), F.max("content_hash").alias("high"))
    return rows.join(live, keys).where("low = high and content_hash = low").drop("low", "high")


def keep_better(old: DataFrame, new: DataFrame, keys: list[str], better: str) -> DataFrame:
    """New rows replace old ones but where `better`, a condition over old and new (structs), says to keep the old."""
    both = old.select(*keys, F.struct(*old.columns).alias("old")).join(new.select(*keys, F.struct(*new.columns).alias("new")), keys, "full")
    keep = F.coalesce(F.expr(better), F.lit(False)) | F.col("new").isNull()
    return both.select(F.when(keep, F.col("old")).otherwise(F.col("new")).alias("x")).select("x.*")


def coalesce_changes(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key; combined before the shuffle."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def prune(events: DataFrame, since, most: int, *order) -> DataFrame:
    """Events since a time, the newest `most` of them."""
    return events.where(since).orderBy(*order).limit(most)


def unambiguous(symbols: DataFrame, name: str, key: str) -> DataFrame:
    """Names that stand for one key only."""
    return symbols.groupBy(name).agg(F.min(key).alias(key), F.max(key).alias("__high")).where(F.col(key) == F.col("__high")).drop("__high")


def sync_plan(found: DataFrame, indexed: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    """What to index and what to remove: a full join of what is there with what is indexed."""
    f = found.select(*keys, F.struct(*state).alias("f"))
    i = indexed.select(*keys, F.struct(*state).alias("i"))
    plan = F.when(F.col("f").isNull(), "delete").when(F.col("i").isNull() | ~F.col("f").eqNullSafe(F.col("i")), "upsert")
    return f.join(i, keys, "full").select(*keys, plan.alias("change")).where("change is not null")


def greedy_match(predicted: DataFrame, golden: DataFrame, by: str, tolerance: int = 2, field_tolerance: int = 512) -> DataFrame:
    """Per file, one-to-one matches of equal names within a line tolerance: golden symbols in order of line each take
    the best free prediction (10 for the same kind, plus the tolerance less the gap; ties: the smaller line).
    Both: by, name, kind, line. Returns by, tp, fp, fn. Symbols without a line match nothing.

    Matches never cross names, nor a gap in a name's lines above the larger tolerance: these runs are matched each in
    order, with no more in memory than the lines within the tolerance of one another; equal symbols are counted first."""
    reach = max(tolerance, field_tolerance)
    key = [by, "name"]
    side = lambda df, p, g: df.select(*key, "kind", F.col("line").cast("bigint").alias("line"), F.lit(p).alias("p"), F.lit(g).alias("g"))
    rows = side(predicted, 1, 0).unionAll(side(golden, 0, 1)).groupBy(*key, "kind", "line").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    w = Window.partitionBy(*key).orderBy("line")
    gap = F.col("line") - F.lag("line").over(w)
    rows = rows.withColumn("far", F.coalesce((gap > reach).cast("int"), F.lit(0))).withColumn("run", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = rows.select(*key, "run", "line", "kind", "p", "g").repartition(*key, "run").sortWithinPartitions(*key, "run", "line", F.col("kind").asc_nulls_last())

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, free = None, deque(), {}  # golden (line, kind, count, most) in order; line -> kind -> predictions

        def settle(before: int | None) -> int:
            """Matches of the waiting symbols that no line from `before` on can reach."""
            hits = 0
            while waiting and (before is None or waiting[0][0] + waiting[0][3] < before):
                line, kind, left, most = waiting.popleft()
                near = range(line - most, line + most + 1) if 2 * most < len(free) else [n for n in free if abs(n - line) <= most]
                open_ = [(10 * (k == kind) + most - abs(n - line), -n, k is not None, k or "", n, k) for n in near for k in free.get(n, ())]
                for *_, n, k in sorted(open_, key=lambda x: x[:4], reverse=True):
                    take = min(left, free[n][k])
                    hits, left = hits + take, left - take
                    free[n][k] -= take
                    if not free[n][k]:
                        del free[n][k]
                    if not free[n]:
                        del free[n]
                    if not left:
                        break
            return hits

        for batch in batches:
            totals: dict = {}
            for file, name, run, line, kind, p, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (file, name, run):
                    if now:
                        totals.setdefault(now[0], [0, 0, 0])[0] += settle(None)
                    now = (file, name, run)
                    free.clear()
                total = totals.setdefault(file, [0, 0, 0])
                total[1] += p
                total[2] += g
                if line is None:
                    continue
                total[0] += settle(line)
                low = (waiting[0][0] if waiting else line) - reach
                if len(free) > 4 * reach + 2:
                    for n in [n for n in free if n < low]:
                        del free[n]
                if p:
                    free.setdefault(line, {})[kind] = p
                if g:
                    waiting.append((line, kind, g, field_tolerance if kind == "field" else tolerance))
            yield out(totals)
        if now:
            yield out({now[0]: [settle(None), 0, 0]})

    def out(totals: dict) -> pa.RecordBatch:
        columns = zip(*totals.values(), strict=True) if totals else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(totals), kinds), *(pa.array(c, pa.int64()) for c in columns)], ["file", "tp", "np", "ng"])

    kinds = to_arrow_type(predicted.schema[by].dataType)
    found = ordered.mapInArrow(matched, f"file {predicted.schema[by].dataType.simpleString()}, tp bigint, np bigint, ng bigint")
    return found.groupBy(F.col("file").alias(by)).agg(F.sum("tp").alias("tp"), F.sum(F.col("np") - F.col("tp")).alias("fp"), F.sum(F.col("ng") - F.col("tp")).alias("fn"))


def decode_bytes(rows: DataFrame, column: str, encodings: tuple[str, ...] = ("utf-8", "cp949", "latin-1")) -> DataFrame:
    """Adds text and encoding: the first encoding that decodes the bytes."""
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def first(raw):
            for e in encodings if raw is not None else ():
                try:
                    return bytes(raw).decode(e), e
                except UnicodeDecodeError:
                    continue
            return None, None

        for batch in batches:
            found = [first(x) for x in batch[column]]
            yield batch.assign(text=[x[0] for x in found], encoding=[x[1] for x in found])

    return rows.mapInPandas(run, f"{kinds}, text string, encoding string")


def ema(samples: DataFrame, by: str, order: str, value: str, alpha: float = 0.2) -> DataFrame:
    """Exponential moving average in order, seeded with the first sample: each sample's weight in closed form, so the
    sum is combined before the shuffle; only the positions need a window."""
    w = Window.partitionBy(by)
    t = samples.select(by, value, F.row_number().over(w.orderBy(order)).alias("i"), F.count("*").over(w).alias("n"))
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(alpha)
    return t.groupBy(by).agg(F.sum(weight * F.col(value)).alias("ema"))
