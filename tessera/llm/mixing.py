"""Mixing sources to target weights (operator 9).

Documents of a source are laid end to end in a pseudorandom order and packed into blocks of a fixed number of
words. Every output shard draws the sources of its slots from a multinomial; the slots of a source are numbered
through all shards, and slot j takes block permutation(j mod blocks) of pass j div blocks, a keyed permutation of
the block indices for each source and pass. Slots drawn beyond a source's quota go to the sources still short, so
the totals are exact in blocks. Blocks are joined to slots by index. Everything follows from the seed, the rows and
the parameters alone: reruns agree, and a lost task is drawn again alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import small
from tessera.sources.shared import materialize, unused

#: The mixture is a list that the driver holds; more sources than this are refused.
MOST_SOURCES = 100_000
#: Rows of a bucket in which the running word count is made; shards that one row of the plan stands for; tasks that
#: draw slots, at most.
BUCKET_ROWS, SHARDS_TOGETHER, MOST_TASKS = 500, 16, 20_000
#: Rows of a source whose running sum one task makes; the sums of such runs are summed before.
RUN = 4096


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Shares `share` times all sizes by weight; what exceeds `most` times a size goes to the others by weight."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * float(sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _hash(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the given indices: a four-round Feistel network over the next even
    power of two, walked until the value is below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            a, b = x[todo] >> half, x[todo] & mask
            for r in range(4):
                a, b = b, a ^ (_hash(b, np.uint64((key * 4 + r) % (1 << 63))) & mask)
            x[todo] = (a << half) | b
            todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def starts(df: DataFrame, at: str, value: str, run: int = RUN) -> DataFrame:
    """df (src, the integer column `at`, value) with start, the sum of the values of its source at smaller `at`. It is
    summed within runs of `at`, then over whole runs, so that a source with very many rows is not one task's."""
    t = df.withColumn("run", F.floor(F.col(at) / run))
    runs = t.groupBy("src", "run").agg(F.sum(value).alias("all")).withColumn("first", F.expr("sum(all) over (partition by src order by run) - all")).drop("all")
    inner = F.expr(f"sum({value}) over (partition by src, run order by {at}) - {value}")
    return t.withColumn("inner", inner).join(runs, ["src", "run"]).withColumn("start", F.col("inner") + F.col("first")).drop("run", "inner", "first")


def _draws(seed: int, shard: int, slots: int, share: np.ndarray) -> np.ndarray:
    return np.random.default_rng([seed, shard]).multinomial(slots, share)


def _plan(seed: int, shard_slots: int, n_slots: int, share: np.ndarray):
    """Each row `together` of the plan: the slots that its shards draw from each source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch["id"]:
                total = np.zeros(len(share), np.int64)
                for shard in range(g * SHARDS_TOGETHER, (g + 1) * SHARDS_TOGETHER):
                    total += _draws(seed, shard, int(np.clip(n_slots - shard * shard_slots, 0, shard_slots)), share)
                yield pd.DataFrame({"together": g, "src": np.arange(len(share), dtype=np.int32), "drawn": total})

    return run


def _slots(seed: int, shard_slots: int, n_slots: int, share: np.ndarray, quota: np.ndarray, drawn: np.ndarray, blocks: np.ndarray):
    """The slots of each shard with their source and block."""
    over, short = np.maximum(drawn - quota, 0), np.maximum(quota - drawn, 0)
    over_at, short_ends = np.cumsum(over) - over, np.cumsum(short)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, before in zip(batch["together"], batch["before"], strict=True):
                at = np.zeros(len(share), np.int64)
                at[[x["src"] for x in before]] = [x["at"] for x in before]
                for shard in range(g * SHARDS_TOGETHER, (g + 1) * SHARDS_TOGETHER):
                    counts = _draws(seed, shard, int(np.clip(n_slots - shard * shard_slots, 0, shard_slots)), share)
                    src = np.repeat(np.arange(len(share)), counts)
                    if not len(src):
                        continue
                    j = np.arange(len(src)) - np.repeat(np.cumsum(counts) - counts, counts) + at[src]
                    at += counts
                    spare = np.flatnonzero(j >= quota[src])
                    excess = over_at[src[spare]] + j[spare] - quota[src[spare]]
                    to = np.searchsorted(short_ends, excess, "right")
                    src[spare], j[spare] = to, drawn[to] + excess - (short_ends[to] - short[to])
                    block = np.zeros(len(src), np.int64)
                    for s in np.unique(src):
                        own = np.flatnonzero(src == s)
                        turn, index = np.divmod(j[own], blocks[s])
                        for p in np.unique(turn):
                            block[own[turn == p]] = permute(index[turn == p], int(blocks[s]), (seed * 1_000_003 + int(s)) * 4099 + int(p))
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(len(src)), "src": src.astype(np.int32), "block": block})

    return run


class Mix:
    """What mix_sources() has planned. sources: one entry per source (name, size, target, blocks, quota in blocks)."""

    def __init__(self, sources: list[dict], rows: DataFrame, spans: DataFrame, slots: DataFrame):
        self.sources, self.rows, self.spans, self.slots = sources, rows, spans, slots

    def taken(self) -> DataFrame:
        """One row per document: doc_id, source, size, source_size, target, taken (words of its blocks in the mix)."""
        uses = self.slots.groupBy("src", "block").agg(F.count("*").alias("uses"))
        # merge hints: the planner cannot know how many rows the draws make and would broadcast them
        took = self.spans.join(uses.hint("merge"), ["src", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
        spark = self.rows.sparkSession
        about = spark.createDataFrame([(i, s["size"], s["target"]) for i, s in enumerate(self.sources)], "src int, source_size bigint, target double")
        return self.rows.join(took.hint("merge"), "row", "left").join(small(about, 32 * len(self.sources)), "src", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 32, shard_slots: int = 4096, seed: int = 9, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Mix:
    """Plans the mix of all documents. Sources in code point order, null last, take the weights in turn.

    Null, empty and white texts have size 0 and are never taken. Rows that repeat a doc_id are documents each. An
    empty table gives an empty mix. No document is taken more than ceil(most) times. Other columns are not read.
    """
    spark = docs.sparkSession
    size = F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.cast("bigint").alias("size"))
    found = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    names = found.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).take(MOST_SOURCES + 1)
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = sorted(names, key=lambda x: (x["source"] is None, (x["source"] or "").encode()))
    sizes = [x["size"] for x in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
    blocks = [-(-n // block_words) for n in sizes]
    quota = [min(round(t * b / n), int(most * b)) if n else 0 for t, b, n in zip(goal, blocks, sizes, strict=True)]
    sources = [{"name": x["source"], "size": n, "target": t, "blocks": b, "quota": q} for x, n, t, b, q in zip(names, sizes, goal, blocks, quota, strict=True)]
    index = spark.createDataFrame([(x["source"], i, max(1, x["n"] // BUCKET_ROWS)) for i, x in enumerate(names)], "name string, src int, buckets bigint")
    rows = found.join(small(index, sum(64 + len((x["source"] or "").encode()) for x in names)), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # where each document begins among its source's words: within its bucket, and the buckets before it
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "buckets")).drop("buckets")
    sums = starts(rows.groupBy("src", "bucket").agg(F.sum("size").alias("all")), "bucket", "all").drop("all")
    placed = rows.withColumn("at", F.expr("sum(size) over (partition by src, bucket order by xxhash64(doc_id, 1), doc_id, size, row rows between unbounded preceding and current row) - size"))
    placed = placed.join(sums, ["src", "bucket"]).where("size > 0").withColumn("at", F.col("at") + F.col("start"))
    spans = placed.withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + size - 1) div {block_words})")))
    spans = spans.select("row", "src", "block", F.expr(f"least(at + size, (block + 1) * {block_words}) - greatest(at, block * {block_words})").alias("words"))
    n_slots = sum(quota)
    q = np.array(quota, np.int64)
    chance = q / max(n_slots, 1)
    shards = -(-n_slots // shard_slots)
    groups = -(-shards // SHARDS_TOGETHER)
    tasks = max(1, min(groups, MOST_TASKS))
    plan = spark.range(0, groups, 1, tasks).mapInPandas(_plan(seed, shard_slots, n_slots, chance), "together bigint, src int, drawn bigint")
    plan = materialize(plan, "plan")
    drawn = np.zeros(len(names), np.int64)
    for x in plan.groupBy("src").agg(F.sum("drawn").alias("drawn")).collect():  # a row per source
        drawn[x["src"]] = x["drawn"]
    before = starts(plan, "together", "drawn").groupBy("together").agg(F.collect_list(F.struct("src", F.col("start").alias("at"))).alias("before"))
    # few small rows make very many slots: a fixed number of partitions, which adaptive execution does not make fewer
    slots = before.repartition(tasks, "together").mapInPandas(_slots(seed, shard_slots, n_slots, chance, q, drawn, np.array(blocks, np.int64)), "shard bigint, slot bigint, src int, block bigint")
    return Mix(sources, rows, spans, slots)


def mixed_documents(docs: DataFrame, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them: taken / size times, a fraction by a draw from the id.

    Rows without words are never taken. Rows that repeat an id and a size share what the mix takes of them evenly. All
    columns of docs are kept, whatever their names; an empty table gives an empty one."""
    taken = mix_sources(docs, seed=seed, id_col=id_col, text_col=text_col, **options).taken().groupBy("doc_id", "size").agg(F.avg("taken").alias("taken"))
    own, words, much, times = (unused(x, docs) for x in ("mix_id", "mix_words", "mix_taken", "mix_times"))
    size = F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("bigint")
    taken = materialize(taken.where("taken > 0").select(F.col("doc_id").alias(own), F.col("size").alias(unused("mix_size", docs)), F.col("taken").alias(much)), "taken")
    joined = docs.withColumn(words, size).join(taken, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(words) == F.col(unused("mix_size", docs))))
    draw = F.pmod(F.xxhash64(F.lit(int(seed)), F.col(id_col), F.lit(77)), F.lit(1_000_000)) / 1_000_000.0
    joined = joined.withColumn(times, F.floor(F.col(much) / F.col(words) + draw).cast("int")).where(F.col(times) > 0)
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))
