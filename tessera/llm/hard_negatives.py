"""Hard-negative mining by product quantisation with stored residual norms (operator 11).

Vectors are cut into parts of two components; each part is stored as the number of its nearest codeword together with the norm
of what is left. An anchor's score with a row is then known up to the sum over parts of the anchor's norm times the row's
residual norm: a bound that holds whatever codewords there are. Rows lie in chunks; every chunk meets all anchors, its
lookup tables and bounds leave the candidates, and only these are scored exactly with whole numbers. Codewords are fitted on
about SAMPLE_ROWS rows; they decide how many candidates are left, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import materialize

#: Rows that the codewords are fitted on, about.
SAMPLE_ROWS = 8192
#: Rows of a chunk: what a task holds at once.
CHUNK_ROWS = 8192
#: Anchors that meet a chunk at once.
ANCHOR_ROWS = 128
#: Components of a part, and codewords of a part.
WIDTH, WORDS = 2, 256


def codebook(sample: np.ndarray, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """(parts, WORDS, WIDTH) codewords by k-means, from each part's distinct values; the last part may be filled up with zeros."""
    parts, rng = _parts(sample), np.random.default_rng(seed)
    out = np.zeros((parts.shape[1], WORDS, WIDTH))
    for m in range(parts.shape[1]):
        x = parts[:, m]
        seeds = np.unique(x, axis=0)
        c = seeds[rng.permutation(len(seeds))[:WORDS]]
        for _ in range(rounds):
            own = _nearest(x, c)
            n = np.bincount(own, minlength=len(c))
            sums = np.stack([np.bincount(own, x[:, d], len(c)) for d in range(WIDTH)], 1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out[m, : len(c)] = c
    return out


def _parts(x: np.ndarray) -> np.ndarray:
    x = np.pad(x.astype(np.float64), ((0, 0), (0, -x.shape[1] % WIDTH)))
    return x.reshape(len(x), -1, WIDTH)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def encode(x: np.ndarray, book: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms, rounded up) by part; without a codebook everything is residual."""
    parts = _parts(x)
    codes, rest = np.zeros(parts.shape[:2], np.uint8), np.empty(parts.shape[:2], np.float32)
    for m in range(parts.shape[1]):
        r = parts[:, m]
        if book is not None:
            codes[:, m] = _nearest(r, book[m])
            r = r - book[m][codes[:, m]]
        rest[:, m] = np.nextafter(np.sqrt((r * r).sum(1)).astype(np.float32), np.float32(np.inf))
    return codes, rest


class _Chunk:
    """Rows of one length, with their codes."""

    def __init__(self, row: dict):
        arr = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.labels, self.dim = arr("ids", np.int64), arr("labels", np.int64), row["dim"]
        self.x = arr("vecs", np.int32).reshape(len(self.ids), -1).astype(np.float64)
        self.codes, self.rest = (arr(c, k).reshape(len(self.ids), -1) for c, k in (("codes", np.uint8), ("rest", np.float32)))
        self.top = np.abs(self.x).max(initial=0)
        self.longest = np.sqrt((self.x * self.x).sum(1)).max(initial=0)

    def bounds(self, q: np.ndarray, book: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Below and above the scores of the anchors (rows of q) with the chunk's rows."""
        parts = _parts(q)
        mid = np.zeros((len(q), len(self.ids)))
        if book is not None:
            for m in range(parts.shape[1]):
                mid += (parts[:, m] @ book[m].T)[:, self.codes[:, m]]  # the lookup table of a part
        norms = np.sqrt((parts * parts).sum(2))
        wide = norms @ self.rest.T.astype(np.float64)
        wide += 1e-6 + 1e-12 * np.sqrt((q * q).sum(1))[:, None] * self.longest  # rounding of doubles
        return mid - wide, mid + wide

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x = self.x[rows]
        if self.dim * self.top * np.abs(q).max(initial=0) < 2**53:
            return (x @ q).astype(np.int64)
        return x.astype(np.int64) @ q.astype(np.int64)


def _best(chunk: _Chunk, q: np.ndarray, rows: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, span: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of the first k of the rows whose score lies within the span: the bounds leave candidates, which are scored."""
    low, high = low[rows], high[rows]
    least, sure = -np.inf, np.ones(len(rows), bool)
    if span:
        least, sure = span[0], (low >= span[0]) & (high <= span[1])
        fits = (high >= span[0]) & (low <= span[1])
        rows, low, high, sure = rows[fits], low[fits], high[fits], sure[fits]
    if sure.sum() >= k:  # k rows surely reach this
        least = max(least, np.partition(low[sure], -k)[-k])
    rows = rows[high >= least]
    score = chunk.exact(q, rows)
    if span:
        inside = (score >= span[0]) & (score <= span[1])
        rows, score = rows[inside], score[inside]
    first = np.lexsort((chunk.ids[rows], -score))[:k]
    return rows[first], score[first]


def _meet(books: dict[int, np.ndarray], pick: Callable) -> Callable:
    """Chunks of a group, then the anchors that meet them: yields what pick(chunk, anchor, low, high) finds for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, chunks, waiting = None, [], []
        for batch in batches:
            out = []
            for one in batch.to_pylist():
                if one["g"] != group:
                    out += answers(chunks, waiting)
                    group, chunks, waiting = one["g"], [], []
                if one["key"] is None:
                    chunks.append(_Chunk(one))
                    continue
                waiting.append(one)
                if len(waiting) == ANCHOR_ROWS:
                    out += answers(chunks, waiting)
                    waiting = []
            yield table(out)
        yield table(answers(chunks, waiting))

    def answers(chunks: list[_Chunk], anchors: list[dict]) -> list[tuple]:
        out = []
        for chunk in chunks:
            some = [x for x in anchors if len(x["vec"]) == chunk.dim]
            if not some:
                continue
            q = np.array([x["vec"] for x in some], np.float64)
            low, high = chunk.bounds(q, books.get(chunk.dim))
            for i, one in enumerate(some):
                for n, rows, scores in pick(chunk, one, q[i], low[i], high[i]):
                    out += [(one["key"], n, r, s) for r, s in zip(chunk.ids[rows].tolist(), scores.tolist(), strict=True)]
        return out

    def table(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "n", "id", "score"])

    return run


def _chunks(books: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def pack(dim: int) -> pa.RecordBatch:
            ids, labels, vecs = zip(*held.pop(dim), strict=True)
            x = np.array(vecs, np.int32)
            codes, rest = encode(x, books.get(dim))
            raw = [np.array(ids, np.int64), np.array(labels, np.int64), x, codes, rest]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([r.tobytes()]) for r in raw)], ["dim", "ids", "labels", "vecs", "codes", "rest"])

        for batch in batches:
            for i, label, vec in zip(*(batch.column(c) for c in ("id", "label", "vec")), strict=True):
                rows = held.setdefault(len(vec), [])
                rows.append((i.as_py(), label.as_py(), vec.values.to_numpy()))
                if len(rows) == CHUNK_ROWS:
                    yield pack(len(vec))
        for dim in list(held):
            yield pack(dim)

    return run


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """For every row that meets `anchors` and each of its first positives (other rows of the same label), the first negatives
    (rows of other labels) whose score lies between low_pct and high_pct of the positive's: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score. A score is the inner product of floor(scale * component); higher ones
    come first, equal ones by id.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component, or a component so large that scores
    could pass 62 bits take no part; nor do vectors of different length meet. A positive's score of 0 or less has no
    negatives. Rows that repeat an id are rows each, and none of them is a partner of an anchor of that id. Other columns are
    not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.expr(f"coalesce(size(`{vec_col}`) > 0 and forall(`{vec_col}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("id"), F.xxhash64(label_col).alias("label"), F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("wide"), whole.alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    most = F.least(F.lit(2.0**31 - 1), F.sqrt(F.lit(2.0**62) / F.size("wide")))
    rows = rows.where(F.forall("wide", lambda x: F.abs(x) < most)).select("id", "label", F.col("vec").cast("array<int>").alias("vec"), "anchor")
    total = rows.count()
    sample: dict[int, list] = {}
    for (v,) in rows.where(F.rand(7) < SAMPLE_ROWS / max(total, 1)).select("vec").limit(2 * SAMPLE_ROWS).toLocalIterator():
        sample.setdefault(len(v), []).append(v)
    books = {dim: codebook(np.array(v)) for dim, v in sample.items()}
    chunks = materialize(rows.select("id", "label", "vec").mapInArrow(_chunks(books), "dim int, ids binary, labels binary, vecs binary, codes binary, rest binary"), "chunks")
    asked = materialize(rows.where("anchor").select(F.monotonically_increasing_id().alias("key"), F.col("id").alias("anchor_id"), "label", "vec"), "anchors")
    groups = max(chunks.count(), 1)
    stored = chunks.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))

    def meet(asking: DataFrame, pick: Callable) -> DataFrame:
        dealt = asking.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        both = stored.unionByName(dealt, allowMissingColumns=True)
        return both.repartition(groups, "g").sortWithinPartitions("g", F.col("key").asc_nulls_first()).mapInArrow(_meet(books, pick), "key bigint, n int, id bigint, score bigint")

    def same(chunk: _Chunk, one: dict, q: np.ndarray, low: np.ndarray, high: np.ndarray):
        rows = np.flatnonzero((chunk.labels == one["label"]) & (chunk.ids != one["anchor_id"]))
        yield 0, *_best(chunk, q, rows, positives, low, high, None)

    def other(chunk: _Chunk, one: dict, q: np.ndarray, low: np.ndarray, high: np.ndarray):
        rows = np.flatnonzero((chunk.labels != one["label"]) & (chunk.ids != one["anchor_id"]))
        for p in one["found"]:
            if p["score"] > 0:
                yield p["n"], *_best(chunk, q, rows, negatives, low, high, (-(-low_pct * p["score"] // 100), high_pct * p["score"] // 100))

    def first(found: DataFrame, k: int, *key: str) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    near = materialize(first(meet(asked, same), positives, "key").select("key", F.col("rank").alias("n"), "id", "score"), "positives")
    windows = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "score"))).alias("found"))  # at most `positives` rows a key
    hard = first(meet(asked.join(windows, "key"), other), negatives, "key", "n").select("key", "n", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(near.select("key", "n", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["key", "n"]).join(asked.select("key", "anchor_id"), "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
