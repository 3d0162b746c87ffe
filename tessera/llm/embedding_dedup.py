"""Near-duplicate vectors by random-hyperplane sign hashing, exact verification and components (operator 4).

Equal vectors are one class. A table of `bits` hyperplanes sends a vector to the bucket of its signs; pairs that
meet in a bucket of any table are verified by their cosine in double precision. bits grows with the logarithm of
the number of classes (so buckets keep their size), and the number of tables follows from the recall wanted for a
pair exactly at the threshold; closer pairs are found more surely. Only ids, buckets and vectors are sent to the
tables. A pair that meets in several of them counts in the first: the signs of the rows that link, and of no others,
are taken again where they are verified. Large buckets are cut into blocks whose pairs are dealt out; blocks return link counts and a spanning
forest, never pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.ngram_jaccard import forest
from tessera.llm.shared import rehashed
from tessera.sources.shared import discard, materialize

#: Vectors of a block, at least.
LEAST_BLOCK = 256


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for n vectors: about 32 vectors a bucket if they were spread evenly."""
    bits = max(4, math.ceil(math.log2(max(n, 2))) - 5)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int, most: int | None = None) -> np.ndarray:
    """The bucket of every row of x in each table, or in the first `most` tables."""
    planes = _planes(x.shape[1], bits, tables, seed)
    most = tables if most is None else most
    signs = _scaled(x) @ planes[:, : bits * most] > 0
    return signs.reshape(len(x), most, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish and no rounding is added."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


@functools.lru_cache(8)
def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _signs(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column("vec")
                lengths = np.asarray(lists.value_lengths())
                sig = np.zeros((len(batch), tables), np.int64)
                for dim in np.unique(lengths):
                    rows = np.flatnonzero(lengths == dim)
                    sig[rows] = signatures(np.stack([np.asarray(lists[int(r)].values, np.float64) for r in rows]), bits, tables, seed)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, tables, dtype=np.int32)), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vid", "members", "vec")), pa.array(lengths, pa.int32()), flat], ["vid", "members", "vec", "dim", "sig"])

    return run


def block_links(x: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Pairs of left and right rows with at least the cosine."""
    x = _scaled(x)
    norm = np.sqrt((x * x).sum(1))
    i, j = np.nonzero((x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :]) >= cosine)
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    return np.stack([i, j], 1)


def _fresh(x: np.ndarray, pairs: np.ndarray, table: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """The pairs that no table before this one brings together."""
    if not table or not len(pairs):
        return pairs
    rows, place = np.unique(pairs, return_inverse=True)
    place, sig = place.reshape(pairs.shape), signatures(x[rows], bits, tables, seed, table)
    keep = [~(sig[p[:, 0]] == sig[p[:, 1]]).any(1) for p in (place[at : at + 4096] for at in range(0, len(place), 4096))]
    return pairs[np.concatenate(keep)]


def _verify(cosine: float, bits: int, tables: int, seed: int):
    def links(key, rows):
        if len(rows) < 2:
            return None
        ids, own, members, vec = zip(*rows, strict=True)
        own, members, ids = np.array(own), np.array(members, np.int64), np.array(ids, np.int64)
        left = np.flatnonzero(own == key[3])
        right = left if key[3] == key[4] else np.flatnonzero(own == key[4])
        x = np.stack(vec).astype(np.float64)
        pairs = _fresh(x, block_links(x, left, right, cosine), key[0], bits, tables, seed)
        if not len(pairs):
            return None
        counts = np.bincount(pairs[:, 0], members[pairs[:, 1]], len(ids)) + np.bincount(pairs[:, 1], members[pairs[:, 0]], len(ids))
        linked = np.flatnonzero(counts)
        tree = ids[forest(pairs, len(ids))]
        return np.concatenate([np.stack([ids[linked], ids[linked], counts[linked].astype(np.int64)], 1), np.concatenate([tree, np.zeros((len(tree), 1), np.int64)], 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out = []
            head = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "dim", "b", "i", "j", "vid", "own", "members")]
            vec = batch.column("vec")
            vec_ends, vec_flat = vec.offsets.to_numpy(), vec.values.to_numpy()
            for r in range(len(batch)):
                if key != (now := tuple(int(c[r]) for c in head[:5])):
                    out.append(links(key, rows))
                    key, rows = now, []
                rows.append((head[5][r], head[6][r], head[7][r], vec_flat[vec_ends[r] : vec_ends[r + 1]].copy()))
            yield table(out)
        yield table([links(key, rows)])

    def table(found):
        found = [x for x in found if x is not None]
        found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(3)], ["a", "b", "links"])

    return run


def embedding_dedup(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.98, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other vectors linked directly), component_id, kept.

    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing, and so do
    vectors of different length; they are components of their own. Rows that repeat a vec_id with the same vector
    count as vectors each; a row without vec_id has no component and is not kept. Other columns are not read.
    """
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    good = F.expr("coalesce(vec_id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0), false)")
    rows = rows.select("vec_id", "vec", good.alias("good"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(11), "vec").alias("h2"))
    classes = materialize(rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("vid"), F.count("*").alias("members"), F.first("vec").alias("vec")), "vectors")
    bits, tables = plan(classes.count(), cosine, recall)
    signed = materialize(classes.select("vid", "members", "vec").mapInArrow(_signs(bits, tables, seed), f"vid bigint, members bigint, vec array<{kind}>, dim int, sig array<bigint>"), "signs")
    slim = signed.select("vid", "dim", F.posexplode("sig").alias("t", "b"))
    large = slim.groupBy("dim", "t", "b").agg(F.count("*").alias("m")).where(f"m > {LEAST_BLOCK}").select("dim", "t", "b", F.expr(f"cast(ceil(m / greatest({LEAST_BLOCK}, 2 * sqrt(m))) as int)").alias("nb"))
    cut = slim.join(large, ["dim", "t", "b"]).groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("t", "nb"))).alias("cut"))
    dealt = signed.join(cut, "vid", "left").select("*", F.posexplode("sig").alias("t", "b")).withColumn("nb", F.expr("coalesce(try_element_at(cut, t), 1)")).withColumn("own", F.expr("cast(pmod(xxhash64(vid), nb) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select("t", "dim", "b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "vid", "own", "members", "vec")
    key = ["t", "dim", "b", "i", "j"]
    found = materialize(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verify(cosine, bits, tables, seed), "a bigint, b bigint, links bigint"), "links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "vid")
    groups = connected_components(found.select("a", "b")).withColumnRenamed("node", "vid")
    known = classes.select("h1", "h2", "vid", "members").join(counts, "vid", "left").join(groups, "vid", "left").select(
        rehashed("h1").alias("h1"), "h2", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "vid").alias("component"))
    out = rows.select("vec_id", "h1", "h2", "good").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("good"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
