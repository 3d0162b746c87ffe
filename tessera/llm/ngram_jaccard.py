"""N-gram Jaccard join by multiple-global-order filtering (operator 5).

A document is the set of its distinct k-word shingles (64-bit hashes; words are lower-cased in A-Z only and
cut at ASCII white space). Two sets link when 100 * |x and y| >= pct * |x or y|.

With overlap bound o(n) = ceil(pct * n / 100), two linked sets share at least l tokens of their prefixes of
n - o + l tokens under *any* global token order; of the shared prefix, again, the rarest tokens must meet
(s - r + 1 of s when r must be shared). The join uses this under two independent orders:

1. order A keeps 15 % + 5 % of every set; documents with too few prefix tokens that another document has
   drop out (they have no partner);
2. order B keeps a longer prefix, of the remaining documents only; its tokens, ordered by their frequency,
   give rare tokens by which the documents are brought together. Tokens that stand in the same documents (those of
   a passage that some pages share, or of a group of near copies) count as one group. Groups that overlap nearly
   wholly, as those of near copies with some edits do, are joined, so that a document is sent once; where joining
   them would compare more pairs than the groups hold themselves (chains of unlike documents), they stay apart;
3. within each group, cut into blocks if it is large, a pair is a candidate only if it shares prefix tokens under
   order A *and* under order B; candidates are verified by the exact size of the intersection.

Equal sets are one class throughout (smallest doc_id stands for it), and a block emits a spanning forest of its
links, so neither copies nor large near-copy groups are ever expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import meetings, textkernels
from tessera.llm.components import connected_components
from tessera.llm.shared import rehashed, semi_by_id, small
from tessera.sources.shared import discard, materialize

#: Share of the set by which the prefixes of order A and B exceed the plain prefix.
EXTRA_A, EXTRA_B = 0.05, 0.35
#: A block has this many documents at least. A group has no more blocks than SPREAD, as each of its documents is sent once a block,
#: unless they would have more documents or prefix tokens than one task compares with as many others.
LEAST_BLOCK, SPREAD, MOST_ROWS, MOST_TOKENS = 96, 24, 1 << 12, 1 << 20
#: Tokens that are compared at once.
SLICE = 512
_SALT_B = np.uint64(0x5851F42D4C957F2D)


def _overlap(n, pct):
    return (pct * n + 99) // 100


def _share(n, extra):
    """Tokens that two prefixes must share, by set size."""
    return 1 + (n * int(extra * 100)) // 100


def prefix_length(n, pct, extra):
    o = _overlap(n, pct)
    return np.minimum(n, n - o + np.minimum(_share(n, extra), o))


def must_share(n, pct, extra):
    """A lower bound that holds for every partner of a set of n tokens: the smallest has o(n)."""
    o = _overlap(n, pct)
    return np.minimum(_share(o, extra), _overlap(o, pct))


def order_a(tokens: np.ndarray) -> np.ndarray:
    return tokens


def order_b(tokens: np.ndarray) -> np.ndarray:
    return np.sort(textkernels.mix(tokens ^ _SALT_B))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _signatures(k: int, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, keys, prefixes, at = batch.column(0), [], [], [], 0
            for i, s in textkernels.shingle_sets(batch.column(1), k):
                n = len(s)
                sizes.append(n)
                keys.append((textkernels.mix(s).sum(dtype=np.uint64), textkernels.mix(s ^ _SALT_B).sum(dtype=np.uint64)))
                prefixes.append(order_a(s)[: int(prefix_length(n, pct, EXTRA_A))])
                if len(sizes) == 2000 or i + 1 == len(ids):
                    key = np.array(keys, np.uint64).view(np.int64).reshape(-1, 2)
                    n = np.array(sizes, np.int64)
                    yield pa.RecordBatch.from_arrays([ids[at : i + 1], pa.array(n), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(must_share(n, pct, EXTRA_A)), _lists(prefixes)], ["doc_id", "n", "k1", "k2", "need", "toks"])
                    sizes, keys, prefixes, at = [], [], [], i + 1

    return run


def _sets(k: int, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, at = batch.column(0), [], 0
            for i, s in textkernels.shingle_sets(batch.column(1), k):
                sets.append(s)
                if len(sets) == 500 or i + 1 == len(ids):
                    n = np.array([*map(len, sets)], np.int64)
                    ends = [order_b(x)[: int(p)] for x, p in zip(sets, prefix_length(n, pct, EXTRA_B), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids[at : i + 1], pa.array(must_share(n, pct, EXTRA_B)), _lists(ends), _lists(sets)], ["doc_id", "need", "toks", "whole"])
                    sets, at = [], i + 1

    return run


def _with_partners(prefixes: DataFrame) -> DataFrame:
    """doc_id of the documents that share enough prefix tokens with others; prefixes: doc_id, need, toks."""
    return meetings.partnered(prefixes.where("need > 0")).distinct()


def _rare_groups(prefixes: DataFrame) -> DataFrame:
    """(doc_id, size, groups) of the documents that share enough prefix tokens with others; prefixes: doc_id, need, toks.
    size: how many prefix tokens; groups: the distinct (df, id) of the rare tokens, sorted; tokens that stand in the same documents have one id. A
    token's id depends on nothing but the rows that have it, so an unlikely hash collision brings documents together in
    vain but loses none. Rows that repeat a doc_id pool their groups, each under its own bound."""
    found = meetings.rare_groups(prefixes.where("need > 0"))
    return found.groupBy("doc_id").agg(F.sum("size").alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups"))


def candidate_groups(prefixes: DataFrame) -> DataFrame:
    """(doc_id, group, nb, own): every group of documents that may hold links, and the block of nb that the document is
    in. The connected groups are one if they hold half as many pairs together as one group of all their documents, or
    more. Else they stay apart, without those all of whose documents have one and the same larger group, which holds
    their pairs too. Either way every two documents that share a rare token meet."""
    found = _rare_groups(prefixes).select("doc_id", "size", F.explode("groups").alias("g"), F.element_at("groups", -1)["id"].alias("top"))
    found = materialize(found.select("doc_id", "size", F.col("g.id").alias("group"), "top"), "groups")
    sizes = materialize(found.groupBy("group").agg(F.count("*").alias("m"), F.sum("size").alias("toks"), F.min("doc_id").alias("hub"), F.min("top").alias("low"), F.max("top").alias("high")).where("m > 1"), "group-sizes")
    fresh = sizes.select(rehashed("group").alias("group"), "m", "toks", "hub", "low", "high")
    joined = materialize(connected_components(found.join(fresh, "group").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))), "joined")
    # one row a component: its documents, and the pairs that its groups hold
    lengths = found.groupBy("doc_id").agg(F.min("size").alias("size")).withColumnRenamed("doc_id", "node")
    whole = joined.join(lengths, "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("toks"))
    pairs = sizes.select("m", F.col("hub").alias("node")).join(joined, "node").groupBy("component").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("held"))
    one = materialize(whole.join(pairs, "component").select("component", "n", "toks", (F.col("n").cast("double") * F.col("n") <= 2 * F.col("held")).alias("compact")), "compact")
    blocks = lambda n: F.expr(f"cast(greatest(least(ceil({n} / {LEAST_BLOCK}), {SPREAD}), ceil({n} / {MOST_ROWS}), ceil(toks / {MOST_TOKENS})) as int)").alias("nb")
    kinds = joined.join(one.select(rehashed("component").alias("component"), "n", "toks", "compact"), "component")
    compact = kinds.where("compact").select(F.col("node").alias("doc_id"), F.xxhash64(F.lit(3), "component").alias("group"), blocks("n"))
    apart = found.join(kinds.where("not compact").select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    apart = apart.join(fresh.where("low <> high or low = group").select("group", blocks("m")), "group").select("doc_id", "group", "nb")
    return compact.unionByName(apart).select("doc_id", "group", "nb", F.expr("cast(pmod(xxhash64(doc_id), nb) as int)").alias("own"))


def common_tokens(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each set of left has in common with each of right. Tokens that stand in the same sets are counted
    together, SLICE at a time and only for the sets that have them, so memory depends on neither their number nor their kinds. A set compared with itself lacks
    the tokens that no other has."""
    out = np.zeros((len(left), len(right)), np.float32)
    row = np.repeat(np.arange(len(sets)), [*map(len, sets)])
    values, first, column, n = np.unique(np.concatenate(sets), return_index=True, return_inverse=True, return_counts=True)
    sides = []
    for side in (left, right):
        at = np.full(len(sets), -1)
        at[side] = np.arange(len(side))
        met = np.zeros(len(values), bool)
        met[column[at[row] >= 0]] = True
        sides.append((at, met))
    (at_left, in_left), (at_right, in_right) = sides
    kept = np.flatnonzero(in_left & in_right & (n > 1))
    place = np.full(len(values), -1)
    place[kept[np.lexsort((n[kept], row[first[kept]]))]] = np.arange(len(kept))
    place = place[column]
    order = np.argsort(place, kind="stable")
    order = order[np.searchsorted(place[order], 0) :]
    row, place = row[order], place[order]
    for low in range(0, len(kept), SLICE):
        a, b = np.searchsorted(place, (low, low + SLICE))
        rows, at = np.unique(row[a:b], return_inverse=True)
        m = np.zeros((len(rows), min(SLICE, len(kept) - low)), np.float32)
        m[at, place[a:b] - low] = 1
        i, j = at_left[rows], at_right[rows]
        out[np.ix_(i[i >= 0], j[j >= 0])] += m[i >= 0] @ m[j >= 0].T
    return out


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, pct: int) -> np.ndarray:
    """Pairs (i, j), i in left and j in right, that are candidates under both orders and pass the exact test."""
    n = np.array([*map(len, sets)], np.int64)
    sets = [x.view(np.uint64) for x in sets]
    candidate = np.ones((len(left), len(right)), bool)
    for order, extra in ((order_a, EXTRA_A), (order_b, EXTRA_B)):
        candidate &= common_tokens([order(x)[: int(p)] for x, p in zip(sets, prefix_length(n, pct, extra), strict=True)], left, right) > 0
        if not candidate.any():
            return np.zeros((0, 2), np.int64)
    rows, cols = np.flatnonzero(candidate.any(1)), np.flatnonzero(candidate.any(0))
    left, right = left[rows], right[cols]
    some, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    inter = common_tokens([sets[i] for i in some], at[: len(left)], at[len(left) :]).astype(np.int64)
    union = n[left][:, None] + n[right][None, :] - inter
    i, j = np.nonzero((100 * inter >= pct * union) & candidate[np.ix_(rows, cols)])
    return np.stack([left[i], right[j]], 1)


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """A spanning forest (each node with its root) of the graph of pairs."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        before = label.copy()
        np.minimum.at(label, pairs[:, 0], low)
        np.minimum.at(label, pairs[:, 1], low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], 1)


def _verify(pct: int):
    """Rows come sorted by (group, i, j); a part, of two blocks at most, is verified as soon as it is whole."""

    def links(key, ids, blocks, sets):
        if len(ids) < 2:
            return np.zeros((0, 2), np.int64)
        blocks = np.array(blocks)
        pairs = block_links(sets, np.flatnonzero(blocks == key[1]), np.flatnonzero(blocks == key[2]), pct)
        return np.array(ids)[forest(pairs, len(ids))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, blocks, sets, out = None, [], [], [], []
        for batch in batches:
            group, i, j, own, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            whole = batch.column(5)
            ends, flat = whole.offsets.to_numpy(), whole.values.to_numpy()
            for row in range(len(doc)):
                if key != (now := (group[row], i[row], j[row])):
                    out.append(links(key, ids, blocks, sets))
                    key, ids, blocks, sets = now, [], [], []
                ids.append(doc[row])
                blocks.append(own[row])
                sets.append(flat[ends[row] : ends[row + 1]])
            sets = [x.copy() for x in sets]
            found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            out = []
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        found = links(key, ids, blocks, sets)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def ngram_jaccard(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns one row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    A text of 1 to k-1 words is one shingle of its whole sequence; an empty or null text has none and links with
    nothing. Rows that repeat a doc_id are one node of the graph. A row without doc_id links with nothing and
    gets a null component. Other columns of docs are not read.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = materialize(base.mapInArrow(_signatures(k, pct), "doc_id bigint, n bigint, k1 bigint, k2 bigint, need bigint, toks array<bigint>"), "signatures")
    named = sig.where("n > 0 and doc_id is not null")
    classes = materialize(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    # order A over all documents; then one document of each class
    active = _with_partners(named.select("doc_id", "need", "toks")).join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    active = materialize(active, "active")
    # the prefixes have done their work; later steps read the rest alone
    sig, before = materialize(sig.drop("need", "toks"), "signatures"), sig
    named = sig.where("n > 0 and doc_id is not null")
    discard(before)
    # stored with their prefixes: cut in the next stage, they would take a second Python worker for each of its tasks
    sets = materialize(semi_by_id(base, active, "doc_id").mapInArrow(_sets(k, pct), "doc_id bigint, need bigint, toks array<bigint>, whole array<bigint>"), "sets")
    # order B over what is left; documents meet in the groups of their rare tokens
    placed = materialize(candidate_groups(sets.select("doc_id", "need", "toks")), "placed")
    copies = sets.select("doc_id", "whole").join(small(placed, 32 * placed.count()), "doc_id").select("group", "own", "doc_id", "whole", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = copies.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "whole")
    dealt = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    links = dealt.mapInArrow(_verify(pct), "a bigint, b bigint")
    # rows of one doc_id with different sets are one node
    split = named.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")).where("low <> high").select("doc_id")
    reps = named.join(split, "doc_id").select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = materialize(connected_components(links.union(reps)), "components")
    discard(active, sets, placed)
    roots = classes.where("members > 1").select("k1", "k2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("root"))
    alone = sig.select("doc_id", "n", "k1", "k2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return alone.join(roots.where("root is not null"), ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "doc_id"), F.coalesce("root", "doc_id"))).alias("component_id"))
