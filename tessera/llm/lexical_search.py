"""Ranked lexical search by Fagin's threshold algorithm (operator 13).

Documents are dealt into shards of a bounded number of postings. A shard stores each term's list by falling impact, and
each document's own terms with their impacts. A query walks its terms' lists side by side, from the greatest impact down; a
document met for the first time is looked up in the second form, which gives its whole score. The next impacts of
all lists, weighted and summed, are the most that a document not yet met can reach: once that is strictly below the kth score so far, no
other document can enter or tie. The kth score is carried from shard to shard of a task. Impacts depend on the corpus' size, so
they are computed in a second step from stored counts.

Terms are compared by 64-bit hashes; a collision is not ruled out, only improbable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.decontamination import word_hashes
from tessera.sources.shared import discard, materialize

#: Postings and documents of a shard, about: one document at least.
SHARD_POSTINGS, SHARD_DOCS = 1 << 19, 1 << 15
#: Terms of items that are searched at once: the bound of what is broadcast; an item alone can be larger.
BLOCK_TERMS = 1 << 17
#: Entries of each list that the first round reads; every further one reads twice as many.
FIRST_ROUND = 16

_COUNTS = "doc_ids array<{}>, n binary, terms binary, doc_ends binary, term binary, tf binary, n_docs bigint, n_tokens bigint"
_SHARD = "doc_ids array<{}>, terms binary, doc_ends binary, term binary, impact binary, list_ends binary, list_docs binary, list_impacts binary"


def _merge(h: list[np.ndarray], c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(h) == 1:
        return h[0], c[0]
    found, place = np.unique(np.concatenate(h), return_inverse=True)
    return found, np.bincount(place, np.concatenate(c), len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, in shards: (document, term, number of occurrences) in the order of documents."""
    ids, n, terms, tfs, size = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, n, terms, tfs, size
        found, place = np.unique(np.concatenate(terms), return_inverse=True)
        raw = [np.array(n, np.int64), found, np.cumsum([len(x) for x in terms]).astype(np.int32), place.astype(np.int32), np.concatenate(tfs).astype(np.int64)]
        out = pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), *(pa.array([x.tobytes()]) for x in raw), pa.array([len(ids)]), pa.array([sum(n)])], ["doc_ids", "n", "terms", "doc_ends", "term", "tf", "n_docs", "n_tokens"])
        ids, n, terms, tfs, size = [], [], [], [], 0
        return out

    for batch in batches:
        kind, h, c = batch.schema.field("doc_id").type, [], []
        for r, hashes, ended in word_hashes(batch.column("text")):
            if len(hashes):
                one = np.unique(hashes, return_counts=True)
                h.append(one[0])
                c.append(one[1])
            if len(h) > 16 or ended and h:
                h, c = ([x] for x in _merge(h, c))
            if ended and h:
                ids.append(batch.column("doc_id")[r].as_py())
                n.append(int(c[0].sum()))
                terms.append(h[0])
                tfs.append(c[0])
                size += len(h[0])
                if size >= SHARD_POSTINGS or len(ids) == SHARD_DOCS:
                    yield flush()
            if ended:
                h, c = [], []
    if ids:
        yield flush()


def _impacts(n_docs: int, n_tokens: int):
    """Adds impacts to stored counts, and each term's documents by falling impact, equal ones in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: E731, B023
                ends, term, tf = get("doc_ends", np.int32), get("term", np.int32), get("tf", np.int64)
                m = np.array([50 + 50 * x * n_docs // n_tokens for x in get("n", np.int64).tolist()], np.int64)
                doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
                impact = (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])).astype(np.int32)
                order = np.lexsort((-impact, term))
                lists = np.cumsum(np.bincount(term, minlength=len(get("terms", np.uint64)))).astype(np.int32)
                raw = [impact, lists, doc[order], impact[order]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("doc_ids", "terms", "doc_ends", "term")), *(pa.array([x.tobytes()]) for x in raw)], ["doc_ids", "terms", "doc_ends", "term", "impact", "list_ends", "list_docs", "list_impacts"])

    return run


class _Shard:
    """A shard as far as the asked terms go."""

    def __init__(self, row: dict, terms: np.ndarray):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, own, self.ends = row["doc_ids"], get("terms", np.uint64), get("list_ends", np.int32)
        self.docs, self.impacts = get("list_docs", np.int32), get("list_impacts", np.int32)
        at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
        self.place = np.where(own[at] == terms, at, -1)  # of each asked term here
        wanted = np.zeros(len(own), bool)
        wanted[self.place[self.place >= 0]] = True
        term, ends = get("term", np.int32), get("doc_ends", np.int32)
        keep = wanted[term]
        self.doc_ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        self.term, self.impact = term[keep], get("impact", np.int32)[keep].astype(np.int64)
        self.weight, self.seen = np.zeros(len(own), np.int64), np.zeros(len(ends), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores by the documents' own terms, under the weights set."""
        ends = self.doc_ends[docs]
        n = ends - np.where(docs > 0, self.doc_ends[docs - 1], 0)
        at = np.arange(n.sum()) + np.repeat(ends - np.cumsum(n), n)
        return np.bincount(np.repeat(np.arange(len(docs)), n), self.weight[self.term[at]] * self.impact[at], len(docs)).astype(np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, bound: int) -> list[tuple]:
        """The first k documents as (-score, id is null, id), of those that score `bound` at least; the threshold algorithm."""
        at = self.place[terms]
        at, weights = at[at >= 0], weights[at >= 0]
        if not len(at):
            return []
        self.weight[at] = weights
        ends, depth = self.ends[at], 0
        starts = ends - np.diff(self.ends, prepend=0)[at]
        met, found, scores = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = FIRST_ROUND
        while True:
            low = np.minimum(starts + depth, ends)
            n = np.minimum(starts + depth + step, ends) - low
            entries = self.docs[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
            new = np.unique(entries[~self.seen[entries]]).astype(np.int64)
            self.seen[new] = True
            met.append(new)
            score = self.scores(new)
            keep = score >= max(bound, 1)
            found, scores = np.concatenate([found, new[keep]]), np.concatenate([scores, score[keep]])
            if len(found) >= k:
                bound = max(bound, int(np.partition(scores, -k)[-k]))
                found, scores = found[scores >= bound], scores[scores >= bound]
            depth, step = depth + step, step * 2
            rest = starts + depth < ends
            threshold = int((weights[rest] * self.impacts[starts[rest] + depth]).sum())
            if not threshold or threshold < bound:
                break
        self.weight[at] = 0
        self.seen[np.concatenate(met)] = False
        ids = (self.ids[d] for d in found.tolist())
        return sorted((-s, i is None, i) for s, i in zip(scores.tolist(), ids, strict=True))[:k]


def _search(plan, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, items = plan.value
        tops, kind = [[] for _ in names], None
        for batch in batches:
            kind = batch.schema.field("doc_ids").type.value_type
            for i in range(len(batch)):
                shard = _Shard({c: batch.column(c)[i].as_buffer() if c != "doc_ids" else batch.column(c)[i].as_py() for c in batch.schema.names}, terms)
                for at, (own, weights) in enumerate(items):
                    top = tops[at]
                    more = shard.best(own, weights, k, -top[-1][0] if len(top) == k else 0)
                    if more:
                        tops[at] = sorted(top + more)[:k]
        rows = [(name, x[2], -x[0]) for name, top in zip(names, tops, strict=True) for x in top]
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], kind), pa.array(cols[2], pa.int64())], ["item", "doc_id", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, hashes, _ in word_hashes(batch.column("text")):
            terms = np.unique(hashes)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("item")[r].as_py()] * len(terms), pa.string()), pa.array(terms.view(np.int64))], ["item", "term"])


class ImpactIndex:
    """Shards of documents with impact-ordered lists. Null texts and texts without a term are not in it: they never score.
    Rows that repeat an id are documents each. Columns besides id and text are not read."""

    def __init__(self, shards: DataFrame, n_docs: int, id_type: str):
        self.shards, self.n_docs, self.id_type, self.spark = shards, n_docs, id_type, shards.sparkSession

    @staticmethod
    def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ImpactIndex:
        kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        counts = materialize(rows.mapInArrow(_count, _COUNTS.format(kind)), "counts", wide=True)
        n_docs, n_tokens = (x or 0 for x in counts.agg(F.sum("n_docs"), F.sum("n_tokens")).first())
        shards = materialize(counts.drop("n_docs", "n_tokens").mapInArrow(_impacts(n_docs, n_tokens), _SHARD.format(kind)), "impacts", wide=True)
        discard(counts)
        return ImpactIndex(shards, n_docs, kind)

    def document_counts(self, terms: np.ndarray) -> np.ndarray:
        """Documents that hold each of the sorted terms, from the directories of the lists."""
        sent = self.spark.sparkContext.broadcast(terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for t, e in zip(batch.column("terms"), batch.column("list_ends"), strict=True):
                    own, ends = np.frombuffer(t.as_buffer(), np.uint64), np.frombuffer(e.as_buffer(), np.int32)
                    at = np.minimum(np.searchsorted(own, sent.value), len(own) - 1)
                    total += np.where(own[at] == sent.value, np.diff(ends, prepend=0)[at], 0)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "n"])

        out = np.zeros(len(terms), np.int64)
        for t, n in self.shards.select("terms", "list_ends").mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n")).collect():  # as many as the block has terms, at most
            out[t] = n
        return out

    def search(self, items: list[tuple[str, np.ndarray]], k: int) -> DataFrame:
        """(item, doc_id, score): of each task the first k documents of each item, those of the whole corpus among them."""
        terms = np.unique(np.concatenate([t for _, t in items]))
        df = self.document_counts(terms)
        weights = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
        own = [np.searchsorted(terms, t) for _, t in items]
        plan = self.spark.sparkContext.broadcast(([name for name, _ in items], terms, [(t[weights[t] > 0], weights[t[weights[t] > 0]]) for t in own]))
        return self.shards.mapInArrow(_search(plan, k), f"item string, doc_id {self.id_type}, score bigint")


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items and their distinct terms, in blocks, by the driver; an item is never cut."""
    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    found = materialize(named.mapInArrow(_item_terms, "item string, term bigint").distinct(), "items")
    block, name, own = [], None, []
    for item, term in found.orderBy("item").toLocalIterator():
        if item != name:
            if own:
                block.append((name, np.array(own, np.int64).view(np.uint64)))
            if sum(len(t) for _, t in block) >= BLOCK_TERMS:
                yield block
                block = []
            name, own = item, []
        own.append(term)
    if own:
        block.append((name, np.array(own, np.int64).view(np.uint64)))
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of every item the k documents with the highest score above 0, equal scores by doc_id,
    null ones last; all, if fewer.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))); its impact in a document with tf occurrences among n words is
    10^9 tf div (1000 tf + 20 m), m = 50 + (50 n N div L), for N documents with L words. An item without a known term has no row,
    nor has any when documents or items are empty. Items that share an id are one, with the terms of all; a null
    numeric id stays null, a null string one becomes empty. Rows that repeat a doc_id are documents each.
    """
    kind = items.schema[item_id].dataType.simpleString()
    index, found = ImpactIndex.build(docs, doc_id, text_col), None
    for block in _blocks(items, item_id, text_col):
        hits = materialize(index.search(block, k), "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"item string, doc_id {index.id_type}, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(F.col("item").try_cast(kind).alias("item_id"), "rank", "doc_id", "score")
