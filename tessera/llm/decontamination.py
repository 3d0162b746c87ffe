"""Benchmark decontamination by a distributed positional inverted index (operator 12).

The postings of all words of all documents are stored in segments of 65,536 positions: the sorted terms of a segment,
and of each the positions where it stands. Documents lie one behind the other with a gap between them; a document
longer than a segment is cut into stretches that overlap by `reach` words, of which each owns its own words, so a
segment is searched alone and no text is too long. Test items are cut into windows. A window's lists are
intersected from its rarest term on, each shifted by the term's offset, so that what is left are the places of the phrase.
Items come in blocks of a bounded number of words; every block meets every segment.

Words are compared by 64-bit hashes; a collision is not ruled out, only improbable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkernels import ALPHANUMERIC, pieces, words
from tessera.sources.shared import materialize

#: Positions of a segment: they are stored in 16 bits.
SEGMENT = 1 << 16
#: Words of test items that are searched at once: the bound of what is broadcast.
BLOCK_WORDS = 1 << 18


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(row, hashes of its words in order, whether the row ends); a long text comes in several parts."""
    row, parts, at = None, False, -1
    with np.errstate(over="ignore"):
        for data, offsets, rows in pieces(texts, ALPHANUMERIC):
            hashes, own, _ = words(data, offsets, solid=ALPHANUMERIC)
            ends = np.searchsorted(own, np.arange(len(rows)), "right")
            if parts and rows[0] != row:
                yield row, np.zeros(0, np.uint64), True
            if len(rows) == 1:  # perhaps a part of a long text: the next run tells whether it ended
                row, parts = int(rows[0]), True
                yield row, hashes, False
                continue
            parts, at = False, 0
            for r, end in zip(rows.tolist(), ends.tolist(), strict=True):
                yield r, hashes[at:end], True
                at = end
    if parts:
        yield row, np.zeros(0, np.uint64), True


class _Segments:
    """Packs documents into segments and segments into Arrow batches."""

    def __init__(self, reach: int, schema: pa.Schema):
        self.reach, self.schema, self.own = reach, schema, SEGMENT - 3 * reach
        self.held, self.first, self.a = np.zeros(0, np.uint64), 0, 0
        self.clear()

    def clear(self) -> None:
        self.stretches, self.hashes, self.used = [], [], 0

    def stretch(self, row: int, doc_id, held: np.ndarray, first: int, a: int, b: int) -> Iterator[pa.RecordBatch]:
        if self.stretches and self.used + len(held) > SEGMENT:
            yield self.flush()
        self.stretches.append((row, doc_id, self.used, first, a, b))
        self.hashes.append(held)
        self.used += len(held) + self.reach

    def add(self, row: int, doc_id, part: np.ndarray, ended: bool) -> Iterator[pa.RecordBatch]:
        """The next words of a document."""
        self.held = np.concatenate([self.held, part]) if len(self.held) else part
        while self.first + len(self.held) > self.a + self.own + self.reach:
            end = self.a + self.own
            yield from self.stretch(row, doc_id, self.held[: end + self.reach - self.first], self.first, self.a, end)
            keep = max(end - self.reach, self.first)
            self.held, self.first, self.a = self.held[keep - self.first :], keep, end
        if ended:
            yield from self.stretch(row, doc_id, self.held, self.first, self.a, self.first + len(self.held))
            self.held, self.first, self.a = np.zeros(0, np.uint64), 0, 0

    def flush(self) -> pa.RecordBatch:
        rows, ids, bases, firsts, a, b = zip(*self.stretches, strict=True)
        hashes = np.concatenate(self.hashes)
        places = np.concatenate([np.arange(base, base + len(h)) for base, h in zip(bases, self.hashes, strict=True)])
        order = np.argsort(hashes, kind="stable")
        terms, counts = np.unique(hashes[order], return_counts=True)
        one = {"rows": list(rows), "doc_ids": list(ids), "bases": list(bases), "firsts": list(firsts), "a": list(a), "b": list(b), "terms": terms.astype(np.uint64).tobytes(), "ends": np.cumsum(counts).astype(np.int32).tobytes(), "positions": places[order].astype(np.uint16).tobytes()}
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([one[f.name]], f.type) for f in self.schema], schema=self.schema)


def _schema(id_type: str) -> str:
    return f"rows array<bigint>, doc_ids array<{id_type}>, bases array<int>, firsts array<bigint>, a array<bigint>, b array<bigint>, terms binary, ends binary, positions binary"


class PositionalIndex:
    """Stored postings of documents. Null texts are empty; a document without words is in the index, too. Rows that repeat
    an id are documents each. Columns besides id and text are not read."""

    def __init__(self, segments: DataFrame, reach: int):
        self.segments, self.reach, self.spark = segments, reach, segments.sparkSession

    @staticmethod
    def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 32) -> PositionalIndex:
        """reach: the longest phrase or proximity span that can be asked for, in words."""
        id_type = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = None
            for batch in batches:
                if packer is None:
                    kind, of = batch.schema.field("doc_id").type, lambda t: pa.list_(t)
                    packer = _Segments(reach, pa.schema([("rows", of(pa.int64())), ("doc_ids", of(kind)), ("bases", of(pa.int32())), *((x, of(pa.int64())) for x in ("firsts", "a", "b")), *((x, pa.binary()) for x in ("terms", "ends", "positions"))]))
                ids, numbers = batch.column("doc_id"), batch.column("row")
                for r, hashes, ended in word_hashes(batch.column("text")):
                    yield from packer.add(numbers[r].as_py(), ids[r].as_py(), hashes, ended)
            if packer and packer.stretches:
                yield packer.flush()

        return PositionalIndex(materialize(rows.mapInArrow(run, _schema(id_type)), "postings"), reach)

    def documents(self) -> DataFrame:
        """(row, doc_id, n_words): a row for each document; `row` names it within the index."""
        each = self.segments.select("rows", "doc_ids", F.zip_with("a", "b", lambda x, y: y - x).alias("n")).select(F.explode(F.arrays_zip("rows", "doc_ids", "n")).alias("x"))
        return each.groupBy(F.col("x.rows").alias("row")).agg(F.first("x.doc_ids").alias("doc_id"), F.sum("x.n").alias("n_words"))

    def term_counts(self, terms: np.ndarray) -> np.ndarray:
        """How often each of the sorted terms stands in the documents; what overlaps counts twice. Positions are not read."""
        sent = self.spark.sparkContext.broadcast(terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for t, e in zip(batch.column("terms"), batch.column("ends"), strict=True):
                    at, n = _lookup(np.frombuffer(t.as_buffer(), np.uint64), np.frombuffer(e.as_buffer(), np.int32), sent.value)
                    total += n
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "n"])

        found = self.segments.select("terms", "ends").mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(len(terms), np.int64)
        for t, n in found:  # as many as the block has terms, at most
            out[t] = n
        return out

    def search(self, windows: Windows) -> DataFrame:
        """(row, places, items, near): the places (start, end) of a document's words that windows cover, the items of the
        windows, and those of the cuts that stand near. Documents with nothing have no row; long ones may have several."""
        if max(windows.lengths.max(initial=0), windows.span) > self.reach:
            raise ValueError(f"phrases and spans are longer than {self.reach} words: build the index with a greater reach")
        plan = self.spark.sparkContext.broadcast(windows.by_rarity(self.term_counts(windows.terms)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in batch.to_pylist():
                    found = _matches(one, plan.value)
                    if found:
                        row, a, b, items, near = zip(*found, strict=True)
                        places = [[{"a": x, "b": y} for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]
                        named = [pa.array([[plan.value.names[i] for i in x] for x in c], pa.list_(pa.string())) for c in (items, near)]
                        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(places, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), *named], ["row", "places", "items", "near"])

        return self.segments.drop("doc_ids").mapInArrow(run, "row bigint, places array<struct<a: bigint, b: bigint>>, items array<string>, near array<string>")


def _lookup(terms: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among terms, length of the list) of each wanted term; 0 where it is absent."""
    if not len(terms):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    n = ends[at] - np.where(at > 0, ends[at - 1], 0)
    return at, np.where(terms[at] == wanted, n, 0).astype(np.int64)


class Windows:
    """Distinct windows of a block of items: term numbers in order, padded by -1, and the items of each.

    items: (number of the name, words); an item may come in parts. phrase: windows of so many consecutive words; an item with
    fewer is one window. The cuts, whose words are sought within `span` consecutive words, are every phrase-th window and the last."""

    def __init__(self, names: list[str], items: list[tuple[int, np.ndarray]], phrase: int, span: int):
        self.names, self.span = names, span
        self.terms = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
        rows, owners, cuts = [np.zeros((0, phrase), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for item, h in items:
            t = np.searchsorted(self.terms, h).astype(np.int32)
            if not len(t):
                continue
            t = np.pad(t, (0, max(phrase - len(t), 0)), constant_values=-1)
            found = np.lib.stride_tricks.sliding_window_view(t, phrase)
            rows.append(found)
            owners.append(np.full(len(found), item))
            cuts.append((np.arange(len(found)) % phrase == 0) | (np.arange(len(found)) == len(found) - 1))
        rows, owners, cuts = np.concatenate(rows), np.concatenate(owners), np.concatenate(cuts)
        self.words, place = np.unique(rows, axis=0, return_inverse=True)
        self.items, self.item_ends = self._owners(place.ravel(), owners)
        self.cut_items, self.cut_ends = self._owners(place.ravel()[cuts], owners[cuts])
        self.cut = np.diff(self.cut_ends, prepend=0) > 0
        self.lengths = (self.words >= 0).sum(1)
        self.order = None

    def by_rarity(self, counts: np.ndarray) -> Windows:
        """Every window's offsets, the rarest term's first; windows with a term that no document holds are no longer sought."""
        n = np.where(self.words >= 0, counts[self.words], np.iinfo(np.int64).max)
        self.order = np.argsort(n, axis=1, kind="stable").astype(np.int16)
        self.sought = (n > 0).all(1)
        return self

    def _owners(self, windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(np.stack([windows, items], 1), axis=0)
        return pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.words)), "right")

    def items_of(self, windows: np.ndarray, cuts: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place among the windows given, item) of each item that has the window, or has it as a cut."""
        items, ends = (self.cut_items, self.cut_ends) if cuts else (self.items, self.item_ends)
        n, ends = np.diff(ends, prepend=0)[windows], ends[windows]
        return np.repeat(np.arange(len(windows)), n), items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - ends, n)]


def _matches(one: dict, plan: Windows) -> list[tuple]:
    """What one segment holds of the windows, by stretch: (row, starts, ends, items, near items)."""
    terms, ends = np.frombuffer(one["terms"], np.uint64), np.frombuffer(one["ends"], np.int32)
    at, n = _lookup(terms, ends, plan.terms)
    live = np.flatnonzero(plan.sought)
    live = live[n[plan.words[live, plan.order[live, 0]]] > 0]  # the rarest term first
    live = live[((plan.words[live] < 0) | (n[plan.words[live]] > 0)).all(1)]
    if not len(live):
        return []
    positions = np.frombuffer(one["positions"], np.uint16).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    keys = np.repeat(np.arange(len(terms)) * SEGMENT, sizes) + positions  # sorted: by term, then by position
    has = lambda want: keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want

    def rarest(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, offset, position) of each posting of the windows' rarest terms."""
        off = plan.order[windows, 0]
        t = plan.words[windows, off]
        w = np.repeat(windows, n[t])
        within = np.arange(len(w)) - np.repeat(np.cumsum(n[t]) - n[t], n[t])
        return w, np.repeat(off, n[t]), positions[np.repeat(ends[at[t]] - n[t], n[t]) + within]

    w, off, place = rarest(live)
    start = place - off
    w, start = w[start >= 0], start[start >= 0]
    for j in range(1, plan.words.shape[1]):
        off = plan.order[w, j]
        t, place = plan.words[w, off], start + off
        keep = (t < 0) | ((place < SEGMENT) & has(at[t] * SEGMENT + np.minimum(place, SEGMENT - 1)))
        w, start = w[keep], start[keep]
    near_w, near_at = _near(plan, at, keys, *rarest(live[plan.cut[live]]))
    if not len(w) and not len(near_w):
        return []
    bases = np.array(one["bases"], np.int64)
    cover = np.cumsum(np.bincount(start, minlength=2 * SEGMENT) - np.bincount(start + plan.lengths[w], minlength=2 * SEGMENT)) > 0
    pairs = lambda ws, where, cuts: np.unique(np.stack([(np.searchsorted(bases, where, "right") - 1)[(x := plan.items_of(ws, cuts))[0]], x[1]], 1), axis=0)
    hit, near, out = pairs(w, start, False), pairs(near_w, near_at, True), []
    for s in np.union1d(hit[:, 0], near[:, 0]).tolist():
        base, first, a, b = (one[x][s] for x in ("bases", "firsts", "a", "b"))
        own = np.zeros(b - a + 2, np.int8)
        own[1:-1] = cover[base + a - first : base + b - first]
        edge = np.diff(own)
        out.append((one["rows"][s], (np.flatnonzero(edge > 0) + a).tolist(), (np.flatnonzero(edge < 0) + a).tolist(), hit[hit[:, 0] == s, 1].tolist(), near[near[:, 0] == s, 1].tolist()))
    return out


def _near(plan: Windows, at: np.ndarray, keys: np.ndarray, w: np.ndarray, off: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of rarest terms around which all the window's words stand within `span` consecutive words."""
    reach = plan.span - 1
    between = lambda t, p: (np.searchsorted(keys, t * SEGMENT + np.maximum(p - reach, 0)), np.searchsorted(keys, t * SEGMENT + np.minimum(p + reach, SEGMENT - 1), "right"))
    for j in range(1, plan.words.shape[1]):
        t = plan.words[w, plan.order[w, j]]
        low, high = between(at[t], place)
        keep = (t < 0) | (high > low)
        w, place = w[keep], place[keep]
    keep = np.zeros(len(w), bool)
    for i, (one, p) in enumerate(zip(w.tolist(), place.tolist(), strict=True)):
        lists = [keys[slice(*between(t, p))] - t * SEGMENT for t in at[np.unique(plan.words[one, : plan.lengths[one]])].tolist()]
        for first in np.unique(np.concatenate(lists)).tolist():  # a run that starts with a word of the window and holds p
            keep[i] |= first <= p <= first + reach and all(((x >= first) & (x <= first + reach)).any() for x in lists)
            if keep[i]:
                break
    return w[keep], place[keep]


def _blocks(items: DataFrame, id_col: str, text_col: str, phrase: int) -> Iterator[tuple[list[str], list[tuple[int, np.ndarray]]]]:
    """Items in blocks of BLOCK_WORDS words, by the driver; longer items are cut with an overlap of phrase - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, carried = [], 0
            for r, hashes, ended in word_hashes(batch.column("text")):
                held.append(hashes)
                size = sum(map(len, held))
                if size < SEGMENT and not ended:
                    continue
                whole = np.concatenate(held)
                ends = [*range(SEGMENT, len(whole), SEGMENT), len(whole)] if len(whole) > carried else []
                for a, b in zip([0, *ends][:-1], ends, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("item")[r].as_py()], pa.string()), pa.array([whole[max(a - phrase + 1, 0) : b].tobytes()])], ["item", "words"])
                held = [] if ended else [whole[max(len(whole) - phrase + 1, 0) :]]
                carried = sum(map(len, held))

    found = materialize(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item string, words binary"), "items")
    names, block, size = {}, [], 0
    for row in found.toLocalIterator():
        h = np.frombuffer(row["words"], np.uint64)
        if not len(h):
            continue
        if size and size + len(h) > BLOCK_WORDS:
            yield list(names), block
            names, block, size = {}, [], 0
        block.append((names.setdefault(row["item"], len(names)), h))
        size += len(h)
    if block:
        yield list(names), block


def decontaminate(docs: DataFrame, items: DataFrame, phrase: int = 10, slop: int = 5, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, places (start and end of runs of hit words, in order; runs may touch, or overlap
    where items of several blocks hit), n_hit (words in any run), items (ids as strings, sorted), near (ids of items of which
    `phrase` words in a row, cut without overlap, all stand within phrase + slop consecutive words of the document).

    Null and empty texts have no words and no places; without items nothing is hit. Items that share an id are one; a null
    id is written as the empty string. Rows that repeat a doc_id are documents each. Columns besides ids and texts are not read.
    """
    index = PositionalIndex.build(docs, doc_id, text_col, max(32, phrase + slop))
    found = None
    for names, block in _blocks(items, item_id, text_col, phrase):
        hits = materialize(index.search(Windows(names, block, phrase, phrase + slop)), "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "row bigint, places array<struct<a: bigint, b: bigint>>, items array<string>, near array<string>")
    each = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = found.groupBy("row").agg(*(each(c).alias(c) for c in ("places", "items", "near")))
    covered = F.aggregate("places", F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")), lambda m, x: F.struct(
        F.greatest(m["end"], x["b"]).alias("end"), (m["n"] + F.greatest(x["b"] - F.greatest(m["end"], x["a"]), F.lit(0))).alias("n")), lambda m: m["n"])
    out = index.documents().join(found, "row", "left")
    filled = (F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("places", "items", "near"))
    return out.select("doc_id", "n_words", *filled).select("doc_id", "n_words", "places", covered.alias("n_hit"), "items", "near")
