"""Posting lists: made in runs of documents by the tasks that read them, so that what is shuffled and stored names a term once a run, not once a place."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens are runs of ASCII letters, digits and underscores.
TOKEN = "[0-9a-zA-Z_]+"
#: Parts of an index, by the checksum of a term.
BUCKETS = 64
#: Tokens of a run: a term's documents among these are one row. Bounds a task's memory, whatever its rows.
RUN_TOKENS = 2_000_000
#: Rows of a batch that goes back to the JVM.
_ROWS = 1024


def lists_type(key_type: str, positions: bool) -> str:
    """A row is a term's postings within a run: keys, lengths of their fields, and where each one's share of the positions ends (running sums of tf)."""
    return f"field string, term string, keys array<{key_type}>, lens array<int>, ends array<int>{', positions array<int>' if positions else ''}, bucket int"


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _ranked(terms: pa.Array) -> tuple[np.ndarray, list[str], list[int]]:
    """The rank of each term in order of (bucket, term), and the terms and buckets by rank."""
    found = terms.dictionary_encode()
    names = found.dictionary.to_pylist()
    buckets = [bucket_of(x) for x in names]
    order = sorted(range(len(names)), key=lambda i: (buckets[i], names[i]))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    return rank[found.indices.to_numpy(zero_copy_only=False)], [names[i] for i in order], [buckets[i] for i in order]


def _batches(field: str, names: list, buckets: list[int], rank: np.ndarray, keys: pa.Array, lens: np.ndarray, tf: np.ndarray, positions: np.ndarray | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of postings that are in order of rank; positions are those of all postings, one behind the other."""
    first = np.flatnonzero(np.diff(rank, prepend=-1))
    cuts = pa.array(np.append(first, len(rank)), pa.int32())
    upto = np.cumsum(tf)
    before = (upto - tf)[first]
    ends = upto - np.repeat(before, np.diff(np.append(first, len(rank))))
    of = lambda values: pa.ListArray.from_arrays(cuts, values)
    columns = {"field": pa.array([field] * len(first)), "term": pa.array([names[i] for i in rank[first]], pa.string()), "keys": of(keys), "lens": of(pa.array(lens, pa.int32())), "ends": of(pa.array(ends, pa.int32())),
               "bucket": pa.array([buckets[i] for i in rank[first]], pa.int32())}
    if positions is not None:
        columns["positions"] = pa.ListArray.from_arrays(pa.array(np.append(before, upto[-1]), pa.int32()), pa.array(positions, pa.int32()))
    table = pa.Table.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)
    yield from table.to_batches(max_chunksize=_ROWS)


def posting_lists(docs: DataFrame, key_type: str, fields: tuple[str, ...], positions: bool) -> DataFrame:
    """Rows of lists_type() of documents (key and fields). Null fields are empty; those without a token stand in rows without a term, in a bucket of their own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = docs.sparkSession.createDataFrame([], lists_type(key_type, positions)).schema
    words = re.compile(TOKEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)

        def emit(field: str, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            keys, lens = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
            none = np.flatnonzero(lens == 0)
            if len(none):
                zero = np.zeros(len(none), np.int64)
                yield from _batches(field, [None], [BUCKETS], zero, keys.take(pa.array(none)), zero, zero, zero[:0] if positions else None, schema)
            if not lens.sum():
                return
            rank, names, buckets = _ranked(pa.concat_arrays([x[2] for x in held]))
            doc, at = np.repeat(np.arange(len(lens)), lens), np.arange(len(rank)) - np.repeat(np.cumsum(lens) - lens, lens)
            order = np.argsort(rank, kind="stable")
            rank, doc, at = rank[order], doc[order], at[order]
            first = np.flatnonzero((np.diff(rank, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            doc, tf = doc[first], np.diff(np.append(first, len(rank)))
            yield from _batches(field, names, buckets, rank[first], keys.take(pa.array(doc)), lens[doc], tf, at if positions else None, schema)

        held: dict[str, list[tuple]] = {f: [] for f in fields}
        tokens = rows = 0
        for batch in batches:
            for i, field in enumerate(fields, 1):
                found = [words.findall(x) if x else () for x in batch.column(i).to_pylist()]
                lens = np.fromiter(map(len, found), np.int64, len(found))
                held[field].append((batch.column(0), lens, pa.array([w.lower() for some in found for w in some], pa.string())))
                tokens, rows = tokens + int(lens.sum()), rows + len(found)
            if max(tokens, rows) >= RUN_TOKENS:
                for field, some in held.items():
                    yield from emit(field, some)
                    some.clear()
                tokens = rows = 0
        for field, some in held.items():
            if some:
                yield from emit(field, some)

    return docs.select(F.col("key").cast(key_type).alias("key"), *fields).mapInArrow(run, out)


def merged_lists(postings: DataFrame, key_type: str) -> DataFrame:
    """Rows of lists_type() with positions, of postings (field, key, len, term, tf, positions) that come in any order: a run is what a task meets of them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = postings.sparkSession.createDataFrame([], lists_type(key_type, True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)

        def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            for field in table["field"].unique().to_pylist():
                mine = table.filter(pc.equal(table["field"], field))
                for some in (mine.filter(mine["term"].is_null()), mine.filter(mine["term"].is_valid())):
                    if not some.num_rows:
                        continue
                    some = some.combine_chunks()
                    terms = some["term"].combine_chunks()
                    rank, names, buckets = (np.zeros(len(terms), np.int64), [None], [BUCKETS]) if terms.null_count else _ranked(terms)
                    order = np.argsort(rank, kind="stable")
                    some = some.take(pa.array(order))
                    column = lambda c, some=some: some[c].combine_chunks()
                    yield from _batches(field, names, buckets, rank[order], column("key"), column("len").to_numpy(), column("tf").to_numpy().astype(np.int64), column("positions").flatten().to_numpy(), schema)

        held, places = [], 0
        for batch in batches:
            held.append(batch)
            places += batch.num_rows + len(batch.column(batch.schema.get_field_index("positions")).flatten())
            if places >= 2 * RUN_TOKENS:
                yield from emit(held)
                held, places = [], 0
        if held:
            yield from emit(held)

    return postings.select("field", "key", "len", "term", "tf", "positions").mapInArrow(run, out)


def by_bucket(lists: DataFrame) -> DataFrame:
    """Few files of even size a part: adaptive execution splits the parts of very frequent terms; within a file terms are in order, so a
    query reads the row groups of its terms only."""
    return lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")


def of_terms(lists: DataFrame, terms: list[str]) -> DataFrame:
    return lists.where(F.col("bucket").isin(*sorted({bucket_of(x) for x in terms})) & F.col("term").isin(*terms))


def unpacked(lists: DataFrame, positions: bool) -> DataFrame:
    """A row a posting in place of `keys`, `lens`, `ends` and `positions`: key, len, tf and positions."""
    rest = [c for c in lists.columns if c not in ("keys", "lens", "ends", "positions")]
    rows = lists.select("*", F.posexplode("keys").alias("_i", "key"))
    start = F.coalesce(F.get("ends", F.col("_i") - 1), F.lit(0))
    tf = F.get("ends", F.col("_i")) - start
    own = [F.slice("positions", start + 1, tf).alias("positions")] if positions else []
    return rows.select(*rest, "key", F.get("lens", F.col("_i")).alias("len"), tf.alias("tf"), *own)
