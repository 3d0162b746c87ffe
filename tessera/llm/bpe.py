"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside every partition (operator 3).

Spark deals out the documents; a task cuts its texts into pieces and hands the *distinct* pieces it has not met
yet to a DuckDB query: token-position rows join the merge table and each word's leftmost minimum-rank pair contracts,
until no word has a pair left. Decoding is an ordered aggregation of the tokens' bytes over (document, position) rows.

A piece of more than LONG_WORD bytes is first cut where no token of the vocabulary spans the cut, so that no merge can
cross it; the parts are words of their own. A part that is still longer would take as many rounds as it has tokens, each
over all of them, so its pairs contract in the same order (least rank, then leftmost) by a heap. Texts, words and id
lists of any length are handled in slices: memory does not grow with a text beyond the text and its ids.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import functools
import gc
import hashlib
import re
import threading
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that are cut into pieces at once; bytes of words that contract, tokens that are decoded in one query.
CHUNK_CHARS, CONTRACT_BYTES, DECODE_TOKENS = 2_000_000, 1 << 19, 250_000
#: Memory of a task's DuckDB; a Python worker forgets its words beyond this many; bytes of a word that is cut first.
MEMORY, CACHE_WORDS, LONG_WORD = "256MB", 250_000, 64

#: A Python worker that has had no task for so many seconds gives its codec's memory back, for the stages that follow.
IDLE_SECONDS = 3

_CODECS: dict[tuple, Codec] = {}
_TIMERS: list[threading.Timer] = []

#: One leftmost minimum-rank pair of every word a round; a word's tokens are kept as a list between the rounds.
_CONTRACT = """
WITH RECURSIVE state(w, ts, round) AS (
  SELECT w, list(t ORDER BY p), 0 FROM fresh GROUP BY w
  UNION ALL
  SELECT w, ts[:i - 1] || [m] || ts[i + 2:], round + 1
  FROM state JOIN (
    SELECT w, (min(key) // 65536)::INTEGER AS m, min(key) % 65536 AS i
    FROM (
      SELECT w, m * 65536 + i AS key
      FROM (SELECT w, unnest(ts[:-2]) AS a, unnest(ts[2:]) AS b, unnest(range(1, len(ts))) AS i FROM state)
      JOIN merges ON l = a AND r = b
    ) GROUP BY w
  ) USING (w)
)
SELECT w, arg_max(ts, round) AS ids FROM state GROUP BY w
"""

_DECODE = """
SELECT d, array_to_string(list(b ORDER BY i), '') AS bytes
FROM positions JOIN tokens USING (id) GROUP BY d
"""

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its id on every line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Rows (left id, right id, id of both): every split of every token into two tokens."""
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("the ranks lack single bytes")
    rows = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return np.array(rows, np.int32).reshape(-1, 3)


def certain_cuts(raw: bytes, ranks: dict[bytes, int], begins: set[bytes]) -> list[bytes]:
    """The parts of a word between positions that no token of the vocabulary spans. begins: every prefix of a token."""
    parts, start, reach = [], 0, 1
    for i in range(len(raw)):
        if i >= reach:
            parts.append(raw[start:i])
            start = i
        end = i + 1
        while end < len(raw) and raw[i : end + 1] in begins:
            end += 1
            if raw[i:end] in ranks:
                reach = max(reach, end)
        reach = max(reach, i + 1)
    return [*parts, raw[start:]]


def contract_by_heap(raw: bytes, ranks: dict[bytes, int]) -> np.ndarray:
    """The ids of one long word: the pair of least rank, of these the leftmost, contracts until none is left."""
    n = len(raw)
    # where the token that begins at a position ends (-1: none begins there), and where the one before it begins
    ends, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    heap = [r << 40 | i for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        rank, i = divmod(heappop(heap), 1 << 40)
        middle = ends[i]
        if middle < 0 or middle >= n or ranks.get(raw[i : ends[middle]]) != rank:
            continue  # one of the two has contracted meanwhile
        end = ends[i] = ends[middle]
        ends[middle] = -1
        if end < n:
            before[end] = i
            if (r := ranks.get(raw[i : ends[end]])) is not None:
                heappush(heap, r << 40 | i)
        if i and (r := ranks.get(raw[before[i] : end])) is not None:
            heappush(heap, r << 40 | before[i])
    ids, i = array("i"), 0
    while i < n:
        ids.append(ranks[raw[i : ends[i]]])
        i = ends[i]
    return np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)


class Codec:
    """Encodes and decodes on one executor; holds an in-memory DuckDB with the merge table."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray, pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.register("given", pa.table({"l": merges[:, 0], "r": merges[:, 1], "m": merges[:, 2].astype(np.int64)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"id": pa.array(ranks.values(), pa.int32()), "b": pa.array([t.decode("latin1") for t in ranks])}))
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.decimal = np.array([str(i) for i in range(max(ranks.values()) + 1)], object)
        #: Ids of words as they stand between two single spaces; None: the pattern must see what is around them.
        self.words: dict[str, bytes | None] = {}
        #: Ids of pieces that are no token.
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def begins(self) -> set[bytes]:
        """Every prefix of a token; only long words ask for it."""
        return {t[:i] for t in self.ranks for i in range(1, len(t) + 1)}

    def contract(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words of at most LONG_WORD bytes, some at a time."""
        out, at, size = {}, 0, 0
        for n, x in enumerate(words, 1):
            size += len(x)
            if size >= CONTRACT_BYTES or n == len(words):
                fresh = words[at:n]
                flat = np.frombuffer(b"".join(fresh), np.uint8)
                lengths = np.array([*map(len, fresh)])
                place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                self.db.register("fresh", pa.table({"w": np.repeat(np.arange(len(fresh), dtype=np.int32), lengths), "p": place.astype(np.int32), "t": self.single[flat]}))
                found = self.db.sql(_CONTRACT).to_arrow_table()
                lists = found.column("ids").combine_chunks()
                ids, ends = lists.values.to_numpy().astype("<i4"), lists.offsets.to_numpy()
                for i, w in enumerate(found.column("w").to_pylist()):
                    out[fresh[w]] = ids[ends[i] : ends[i + 1]].tobytes()
                at, size = n, 0
        return out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces of the pattern."""
        out = {x: self.known[x] for x in pieces & self.known.keys()}
        cut, fresh = {}, {}
        for x in pieces - self.known.keys():
            raw = x.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[x] = whole.to_bytes(4, "little")
            elif len(raw) <= LONG_WORD:
                fresh[raw] = None
                cut[x] = (raw,)
            else:
                cut[x] = certain_cuts(raw, self.ranks, self.begins)
                fresh.update((p, None) for p in cut[x] if len(p) <= LONG_WORD)
        known = self.contract([*fresh])
        for x, parts in cut.items():
            out[x] = self.known[x] = b"".join(known[p] if p in known else contract_by_heap(p, self.ranks).astype("<i4").tobytes() for p in parts)
        return out

    def by_pattern(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that the pattern cuts as they stand; a long one is read some pieces at a time."""
        out: list[bytes] = [b""] * len(texts)
        small = [i for i, x in enumerate(texts) if len(x) <= CHUNK_CHARS]
        cut = [self.pattern.findall(texts[i]) for i in small]
        known = self.learn({p for pieces in cut for p in pieces})
        for i, pieces in zip(small, cut, strict=True):
            out[i] = b"".join(map(known.__getitem__, pieces))
        for i, x in enumerate(texts):
            if len(x) > CHUNK_CHARS:
                ids, pieces = bytearray(), []
                for m in self.pattern.finditer(x):
                    pieces.append(m[0])
                    if len(pieces) == 200_000:
                        known, held, pieces = self.learn({*pieces}), pieces, []
                        ids += b"".join(map(known.__getitem__, held))
                known = self.learn({*pieces})
                out[i] = bytes(ids + b"".join(map(known.__getitem__, pieces)))
        return out

    def _slices(self, texts: list[str]) -> Iterator[list[tuple[int, bool, str]]]:
        """(text number, goes on after a space, slice), together about CHUNK_CHARS long. Between two characters that are
        not white space a single space always begins a piece, so long texts are cut there; the space itself is left out."""
        group, size = [], 0
        for i, x in enumerate(texts):
            at, on = 0, False
            while at >= 0:
                cut = _LONE_SPACE.search(x, at + CHUNK_CHARS) if len(x) - at > CHUNK_CHARS else None
                part = x[at : cut.start()] if cut else x[at:]
                group.append((i, on, part))
                size += len(part)
                at, on = (cut.end(), True) if cut else (-1, True)
                if size >= CHUNK_CHARS:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [bytearray() for _ in texts]
        for group in self._slices(texts):
            for (i, _, _), ids in zip(group, self._encode(group), strict=True):
                out[i] += ids
        return [np.frombuffer(x, "<i4") for x in out]

    def _encode(self, group: list[tuple[int, bool, str]]) -> list[bytes]:
        """A slice is cut at its spaces and the words are looked up; one with other white space beside a space is cut
        by the pattern."""
        parts = [x.split(" ") for _, _, x in group]
        heads = [None if on else x.pop(0) for (_, on, _), x in zip(group, parts, strict=True)]
        used = {p for x in parts for p in x}
        if len(self.words) + len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.words = {p: self.words[p] for p in used & self.words.keys()}
        fresh = list(used - self.words.keys())
        odd = [not p or p[0].isspace() or p[-1].isspace() for p in fresh]
        self.words.update((p, None) for p, bad in zip(fresh, odd, strict=True) if bad)
        fresh = [p for p, bad in zip(fresh, odd, strict=True) if not bad]
        self.words.update(zip(fresh, self.by_pattern([" " + p for p in fresh]), strict=True))
        first = iter(self.by_pattern([h for h in heads if h is not None]))
        out: list[bytes | None] = []
        for head, x in zip(heads, parts, strict=True):
            ids = b"" if head is None else next(first)
            try:
                # a head that ends in white space could give its last character to what follows
                out.append(None if head is not None and x and (not head or head[-1].isspace()) else ids + b"".join(map(self.words.__getitem__, x)))
            except TypeError:
                out.append(None)
        rest = iter(self.by_pattern([" " * on + x for (_, on, x), o in zip(group, out, strict=True) if o is None]))
        return [next(rest) if o is None else o for o in out]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list, however long; an empty list gives none."""
        lengths = np.array([len(x) for x in ids], np.int64)
        ends, out = np.cumsum(lengths), [[] for _ in ids]
        for low in range(0, int(lengths.sum()), DECODE_TOKENS):
            high = low + DECODE_TOKENS
            own = range(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left")) + 1)
            runs = [(d, ids[d][max(0, low - (ends[d] - lengths[d])) : max(0, high - (ends[d] - lengths[d]))]) for d in own if d < len(ids)]
            flat = np.concatenate([x for _, x in runs]).astype(np.int32)
            d = np.repeat(np.array([d for d, _ in runs], np.int32), [len(x) for _, x in runs])
            self.db.register("positions", pa.table({"d": d, "i": np.arange(len(flat), dtype=np.int32), "id": flat}))
            found = self.db.sql(_DECODE).to_arrow_table()
            for d, text in zip(found.column("d").to_pylist(), found.column("bytes").to_pylist(), strict=True):
                out[d].append(text.encode("latin1"))
        return [b"".join(x) for x in out]

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        found = hashlib.sha256()
        for at in range(0, len(ids), DECODE_TOKENS):
            found.update((("," if at else "") + ",".join(self.decimal[ids[at : at + DECODE_TOKENS]].tolist())).encode())
        return found.hexdigest()


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about `most` in all."""
    at = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= most or i + 1 == len(sizes):
            yield at, i + 1
            at, size = i + 1, 0


def _with_codec(spark: SparkSession, path: str, pattern: str, work: Callable[[Codec, pa.RecordBatch], pa.RecordBatch], column: int, most: int):
    ranks = read_ranks(path)
    given = spark.sparkContext.broadcast((ranks, merge_table(ranks)))  # the vocabulary: about 50,000 tokens, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, pattern)  # the worker keeps its codec for its next tasks
        while _TIMERS:
            _TIMERS.pop().cancel()
        if key not in _CODECS:
            _CODECS[key] = Codec(*given.value, pattern)
        codec = _CODECS[key]
        gc.disable()  # nothing here makes cycles, and collections would walk the cached words
        try:
            for batch in batches:
                values = batch.column(column)
                sizes = pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length(values)
                for a, b in _runs(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), most):
                    yield work(codec, batch.slice(a, b - a))
        finally:
            gc.enable()
            _TIMERS.append(threading.Timer(IDLE_SECONDS, _release))
            _TIMERS[-1].daemon = True
            _TIMERS[-1].start()

    return run


def _release() -> None:
    _CODECS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row; a null or empty text has an empty array. Special tokens' strings
    are ordinary text. Rows keep their number, repeats included; other columns are not read."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def work(codec, batch):
        found = codec.encode(_texts(batch.column(1)))
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_with_codec(docs.sparkSession, path, pattern, work, 1, CHUNK_CHARS), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and bytes (binary) of every row of encode()'s result; null ids give no bytes."""
    path, pattern = path or default_vocabulary()[0], default_vocabulary()[1]

    def work(codec, batch):
        lists = batch.column(1).fill_null([])
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
        found = codec.decode([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_with_codec(encoded.sparkSession, path, pattern, work, 1, DECODE_TOKENS), f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes the ids again in the same task: doc_id, the columns named in `keep`, n_tokens,
    ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded bytes). Null and empty texts have
    no tokens and the digests of nothing; rows keep their number, repeats included; other columns are not read."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def work(codec, batch):
        found = codec.encode(_texts(batch.column(1)))
        decoded = [hashlib.sha256(x).hexdigest() for x in codec.decode(found)]
        columns = [batch.column(i) for i in range(batch.num_columns) if i != 1]
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in found], pa.int64()), pa.array([codec.digest(x) for x in found], pa.string()), pa.array(decoded, pa.string())], ["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema if x.name != "text")
    return rows.mapInArrow(_with_codec(docs.sparkSession, path, pattern, work, 1, CHUNK_CHARS), f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
