"""Vectorised word and shingle hashing over Arrow string columns.

The functions work on the byte buffer of a whole Arrow batch with numpy, so a
task spends a few nanoseconds a byte and never makes a Python string per word.
Words are ``[^\\x20\\x09-\\x0D]+``; every separator is ASCII, so UTF-8 text can
be cut at byte level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once: bounds the temporary arrays (about 60 bytes for each byte of text).
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of mixed values look random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = ~_SPACE
#: Bytes of words of letters and digits: ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``.
ALPHANUMERIC = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def chunks(texts: pa.Array):
    """Cuts a string array into runs of about CHUNK_BYTES: (first row, bytes, offsets from 0); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def pieces(texts: pa.Array, solid: np.ndarray = _SOLID):
    """As chunks, but with a row's number for every run: (bytes, offsets from 0, rows); a text longer than CHUNK_BYTES is
    cut at bytes that stand outside words, so that memory does not grow with it."""
    for at, data, offsets in chunks(texts):
        if len(data) <= 2 * CHUNK_BYTES:
            yield data, offsets, np.arange(at, at + len(offsets) - 1)
            continue
        start = 0
        while start < len(data):
            end = min(start + CHUNK_BYTES, len(data))
            while end < len(data):
                outside = np.flatnonzero(~solid[data[end : end + CHUNK_BYTES]])
                end = min(end + (int(outside[0]) if len(outside) else CHUNK_BYTES), len(data))
                if len(outside):
                    break
            yield data[start:end], np.array([0, end - start]), np.array([at])
            start = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, solid: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, byte length) of every word of a chunk, in text order; solid tells the bytes of words."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty
    solid = solid[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    first = offsets[:-1][(offsets[:-1] < n) & (np.diff(offsets) > 0)]
    opens[first] = solid[first]
    starts = np.flatnonzero(opens)
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    last = first[1:] - 1
    closes[last] |= solid[last]
    ends = np.flatnonzero(closes) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, ends - starts


def word_counts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, minlength=n_rows)


def shingles(hashes: np.ndarray, n_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word windows with their counts; a row of 1 to k-1 words has its whole sequence as one."""
    ends = np.cumsum(n_words)
    starts = ends - n_words
    windows = np.maximum(n_words - k + 1, 0)
    short = (n_words > 0) & (n_words < k)
    counts = windows + short
    total = len(hashes)
    full = np.zeros(max(total - k + 1, 0), np.uint64)
    weight = np.uint64(1)
    for m in range(k):
        full += hashes[m : m + len(full)] * weight
        weight *= _STEP
    out = np.zeros(int(counts.sum()), np.uint64)
    place = np.cumsum(counts) - counts
    if windows.any():
        rep = np.repeat(np.arange(len(windows)), windows)
        within = np.arange(len(rep)) - np.repeat(np.cumsum(windows) - windows, windows)
        out[place[rep] + within] = full[starts[rep] + within]
    for i in np.flatnonzero(short):
        value, weight = np.uint64(n_words[i]) * np.uint64(0x2545F4914F6CDD1D), np.uint64(1)
        for h in hashes[starts[i] : ends[i]]:
            value = value + h * weight
            weight = weight * _STEP
        out[place[i]] = value
    return mix(out), counts


def shingle_sets(texts: pa.Array, k: int):
    """Yields (row, sorted distinct shingle hashes as uint64) for every row of a string array."""
    with np.errstate(over="ignore"):
        for at, data, offsets in chunks(texts):
            hashes, rows, _ = words(data, offsets)
            found, counts = shingles(hashes, word_counts(rows, len(offsets) - 1), k)
            ends = np.cumsum(counts)
            for i, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
                yield at + i, np.unique(found[a:b])
