"""Quality classifier from weak labels (operator 7).

Overlapping heuristic labellers vote good, bad or nothing on every document. Votes are counted by pattern over all
documents; expectation-maximisation over the patterns estimates the prior and every labeller's accuracy for either
class, without gold labels. The posterior labels of a bounded sample train a linear scorer over hashed features
(words and binned statistics), which then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernels
from tessera.sources.shared import unused

#: Distinct texts that the scorer is fitted on, at most about; the width of the hashed features; words of a text that it hashes count by frequency.
SAMPLE_ROWS, WIDTH = 6000, 1 << 12
LABELLERS = ("symbols", "capitals", "adjacent_repeats", "distinct_words", "bare_symbols", "exclamations", "short_words")
GOOD, BAD, NONE = 1, 0, 2
#: (bad from, good up to) by labeller; for the labellers of _LOW, bad up to and good from.
THRESHOLDS = {"symbols": (0.25, 0.02), "capitals": (0.5, 0.2), "adjacent_repeats": (0.25, 0.05), "distinct_words": (0.15, 0.4), "bare_symbols": (0.2, 0.02), "exclamations": (0.5, 0.1), "short_words": (0.04, 0.12)}
_LOW = ("distinct_words", "short_words")
#: Labellers that need a number of words to say anything.
LEAST_WORDS = {"adjacent_repeats": 5, "distinct_words": 20, "short_words": 20, "capitals": 3}

_CLASS = {"upper": np.zeros(256, bool), "letter": np.zeros(256, bool), "symbol": np.zeros(256, bool), "bang": np.zeros(256, bool)}
_CLASS["upper"][65:91] = True
_CLASS["letter"][[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_CLASS["symbol"][[*b"#*$%&|<>~^_=\\{}"]] = True
_CLASS["bang"][ord("!")] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: the share for every labeller (rows by labellers), word hashes, and the row of each word."""
    hashes, rows, lengths = textkernels.words(data, offsets)
    n_rows = len(offsets) - 1
    n = np.bincount(rows, minlength=n_rows)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    count = {k: per_row(v[data]) for k, v in _CLASS.items()}
    if len(data):  # capitals of the Latin-1 block: C3 80 to C3 9E
        wide = np.zeros(len(data), bool)
        wide[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        count["upper"] = count["upper"] + per_row(wide)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    ends = np.cumsum(n)
    distinct = np.array([len(np.unique(hashes[b - m : b])) for b, m in zip(ends, n, strict=True)], np.float64)
    bare = lengths <= 3
    starts = np.flatnonzero(~textkernels._SPACE[data] & np.concatenate([[True], textkernels._SPACE[data[:-1]]])) if len(data) else np.zeros(0, int)
    if len(starts) != len(hashes):  # a text that begins right behind another one's last word
        starts = _starts(data, offsets)
    bare_symbol = bare & _CLASS["symbol"][data[starts]]
    words = np.maximum(n, 1)
    by = lambda flags: np.bincount(rows, flags, n_rows)
    shares = np.stack([
        count["symbol"] / words, count["upper"] / np.maximum(count["letter"], 1), by(same) / words, distinct / words * np.maximum(1, np.log2(words / 64 + 1)),
        by(bare_symbol) / words, count["bang"] / words, by(bare & ~bare_symbol) / words], 1)
    return np.concatenate([shares, n[:, None]], 1), hashes, rows


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    solid = ~textkernels._SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    first = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
    opens[first] = solid[first]
    return np.flatnonzero(opens)


def votes(shares: np.ndarray) -> np.ndarray:
    out = np.full((len(shares), len(LABELLERS)), NONE, np.int8)
    n = shares[:, -1]
    for i, name in enumerate(LABELLERS):
        bad, good = THRESHOLDS[name]
        x = shares[:, i]
        is_bad, is_good = (x <= bad, x >= good) if name in _LOW else (x >= bad, x <= good)
        speaks = n >= LEAST_WORDS.get(name, 1)
        out[speaks & is_bad, i], out[speaks & is_good, i] = BAD, GOOD
    return out


def features(shares: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse hashed features (row, index, value): word frequencies, and each statistic's bin."""
    n = len(shares)
    cell = rows * WIDTH + (hashes % np.uint64(WIDTH // 2)).astype(np.int64)
    cell, times = np.unique(cell, return_counts=True)
    row, index = cell // WIDTH, cell % WIDTH
    value = times / np.maximum(shares[row, -1], 1) ** 0.5 * 0.1
    bins = np.clip(np.ceil(np.log2(np.maximum(shares[:, :-1], 1e-3))) + 10, 0, 15).astype(np.int64)
    length = np.clip(np.log2(shares[:, -1] + 1), 0, 15).astype(np.int64)
    bins = np.concatenate([bins, length[:, None]], 1)
    bin_index = WIDTH // 2 + (textkernels.mix((np.arange(bins.shape[1])[None, :] * 64 + bins).astype(np.uint64)) % np.uint64(WIDTH // 2)).astype(np.int64)
    return (np.concatenate([row, np.repeat(np.arange(n), bins.shape[1])]), np.concatenate([index, bin_index.ravel()]), np.concatenate([value, np.ones(bins.size)]).astype(np.float32))


def _each_chunk(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for at, data, offsets in textkernels.chunks(batch.column("text")):
        with np.errstate(over="ignore"):
            yield (at, *statistics(data, offsets))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    power = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        for _, shares, _, _ in _each_chunk(batch):
            pattern, times = np.unique(votes(shares).astype(np.int64) @ power, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(times)], ["pattern", "n"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for two classes with votes independent given the class. patterns: rows of votes. Returns the posterior of good
    for each pattern, the vote probabilities (class, labeller, vote), and the prior of good. Begins with every document bad
    that a labeller finds bad."""
    good = np.where((patterns == BAD).any(1), 0.05, 0.95)
    prior, chance = 0.5, np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        for vote in (BAD, GOOD):
            chance[:, :, vote] = weight @ (patterns == vote) + 0.5
        chance[:, :, :2] /= chance[:, :, :2].sum(2, keepdims=True)
        chance[:, :, NONE] = 1  # a labeller that says nothing speaks for neither class
        log = np.log(chance)
        score = np.stack([np.log([1 - prior, prior])[c] + log[c][np.arange(patterns.shape[1])[None, :], patterns].sum(1) for c in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, chance, prior


def fit(row: np.ndarray, index: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft targets by full-batch Adagrad; the last weight is the bias."""
    w, seen = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-8)
    n = max(len(target), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[index], len(target)) + w[-1], -30, 30)))
        error = (p - target) / n
        g = np.bincount(index, value * error[row], WIDTH + 1) + decay * w
        g[-1] = error.sum()
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


class QualityModel:
    def __init__(self, weights: np.ndarray, chance: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior
        #: of each labeller, how often its vote on a good and on a bad document is right
        self.accuracy = {name: (float(chance[1, i, GOOD] / chance[1, i, :2].sum()), float(chance[0, i, BAD] / chance[0, i, :2].sum())) for i, name in enumerate(LABELLERS)}

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
        """docs with quality_score, the probability of good; a document without words scores 0. Columns keep their names;
        one with the name of `score_col` is replaced."""
        weights = self.weights
        given = docs.drop(score_col)
        given = given.withColumn(unused("text", given), F.col(f"`{text_col}`").cast("string"))
        names = given.columns[:-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                texts = whole.column(whole.num_columns - 1)
                for at, data, offsets in textkernels.chunks(texts):
                    with np.errstate(over="ignore"):
                        shares, hashes, rows = statistics(data, offsets)
                    row, index, value = features(shares, hashes, rows)
                    p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * weights[index], len(shares)) + weights[-1], -30, 30)))
                    p[shares[:, -1] == 0] = 0
                    part = whole.slice(at, len(shares))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p)], [*names, score_col])

        from pyspark.sql.types import DoubleType, StructField, StructType

        return given.mapInArrow(run, StructType([*given.schema.fields[:-1], StructField(score_col, DoubleType())]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Vote patterns cover all documents (their number is bounded by the labellers); only the scorer's fit is on a sample,
    of about `sample_rows` distinct texts (all, if there are fewer) drawn by a hash. The rate follows the number of
    distinct texts, so copies do not thin the sample out."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    patterns = texts.mapInArrow(_vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    code = np.array([x["pattern"] for x in patterns], np.int64)
    counts = np.array([x["n"] for x in patterns], np.float64)
    power = 3 ** np.arange(len(LABELLERS))
    good, chance, prior = estimate(code[:, None] // power % 3, counts)
    posterior = dict(zip(code.tolist(), good.tolist(), strict=True))
    parts = 1_000_003
    keep = F.abs(F.xxhash64("text") % parts)
    n_distinct = texts.agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).first()["n"]
    part = int(min(parts, parts * sample_rows / max(n_distinct, 1)))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, shares, hashes, rows in _each_chunk(batch):
                row, index, value = features(shares, hashes, rows)
                label = np.array([posterior[p] for p in (votes(shares).astype(np.int64) @ power).tolist()])
                order = np.argsort(row, kind="stable")
                ends = np.cumsum(np.concatenate([[0], np.bincount(row, minlength=len(shares))])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in (index.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([pa.array(label), *lists], ["label", "index", "value"])

    # a hash picks all copies of a text or none, so copies become one row before they are read
    def draw(part: int) -> pa.Table:
        distinct = texts.where(keep <= part).dropDuplicates(["text"])
        return distinct.mapInArrow(sampled, "label double, index array<int>, value array<float>").toArrow()

    chosen = draw(part)
    while not len(chosen) and n_distinct and part < parts:  # a small sample can miss every text
        part = min(parts, 8 * part + 1)
        chosen = draw(part)
    if not len(chosen):
        return QualityModel(np.zeros(WIDTH + 1), chance, prior)
    index, value = (chosen.column(c).combine_chunks() for c in ("index", "value"))
    row = np.repeat(np.arange(len(chosen)), np.asarray(index.value_lengths()))
    return QualityModel(fit(row, index.values.to_numpy(), value.values.to_numpy(), chosen.column("label").to_numpy()), chance, prior)


def classify(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with quality_score and kept (score at least `threshold`). Null, empty and white texts are not kept; equal
    texts are judged alike; an empty table gives an empty result."""
    scored = train(docs, text_col=text_col).score(docs, text_col)
    return scored.withColumn("kept", F.col("quality_score") >= threshold)
