"""Decontamination, ranked search and hard negatives against brute force, with odd rows, long texts and small blocks."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, hard_negatives, lexical_search
from tessera.llm.textkernels import CHUNK_BYTES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 1009}" for i in range(150_000))  # longer than two segments and than a chunk of bytes


def words(x):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def documents():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)] + ["the", "of", "Él", "Ünd", "naïve"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 8, 12, 60, 300)))) for _ in range(60)]
    phrase = "one Two three, four five six seven eight nine ten eleven"
    texts += [None, "", " \n\t", phrase, phrase.upper(), f"x {phrase} y {phrase}", "one two three four five 6 six seven eight nine ten", "ten nine eight seven six five four three two one", LONG, LONG + " " + phrase, "the " * 50, phrase, "short item", "a short item here"]
    return [(i, x) for i, x in enumerate(texts)] + [(3, texts[3]), (None, phrase)], phrase


def items(docs, phrase):
    rng = random.Random(5)
    found = [(0, phrase), (1, "short Item"), (2, None), (3, "--"), (4, "absent words only"), (5, "the " * 12), (6, "word " + phrase), (None, "short item"), (7, " ".join(f"w{i % 1009}" for i in range(65_530, 65_560)))]
    for i, (_, x) in enumerate(docs[:30]):
        w = words(x)
        at = rng.randrange(max(len(w) - 20, 1))
        found.append((10 + i, " ".join(w[at : at + rng.choice((3, 9, 10, 11, 25))])))
    return found + [(10, "one more text of item ten")]


def frame(spark, rows, first):
    return spark.createDataFrame([(i, x, 1, "x", 2) for i, x in rows], f"{first} bigint, text string, row int, items string, n_words int").repartition(3)


def brute(docs, asked, phrase, slop):
    windows, cuts = collections.defaultdict(set), collections.defaultdict(set)
    for item, x in asked:
        w, name = words(x), "" if item is None else str(item)
        n = max(len(w) - phrase + 1, 1) if w else 0
        for i in range(n):
            windows[tuple(w[i : i + phrase])].add(name)
            if i % phrase == 0 or i == n - 1:
                cuts[frozenset(w[i : i + phrase])].add(name)
    sizes, starts = {len(x) for x in windows}, collections.defaultdict(list)
    for c in cuts:
        for x in c:
            starts[x].append(c)
    out = []
    for d, x in docs:
        w, hit, found, near = words(x), set(), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        for i, word in enumerate(w):
            for c in starts.get(word, ()):
                if not cuts[c] <= near and c <= set(w[i : i + phrase + slop]):
                    near |= cuts[c]
        out.append((str(d), len(w), len(hit), tuple(sorted(found)), tuple(sorted(near))))
    return sorted(out)


@pytest.mark.parametrize("block", [decontamination.BLOCK_WORDS, 40])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    docs, phrase = documents()
    asked = items(docs, phrase)
    found = decontamination.decontaminate(frame(spark, docs, "doc_id"), frame(spark, asked, "item_id"))
    rows = found.collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near)) for r in rows) == brute(docs, asked, 10, 5)
    for r in rows:
        assert len(set().union(*(range(p.a, p.b) for p in r.places)) if r.places else ()) == r.n_hit


def test_decontamination_of_nothing(spark):
    docs, phrase = documents()
    few, none = frame(spark, docs[-4:], "doc_id"), frame(spark, [], "doc_id")
    assert decontamination.decontaminate(none, frame(spark, [(1, phrase)], "item_id")).collect() == []
    assert {(r.n_hit, *r["items"], *r.near) for r in decontamination.decontaminate(few, frame(spark, [], "item_id")).collect()} == {(0,)}
    with pytest.raises(ValueError, match="reach"):
        decontamination.PositionalIndex.build(few, reach=8).search(decontamination.Windows(["x"], [(0, np.arange(20).astype(np.uint64))], 10, 10))


def test_words_of_long_texts_come_in_parts():
    texts = ["", LONG * 2, None, "a B", "é" * (CHUNK_BYTES + 7) + " tail", "x"]
    found = collections.defaultdict(list)
    ended = collections.Counter()
    for r, h, end in decontamination.word_hashes(pa.array(texts)):
        found[r] += h.tolist()
        ended[r] += end
    assert ended == dict.fromkeys(range(6), 1)
    assert [len(found[r]) for r in range(6)] == [len(words(x)) for x in texts]
    assert found[1][:1009] == found[1][1009:2018] and len(set(found[1])) <= 1010


def brute_search(docs, asked, k):
    counts = [(d, collections.Counter(words(x))) for d, x in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total, df, terms = len(counts), sum(sum(c.values()) for _, c in counts), collections.Counter(), collections.defaultdict(set)
    for _, c in counts:
        df.update(c.keys())
    for item, x in asked:
        terms[item] |= set(words(x)) & set(df)
    out = []
    for item, own in terms.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(str(item), r + 1, str(d), -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block", "k"), [(1 << 19, 1 << 17, 50), (60, 20, 5)])
def test_ranked_search(spark, monkeypatch, shard, block, k):
    for name, value in (("SHARD_POSTINGS", shard), ("BLOCK_TERMS", block), ("FIRST_ROUND", 2)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, phrase = documents()
    asked = items(docs, phrase)
    found = lexical_search.ranked_search(frame(spark, docs, "doc_id"), frame(spark, asked, "item_id"), k=k)
    assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in found.collect()) == brute_search(docs, asked, k)


def test_ranked_search_of_nothing(spark):
    one, none = frame(spark, [(1, "a b")], "doc_id"), frame(spark, [], "doc_id")
    asked = frame(spark, [(1, "a")], "item_id")
    for docs, rows in ((none, asked), (one, asked.limit(0)), (one, frame(spark, [(1, "zz"), (2, None)], "item_id"))):
        assert lexical_search.ranked_search(docs, rows).collect() == []


def test_the_threshold_stops_early():
    """Only the first rounds of long lists are read where a few documents stand out."""
    n, k = 20_000, 5
    tf = np.ones(n, np.int64)
    tf[:k] = 1000
    shard = lexical_search._Shard.__new__(lexical_search._Shard)
    impact = (10**9 * tf // (1000 * tf + 20 * 100)).astype(np.int64)
    shard.ids, shard.ends, shard.docs, shard.impacts = list(range(n)), np.array([n], np.int32), np.argsort(-impact, kind="stable").astype(np.int32), np.sort(impact)[::-1].astype(np.int32)
    shard.place, shard.doc_ends, shard.term, shard.impact = np.array([0]), np.arange(1, n + 1), np.zeros(n, np.int32), impact
    shard.weight, shard.seen = np.zeros(1, np.int64), np.zeros(n, bool)
    looked = []
    shard.scores = lambda docs, f=shard.scores: looked.append(len(docs)) or f(docs)
    assert [x[2] for x in shard.best(np.array([0]), np.array([3]), k, 0)] == [0, 1, 2, 3, 4]
    assert sum(looked) == lexical_search.FIRST_ROUND


def vectors(seed=2, n=300, dim=7):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    rows = [(i, int(i % 4), [float(np.float32(v)) for v in centres[i % 4 if i % 9 else (i + 1) % 4] + 0.4 * rng.standard_normal(dim)]) for i in range(n)]
    rows += [(n + 1, 1, None), (n + 2, None, rows[0][2]), (None, 1, rows[0][2]), (n + 3, 1, [float("nan")] * dim), (n + 4, 1, [None] * dim), (n + 5, 2, []), (n + 6, 2, [1.0, 2.0]), (n + 10, 3, [1.5, -2.0]), (n + 7, 1, [1e300] * dim), (n + 8, 1, [float("inf")] * dim)]
    rows += [(5, 1, rows[5][2]), (n + 9, rows[50][1], rows[50][2]), (0, 0, rows[4][2]), (n + 12, 1, [0.0] * dim), (n + 50, 0, [90000.0, 80000.0] + [0.5] * (dim - 2))]
    return rows


def brute_negatives(rows, every, positives, negatives):
    most = lambda v: min(2**31 - 1, math.sqrt(2**62 / len(v)))
    good = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, c, v) for i, c, v in good if all(abs(x) < most(v) for x in v)]
    out = []
    for a, label, q in good:
        if a % every:
            continue
        score = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, c) for i, c, v in good if i != a and len(v) == len(q)]
        for s, p, _ in sorted(x for x in score if x[2] == label)[:positives]:
            fits = sorted(x for x in score if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "sample"), [(8192, 8192), (16, 8192), (64, 0)])
def test_hard_negatives(spark, monkeypatch, chunk, sample):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", sample)  # 0: no codewords, so everything is residual
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 3)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "vec_id bigint, label int, embedding array<double>, key int, id string, rank int").repartition(3)
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=4, negatives=3)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, 10, 4, 3)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_bounds_hold_the_score_and_leave_few_candidates():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((3000, 16)) / 4).astype(np.int32)
    book = hard_negatives.codebook(x[:1000])
    codes, rest = hard_negatives.encode(x, book)
    chunk = hard_negatives._Chunk({"dim": 16, "ids": np.arange(3000).tobytes(), "labels": np.zeros(3000, np.int64).tobytes(), "vecs": x.tobytes(), "codes": codes.tobytes(), "rest": rest.tobytes()})
    q = x[:20].astype(float)
    low, high = chunk.bounds(q, book)
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert np.mean(high - low) < 0.2 * np.mean(np.linalg.norm(q, axis=1)) * np.mean(np.linalg.norm(x, axis=1))


def test_a_task_holds_one_shard_at_a_time(spark):
    """Shards take megabytes; Parquet would put up to a hundred into one row group, which readers and writers hold at once."""
    import pyarrow.parquet as pq

    from tessera.llm.lexical_search import ImpactIndex

    docs = spark.range(1600).coalesce(1).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 999), x -> hex(xxhash64(id, x))), ' ') AS text")
    shards = ImpactIndex.build(docs).shards
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    sizes = [(m.row_group(i).num_rows, sum(m.row_group(i).column(c).total_compressed_size for c in range(m.num_columns))) for m in found for i in range(m.num_row_groups)]
    assert sum(n for n, _ in sizes) == shards.count() == 4
    assert len(sizes) > 1 and all(n == 1 or size < 16 << 20 for n, size in sizes)
