"""BPE, vectors, classifier, HTML and the pipeline: exact round trips, brute force and held-out accuracy."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, html_extraction, quality_classifier
from tessera.llm.embedding_dedup import embedding_dedup
from tests.llm.test_text_joins import brute_components, frame

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts():
    rng = random.Random(1)
    out = [None, "", " ", " a", "a ", "  a b", "a\n b c", "a \nb", "foo　bar baz", "a" * 3000, "=" * 500, "qwrtz" * 60, "don't we'll é ñ 中文字 1234 ٣٤", "<|endoftext|> x", "\x00\x1c a\x85b"]
    for _ in range(100):
        out.append("".join(chr(rng.choice([rng.randrange(0, 300), rng.randrange(0, 0x3000), rng.randrange(0x20, 0x7F), 0x20])) for _ in range(rng.randrange(60))))
    return out


def test_bpe_equals_the_library_and_decodes(spark):
    given = texts()
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    docs = frame(spark, [(i, x, "s") for i, x in enumerate(given)])
    encoded = bpe.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: coding.encode_ordinary(x or "") for i, x in enumerate(given)}
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(encoded).collect()} == {i: (x or "").encode() for i, x in enumerate(given)}
    for r in bpe.round_trip(docs, keep=("source",)).collect():
        x = given[r["doc_id"]] or ""
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, coding.encode_ordinary(x))).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()
    assert bpe.round_trip(frame(spark, [])).count() == 0


def test_bpe_takes_words_and_texts_of_any_length():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    ranks = bpe.read_ranks(PATH)
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, bpe.merge_table(ranks), public_tokenizers.PATTERN)
    words = ["the", "quick", "house", "inter", "national", "ing", "é"]
    hard = ["".join(rng.choices(letters, k=20_000)), "".join(rng.choices(letters, k=200_000)), "".join(rng.choices(words, k=20_000)), "ab" * 8000, "=-" * 8000, "a" * 9000, "中文字符" * 9000, "x\n" * 50_000]
    for x in hard:
        got = codec.encode([x, "a b", ""])
        assert [y.tolist() for y in got] == [coding.encode_ordinary(y) for y in (x, "a b", "")]
        assert codec.decode(got) == [x.encode(), b"a b", b""]
    many = " ".join(rng.choices(letters, k=12_000_000))
    ids = codec.encode([many])[0]
    assert len(ids) == 12_000_000 and hashlib.sha256(codec.decode([ids])[0]).digest() == hashlib.sha256(many.encode()).digest()
    assert ids[:3_000].tolist() == coding.encode_ordinary(many[: 2 * 3_000 - 1])
    assert codec.digest(ids[:700_000]) == hashlib.sha256(",".join(map(str, ids[:700_000].tolist())).encode()).hexdigest()


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3])).tolist()) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(5)] + [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16), (405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0]), (407, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("kept", F.lit(5)).withColumn("t", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup(df, recall=0.999999).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if i < 400 or i > 405]
    links, up = dict.fromkeys(got, 0), {i: i for i in got}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in got}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert embedding_dedup(df.limit(0)).count() == 0


def test_recall_of_near_vectors_as_registered(spark):
    """Pairs exactly at and just above the threshold, and one bucket of many near copies, at the registered recall."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((3000, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    other = 0.901 * base + np.sqrt(1 - 0.901**2) * side
    near = base[0] + 0.02 * rng.standard_normal((700, 32))
    x = np.concatenate([base, other, near])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = embedding_dedup(df, cosine=0.9).toPandas().set_index("vec_id").sort_index()
    y = x / np.linalg.norm(x, axis=1)[:, None]
    cosines = y @ y.T
    want = (cosines >= 0.9).sum(1) - 1
    found = got["n_links"].to_numpy()
    assert (found <= want).all()
    assert found[1:6000].sum() > 0.96 * want[1:6000].sum() and found[6000:].sum() > 0.999 * want[6000:].sum()
    ties = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup(ties, cosine=0.6, recall=0.999999).collect()} == {1: 1, 2: 2, 3: 1}


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")["quality"]
    got = quality_classifier.classify(docs).select("doc_id", "kept").toPandas().set_index("doc_id")["kept"]
    got = got[labels.index]
    assert got[labels == 1].mean() > 0.98 and got[labels == 0].mean() < 0.15


def test_classifier_takes_odd_rows(spark):
    got = quality_classifier.classify(frame(spark, [(1, None, ""), (2, "", ""), (3, " ", ""), (4, "a plain line of words", ""), (4, "a plain line of words", "")]))
    assert [r["kept"] for r in got.orderBy("doc_id").collect()] == [False, False, False, True, True]
    assert quality_classifier.classify(frame(spark, [])).count() == 0


def test_classifier_does_not_depend_on_copies(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(("the", "of", "garden", "house", "stands", "near", "river", "is", "old", "and", "quiet")) for _ in range(40)) + f" item {i}" for i in range(4)]
    junk = [" ".join(rng.choice(("$$$", "###", "BUY", "NOW", "!!!", "***")) for _ in range(40)) + f" {i}" for i in range(4)]
    few = frame(spark, [(i, x, "") for i, x in enumerate(good + junk)]).select("doc_id", "text")
    many = few.crossJoin(spark.range(25000).select(F.lit(1).alias("copy")))
    for docs in (few, many):
        model = quality_classifier.train(docs)
        assert model.weights.any()
        kept = {r["doc_id"] for r in model.score(few).where("quality_score >= 0.5").collect()}
        assert kept == {0, 1, 2, 3}
    assert quality_classifier.train(few, sample_rows=1).weights.any()


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    accuracy = np.array([0.9, 0.8, 0.7, 0.95, 0.6, 0.85, 0.75])
    votes = np.where(rng.random((20000, 7)) < accuracy, truth[:, None], ~truth[:, None]).astype(np.int64)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, chance, prior = quality_classifier.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.03 and np.abs(chance[1, :, 1] - accuracy).max() < 0.05


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<div class="ad">buy this</div><article><h1>A &amp; B</h1><p><b>First bold</b>er text.<br>  second   line<p>Third&nbsp;one.</p></article><footer>&copy; all</footer>"""


def test_html(spark):
    assert [b[0] for b in html_extraction.blocks(PAGE)] == ["menu", "buy this", "A & B", "First bolder text.", "second line", "Third one.", "© all"]
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<article>" + "<p>long text here.</p>" * 3000, "x"), (5, "u", "<<<a <p", "x")], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages).collect()}
    assert got[1] == "A & B First bolder text. second line Third one." and got[2] == got[3] == ""
    assert len(got[4].split()) == 9000
    assert html_extraction.extract(pages.limit(0)).count() == 0


HAND = [
    ("<body><header><a href=/>Site</a></header><main><h1>A title</h1><p>The first paragraph of it.</p><aside class='related'><h3>Related</h3><ul><li><a href=/x>Other thing</a></li></ul></aside><p>The second paragraph, which is longer than the first one.</p></main><footer>Copyright 2020</footer></body>", "A title The first paragraph of it. The second paragraph, which is longer than the first one."),
    ("<div class='cookie-banner'><p>We use cookies to improve your experience.</p><button>Accept</button></div><article><h2>News</h2><p>Something happened today in the town.</p><blockquote>It was loud, they said.</blockquote></article><section class='comments'><h3>Comments</h3><div class='comment'><p>I was there too.</p></div></section>", "News Something happened today in the town. It was loud, they said."),
    ("<div id='sidebar'><ul><li><a href=/a>Archive</a></li></ul></div><div class='post-content'><p>Only one paragraph is here.</p></div><form class='newsletter'><label>Subscribe</label><input></form>", "Only one paragraph is here."),
    ("<nav><a href=/>Home</a> <a href=/b>Blog</a></nav><article><p>Before the advert there is text.</p><div class='ad'>Buy now</div><p>After the advert there is more.</p></article>", "Before the advert there is text. After the advert there is more."),
    ("<article><h1>Lists &amp; tables</h1><ul><li>one item</li><li>two items</li></ul><p>An end.</p></article><div class='share'>Share this on</div><footer><p>&copy; All rights reserved</p></footer>", "Lists & tables one item two items An end."),
]


def test_hand_labelled_pages(spark):
    pages = spark.createDataFrame([(i, "u", x) for i, (x, _) in enumerate(HAND)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages).collect()}
    assert sum(got[i] == want for i, (_, want) in enumerate(HAND)) >= 4, got


def test_pages_of_any_length_and_depth():
    model = html_extraction.trained()
    long = "<article>" + "<p>some long text here.</p>" * 40_000 + "</article>"
    deep = "".join(f"<div class='c{i}'>word{i} text" for i in range(20_000))
    found = html_extraction.main_blocks(model, [html_extraction.blocks(x) for x in (long, deep, PAGE)])
    assert len(found[0]) == 40_000 and found[2][0] == "A & B"
    page = html_extraction.blocks("<nav><a>x</a></nav><article>" + "<p>some text.</p>" * 50 + "</article><footer>y</footer>")
    x, mask, _ = html_extraction.padded([html_extraction.vectors(page)])
    assert np.allclose(model.label(x, mask)[:, 0], model.label_long(page, together=7), atol=1e-5)


def test_the_labeller_is_stored_once(spark):
    first, second = html_extraction.stored(spark, 20, 1), html_extraction.stored(spark, 20, 1)
    assert all((second.w[k] == v.astype(np.float32)).all() for k, v in first.w.items())


def test_labeller_on_held_out_layouts():
    rng, wrong, n = np.random.default_rng(77), 0, 0
    model = html_extraction.trained()
    for _ in range(100):
        page = html_extraction.training_page(rng)
        if page:
            x, mask, _ = html_extraction.padded([html_extraction.vectors([b[:3] for b in page])])
            wrong += ((model.label(x, mask)[:, 0] >= 0.5) != np.array([b[3] for b in page])).sum()
            n += len(page)
    assert wrong < 0.03 * n


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = html_extraction.Labeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = rng.random((4, 2, html_extraction.WIDTH)), rng.integers(0, 2, (4, 2)).astype(float)
    mask = np.ones((4, 2), bool)
    mask[3, 1] = False

    def loss():
        p = np.clip(model.label(x, mask), 1e-9, 1 - 1e-9)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for k, at in (("fx", (3, 5)), ("bh", (2, 7)), ("o", (4, 0)), ("bc", (9,))):
        before = model.w[k][at]
        model.w[k][at] = before + 3e-3
        up = loss()
        model.w[k][at] = before - 3e-3
        down = loss()
        model.w[k][at] = before
        assert g[k][at] == pytest.approx((up - down) / 6e-3, rel=0.05, abs=2e-5)


def test_pipeline_keeps_its_promises(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = pipeline.keep_quality(spark, docs, "")
    one = pipeline.keep_one_of_each(spark, kept, "").cache()
    rows = [(r["doc_id"], r["text"], "") for r in kept.collect()]
    assert {r["doc_id"] for r in one.collect()} == {i for i, _, c in brute_components(rows, 5, 80) if c is None or c == i}
    assert one.columns == docs.columns
    clean = pipeline.redact_secrets(spark, one, "")
    assert clean.columns == docs.columns and clean.count() == one.count()
    mixed = pipeline.mix(spark, clean, "")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in one.collect()}
    assert pipeline.encode(spark, mixed, "").count() == mixed.count()
