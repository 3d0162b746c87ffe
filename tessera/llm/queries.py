"""The registered queries of the llm operators and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, html_extraction, licenses, mixing, quality_classifier, quality_rules, secrets, token_counts
from tessera.llm.embedding_dedup import embedding_dedup
from tessera.llm.hard_negatives import hard_negatives
from tessera.llm.lexical_search import ranked_search
from tessera.llm.ngram_jaccard import ngram_jaccard
from tessera.sources.shared import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries to one ledger: first one language, then all documents; the second scans only unseen blobs."""
    docs, ledger = _table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    secrets.scan_versions(docs.where("lang = 'en'"), ledger)
    found = secrets.secret_scan(docs, ledger)
    n = len(secrets.BASE_RULES)
    count = lambda i: F.size(F.filter("spans", lambda x: x["rule"] == i)).cast("bigint")
    base = F.filter("spans", lambda x: x["rule"] < n)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.span_digest(base), 256).alias("base_sha256"), secrets.span_digest(F.col("spans")).alias("spans"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, sf_dir, "documents"))
    phrase = F.array(*(F.lit(label) for _, label in licenses.PHRASES))
    template = F.array(*(F.lit(t.label) for t in licenses.TEMPLATES))
    base = F.transform("places", lambda x: F.get(phrase, x["phrase"]))
    more = F.transform("matches", lambda x: F.get(template, x["template"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.get("places", F.lit(0))["start"].alias("first_word"),
        F.when(F.size("places") > 0, F.element_at("places", -1)["start"]).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"), k=4, pct=85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = token_counts.TokenTotals(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    docs = _table(spark, sf_dir, "documents")
    counters = {"words-1": token_counts.word_counter, "byte_bpe_multi_50k": token_counts.rank_counter(*bpe.default_vocabulary())}
    totals.commit("documents", docs, counters)
    # one language is delivered again: its counts are taken out and put in once more, the totals stay
    totals.commit("revision", docs.where("lang = 'en'"), counters)
    return totals.totals()


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality_score", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end").alias("label"), "embedding")
    return hard_negatives(rows, anchors=F.col("vec_id") % 50 == 0, positives=5, negatives=3, low_pct=50, high_pct=95, scale=256.0)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), phrase=10, slop=5)
    size = lambda c: F.size(c).cast("bigint")
    return found.select("doc_id", "n_words", "n_hit", size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), size("near").alias("n_near"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


_OPERATORS = (op1_secret_scan, op2_license_scan, op3_bpe, op4_embedding_dedup, op5_ngram_jaccard, op6_token_counts, op7_quality_classifier, op8_quality_rules, op9_mix_sources, op10_html_extraction,
              op11_hard_negatives, op12_decontamination, op13_lexical_search)
QUERIES = {f.__name__: f for f in _OPERATORS}

# Components are found by propagating the smallest id along links, one row a (document, smallest seen so far).
_OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id
"""

_OP8 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM d WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
f AS (SELECT doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 2 * n_symbols > n_words OR 100 * n_dup_lines > 60 * n_lines
    OR 2 * len(regexp_extract_all(text, '\p{L}')) < word_chars OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > word_chars
    OR 100 * len(list_filter(w, lambda x: x IN ('-', '*', '•', '|'))) > 40 * n_words) AS kept
FROM b
"""


_OP11 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS pos, p.s AS ps, s.b AS neg, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, pos AS positive_id, r::INTEGER AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3
"""

# Every window of every document is compared, without an index; near: runs of 15 words from any of a cut's words on, in documents that hold all of them.
_OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, i, least(10, len(w)) AS n, w[i:i + 9] AS g, (i - 1) % 10 = 0 OR i = greatest(len(w) - 9, 1) AS cut FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
q AS (SELECT DISTINCT item, n, array_to_string(g, ' ') AS g FROM i),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q))),
h AS (SELECT doc_id, item, i, n FROM s JOIN q USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id),
k AS (SELECT *, row_number() OVER () AS k FROM (SELECT DISTINCT item, list_distinct(g) AS words FROM i WHERE cut)),
p AS (SELECT doc_id, k, n, word, i FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) JOIN (SELECT k, len(words) AS n, unnest(words) AS word FROM k) USING (word)),
f AS (SELECT doc_id, k FROM p GROUP BY doc_id, k, n HAVING count(DISTINCT word) = n),
o AS MATERIALIZED (SELECT p.* FROM p JOIN f USING (doc_id, k)),
y AS (SELECT DISTINCT doc_id, k FROM (SELECT x.doc_id, x.k FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i BETWEEN x.i AND x.i + 14 GROUP BY x.doc_id, x.k, x.i, x.n HAVING count(DISTINCT y.word) = x.n)),
m AS (SELECT doc_id, count(DISTINCT item) AS near FROM y JOIN k USING (k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated, coalesce(near, 0) AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_OP13 = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
p AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d), m AS (SELECT doc_id, 50 + (50 * n * nd) // l AS m FROM d, c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
f AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, nd),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s QUALIFY rank <= 50
"""


def _op1() -> str:
    """Positions as in the operator: lengths between matches and of matches, summed."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [
        f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, regexp_extract_all(text, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS v, string_split_regex(text, {quoted(r.pattern)}) AS g, {r.least} AS least FROM d"
        for i, r in enumerate(secrets.RULES)]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), x AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x WHERE len(m) > 0),
s AS (SELECT doc_id, k, kind, list_sum(list_transform(g[:i], lambda y: length(y))) + list_sum(list_transform(m[:i], lambda y: length(y))) AS e, length(m[i]) AS n FROM i WHERE length(v[i]) >= least),
t AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
  string_agg(kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - n, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (doc_id)
"""


def _op2() -> str:
    """Every block against every template, without filters."""
    rows = ", ".join(f"('{t.label}', {[*licenses._tokens(t.text)]})" for t in licenses.TEMPLATES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM p WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in licenses.PHRASES)
    return f"""
WITH t(label, tokens) AS (VALUES {rows}), d AS (SELECT doc_id, lower(coalesce(text, '')) AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS w FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT doc_id, count(*) AS n, min(place) AS low, max(place) AS high, list(DISTINCT label) AS labels FROM ({places}) GROUP BY doc_id),
l AS (SELECT doc_id, i, regexp_extract_all(lines[i], '{word}') AS words FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM w))),
g AS (SELECT doc_id, i, words, count(*) FILTER (WHERE len(words) = 0) OVER (PARTITION BY doc_id ORDER BY i) AS par FROM l),
b AS (SELECT doc_id, words FROM l WHERE len(words) > 0 UNION ALL SELECT doc_id, flatten(list(words)) FROM g WHERE len(words) > 0 GROUP BY doc_id, par),
m AS (SELECT doc_id, label, len(list_intersect(list_distinct(words), tokens)) / len(tokens) AS c, len(list_intersect(list_distinct(words), tokens)) * 10 >= len(tokens) * 8 AS ok FROM b, t),
s AS (SELECT doc_id, list(DISTINCT label) AS more, max(c) AS c FROM m WHERE ok GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN f USING (doc_id) LEFT JOIN s USING (doc_id)
"""


ORACLES: dict[str, str] = {"op1_secret_scan": _op1(), "op2_license_scan": _op2(), "op5_ngram_jaccard": _OP5, "op8_quality_rules": _OP8, "op11_hard_negatives": _OP11, "op12_decontamination": _OP12, "op13_lexical_search": _OP13}
