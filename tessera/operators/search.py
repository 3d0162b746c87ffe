"""Ranked search: BM25 over postings, rank fusion, importance, hierarchy and vector signals, blending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import lifecycle as L
from tessera.operators import postings as P
from tessera.operators.postings import TOKEN
from tessera.sources.shared import small_batches

def query_terms(query: str) -> list[str]:
    import re

    return sorted({x.lower() for x in re.findall(TOKEN, query)})


class Index:
    """Postings of text fields, written once to a folder that all executors share: (key, field, term, tf, len), as lists in
    parts by term, so that a query reads no text and only the parts of its terms."""

    def __init__(self, spark: SparkSession, folder: str, key_type: str):
        self.spark, self.folder, self.key_type = spark, folder, key_type

    @staticmethod
    def write(docs: DataFrame, key: str, fields: tuple[str, ...], folder: str) -> Index:
        """Null fields are empty. Tokens are runs of ASCII letters, digits and underscores, lower-cased."""
        key_type = docs.schema[key].dataType.simpleString()
        lists = P.by_bucket(P.posting_lists(docs.select(F.col(key).alias("key"), *fields), key_type, fields, positions=False))
        with small_batches(docs.sparkSession):
            lists.write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/postings")
        found = Index(docs.sparkSession, folder, key_type)
        # a document once a field; a field without a token is a row without a term
        stats = found.postings().groupBy("field", "key").agg(F.max("len").alias("len")).groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
        stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
        return found

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        found = self.spark.read.schema(P.lists_type(self.key_type, False)).parquet(f"{self.folder}/postings")
        found = P.unpacked(found if terms is None else P.of_terms(found, terms), positions=False)
        return found.select("key", "field", "len", "term", F.col("tf").cast("bigint").alias("tf"), "bucket")

    def stats(self) -> DataFrame:
        """A row a field: the number of documents and their mean length."""
        return self.spark.read.schema("field string, n bigint, mean double").parquet(f"{self.folder}/stats")


def bm25(index: Index, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents that hold a term of the query, summed over fields and terms."""
    terms = query_terms(query)
    if not terms:
        return index.postings([""]).select("key", F.lit(0.0).alias("score"))
    hits = index.postings(terms)
    # a row for each field and term of the query, at most
    about = hits.groupBy("field", "term").agg(F.count("*").alias("df")).join(index.stats(), "field")
    t = hits.select("key", "field", "term", "tf", "len").join(F.broadcast(about), ["field", "term"])
    score = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return t.groupBy("key").agg(F.sum(score).alias("score"))


def top(df: DataFrame, limit: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """Row numbers of an already limited candidate list."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse_rrf(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Candidate lists with a rank column, fused: the sum of 1 / (k + rank) by key."""
    rows = lists[0].select(key, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.count("*").alias("lists"))


def minmax(column: str):
    """Min-max normalisation over a limited result; constant values give 0."""
    w = Window.partitionBy(F.lit(1))
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0)


def blend(items: DataFrame, limit: int, weights: tuple[tuple[str, float], ...] = (("rrf", 0.55), ("importance", 0.30), ("vector", 0.15), ("hierarchy", 0.15))) -> DataFrame:
    """items with rrf, importance, vector, hierarchy and prior_rank; ties keep the prior order."""
    score = sum((minmax(name) * w for name, w in weights), F.lit(0.0))
    return items.withColumn("final", F.round(score, 9)).orderBy(F.desc("final"), "prior_rank").limit(limit)


def fan_in(edges: DataFrame) -> DataFrame:
    """Distinct calling files of every symbol."""
    caller = F.concat_ws("::", "repo_root", F.coalesce("caller_relative_path", "relative_path"))
    return edges.groupBy("to_symbol").agg(F.countDistinct(caller).alias("fan_in"))


def importance(symbols: DataFrame, calls_in: DataFrame) -> DataFrame:
    """symbols with importance: the score of the kind and 24 a calling file. calls_in: to_symbol, fan_in."""
    t = symbols.join(calls_in.select(F.col("to_symbol").alias("symbol_key"), "fan_in"), "symbol_key", "left")
    return t.withColumn("importance", C.kind_score(F.col("kind")) + 24 * F.coalesce("fan_in", F.lit(0)))


#: Fixed value: importance lies within this on both sides.
MOST_IMPORTANCE = 200.0


def log_norm(column: str, most: float = MOST_IMPORTANCE):
    """Signed logarithm, within +-most (0: unbounded): one extreme value cannot drown the rest."""
    x = F.log1p(F.abs(column)) * F.signum(column)
    return F.greatest(F.lit(-most), F.least(F.lit(most), x)) if most > 0 else x


def with_vectors(items: DataFrame, query: str, window: int = 20) -> DataFrame:
    """items (label, prior_rank) with vector: of the first `window` the cosine of hashed words with the query's, which must
    have two terms at least; 0 for others. The order stays."""
    if len(query_terms(query)) < 2:
        return items.withColumn("vector", F.lit(0.0))
    near = F.coalesce(C.cosine(L.embed(F.col("label")), L.embed(F.lit(query))), F.lit(0.0))
    return items.withColumn("vector", F.when(F.col("prior_rank") <= window, F.round(near, 6)).otherwise(0.0))


def search_ranked(index: Index, files: DataFrame, symbols: DataFrame, edges: DataFrame, query: str, candidates: int = 50, limit: int = 20) -> DataFrame:
    """The flagship: files by BM25 over text and path, and symbols whose name holds a term, most called first, fused by
    rank; importance of kind and callers, or of the path; hierarchy of symbols; vectors of the first items; blended."""
    files = files.select(F.col("doc_id").cast("string").alias("id"), "repo_root", "relative_path", "is_deleted")
    scored = bm25(index, query).select(F.col("key").cast("string").alias("id"), F.round("score", 6).alias("score"))
    text = top(scored.join(files.where(~F.col("is_deleted")), "id"), candidates, F.desc("score"), "id")
    text = ranked(text, "rank", F.desc("score"), "id").select("rank", F.concat(F.lit("file:"), "id").alias("item"), F.concat_ws("/", "repo_root", "relative_path").alias("label"), C.path_score(F.col("relative_path"), query).alias("base"), F.lit(0.0).alias("hierarchy"))
    named = symbols.where(F.exists(F.array(*(F.lit(x) for x in query_terms(query)) or [F.lit("")]), lambda x: F.contains(F.lower("name"), x)))
    found = top(importance(named, fan_in(edges.join(named.select(F.col("symbol_key").alias("to_symbol")), "to_symbol", "left_semi"))), candidates, F.desc("importance"), "symbol_key")
    about = C.hierarchy_score(F.col("depth"), F.col("parent_key"), F.col("container_name"), query)
    found = ranked(found, "rank", F.desc("importance"), "symbol_key").select("rank", F.concat(F.lit("symbol:"), "symbol_key").alias("item"), F.col("name").alias("label"), F.col("importance").alias("base"), about.alias("hierarchy"))
    both = text.unionByName(found)
    items = fuse_rrf([text, found], "item").withColumn("rrf", F.round("rrf", 9)).join(both.drop("rank"), "item").withColumn("importance", log_norm("base"))
    items = with_vectors(ranked(items, "prior_rank", F.desc("rrf"), "item"), query)
    return blend(items, limit).select("item", "label", F.round("rrf", 6).alias("rrf"), F.round("final", 6).alias("final"))
