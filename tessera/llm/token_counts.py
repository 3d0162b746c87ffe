"""Delta-maintained token totals by source, language and tokenizer version (operator 6).

A batch of changes (upserts and deletes of documents) becomes signed rows: what a changed document counted before
with a minus, what it counts now with a plus. Totals are sums over the signed rows of committed batches, so
inserts, deletes and revised counts are all additions. A batch is committed by a marker written after its rows;
a batch that is committed is never applied again, and one that was cut off before its marker is written anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYS = ("source", "lang", "version")
_TABLES = {"rows": "doc_id {}, source string, lang string, version string, docs bigint, tokens bigint, batch string", "sums": "source string, lang string, version string, docs bigint, tokens bigint, batch string", "commits": "id string, batch string, id_type string"}
_WORD_SPACE = r"[\x20\x09-\x0D]+"


def word_counter(docs: DataFrame) -> DataFrame:
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), _WORD_SPACE), lambda x: x != ""))
    return docs.withColumn("n_tokens", n.cast("bigint")).drop("text")


def rank_counter(path: str, pattern: str) -> Callable[[DataFrame], DataFrame]:
    """Counts the tokens of a rank file with the tiktoken library; its strings for special tokens are ordinary text."""

    def count(docs: DataFrame) -> DataFrame:
        from tessera.llm.bpe import read_ranks

        ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # a vocabulary: fixed, about 50,000 tokens
        others = [c for c in docs.columns if c != "text"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import tiktoken

            coding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
            for batch in batches:
                n = [len(coding.encode_ordinary(x)) if x else 0 for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n, pa.int64())], [*others, "n_tokens"])

        kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
        return docs.mapInArrow(run, f"{kinds}, n_tokens bigint")

    return count


class TokenTotals:
    """The rollup kept under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, what: str, id_type: str = "string") -> DataFrame | None:
        """A table with its stated types: a batch's folder is named by a digest of its id, so ids are any strings and none is read as a number."""
        try:
            return self.spark.read.schema(_TABLES[what].format(id_type)).parquet(f"{self.folder}/{what}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _committed(self, what: str, id_type: str = "string") -> DataFrame | None:
        done, rows = self._read("commits"), self._read(what, id_type)
        return rows.join(done.select("batch"), "batch", "left_semi") if done is not None and rows is not None else None

    def commit(self, batch: str, changes: DataFrame, counters: dict[str, Callable[[DataFrame], DataFrame]]) -> bool:
        """changes: doc_id, source, lang, text, and optionally deleted (boolean) and sequence. False if the batch was committed before; its
        id may be any string.

        Null texts count 0 tokens; null sources and languages are groups of their own. Rows of one batch with the same
        doc_id are one document: the one with the greatest sequence, or that sorts last, a delete after all others; rows without doc_id are one document too. A delete of an
        unknown document changes nothing. Other columns are not read.
        """
        part, id_type = "h" + hashlib.sha256(batch.encode()).hexdigest(), changes.schema["doc_id"].dataType.simpleString()
        done = self._read("commits")
        if done is not None and done.where(F.col("id") == batch).limit(1).count():
            return False
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in changes.columns else F.lit(False)
        sequence = F.col("sequence") if "sequence" in changes.columns else F.lit(0)
        given = changes.select("doc_id", sequence.alias("sequence"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), deleted.alias("deleted"), F.col("text").cast("string").alias("text"))
        counted = [count(given).withColumn("version", F.lit(version)) for version, count in counters.items()]
        rows = counted[0]
        for x in counted[1:]:
            rows = rows.unionByName(x)
        last = rows.groupBy("doc_id", "version").agg(F.max(F.struct("sequence", "deleted", "source", "lang", "n_tokens")).alias("x")).select("doc_id", "version", "x.*")
        plus = last.where("not deleted").select("doc_id", *_KEYS, F.lit(1).cast("bigint").alias("docs"), F.col("n_tokens").alias("tokens"))
        before = self._committed("rows", id_type)
        if before is not None:
            # only the rows of documents that this batch touches are summed
            touched = last.select(F.col("doc_id").alias("id"), F.col("version").alias("v"))
            before = before.join(touched, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("v")), "left_semi")
            minus = before.groupBy("doc_id", *_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
            plus = plus.unionByName(minus.withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}))
        path = f"{self.folder}/rows/batch={part}"
        plus.write.mode("overwrite").parquet(path)
        sums = self.spark.read.schema(plus.schema).parquet(path).groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/batch={part}")
        self.spark.createDataFrame([(batch, part, id_type)], _TABLES["commits"]).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens over all committed batches; groups without documents are left out."""
        sums = self._committed("sums")
        if sums is None:
            return self.spark.createDataFrame([], "source string, lang string, version string, n_docs bigint, n_tokens bigint")
        return sums.groupBy(*_KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0")
