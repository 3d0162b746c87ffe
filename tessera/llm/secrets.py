"""Secret scan with an incremental blob ledger (operator 1). DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds the findings of each
(blob, rule version) pair that was ever scanned, clean ones included; a scan reads only texts whose pair is not in
it, one copy of each, and the findings are joined back to all paths that hold the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir, unused


@dataclass(frozen=True)
class Rule:
    """All leftmost non-overlapping matches of `pattern` whose group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The order breaks ties between spans that start together.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more; shorter runs would be dropped and free no other match
)
_BREAK = r"""(?:[\x20\t\r\n>|,"']+-?|(?:\\[nr])+[\x20\t]*)"""  # between lines of a key: white space, quoting and diff marks, escaped line ends
_CODE = "[A-Za-z0-9+/=]"
#: A private key up to its END line, with no other line of five dashes between. Without an END: its header fields, then
#: all runs of 16 or more base64 characters, each after a break, then one shorter line (with its line end, unless = ends it). Groups repeat a bounded number of times,
#: as Java matches them by recursion; 400 lines hold more than any key (sixteen is spelled out: RE2 bounds nested repetitions).
_PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+){0,100}-{5,9}END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\r\n\\]*){{0,4}}(?:{_BREAK}{_CODE * 16}{_CODE}*){{1,400}}(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}(?:={{1,2}}|[\r\n\"']|\\[nr]|\z))?)?"
)
EXTRA_RULES = (
    Rule("pem", _PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})"),
)
RULES = BASE_RULES + EXTRA_RULES
RULE_VERSION = "2"

_FINDING = "array<struct<start:bigint,rule:int,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _pieces(text: Column, number: int, rule: Rule) -> Column:
    """For one rule: (rule, place, length before the match since the last one, its length, passes) of every match."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("bigint"))
    found = F.transform(
        F.arrays_zip(F.transform(matches, lambda x: F.length(x).cast("bigint")).alias("m"), F.transform(tested, F.length).alias("t"), F.slice(gaps, 1, F.size(matches)).alias("g")),
        lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("at"), x["m"].alias("match"), (x["t"] >= rule.least).alias("passes"), x["g"].alias("gap")))
    none = F.array().cast("array<struct<rule:int,at:int,match:bigint,passes:boolean,gap:bigint>>")
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id and spans (sorted array of start, rule, end in code points, end exclusive) of every blob; blobs:
    distinct blob_id and text. Starts are running sums over a blob's matches, so the work is linear in the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = blobs.select("blob_id", F.explode_outer(F.concat(*(_pieces(text, i, r) for i, r in enumerate(rules)))).alias("x")).select("blob_id", "x.*")
    running = "(partition by blob_id, rule order by at rows between unbounded preceding and current row)"
    ended = found.withColumn("end", F.expr(f"sum(gap + match) over {running}"))
    spans = F.sort_array(F.collect_list(F.when(F.col("passes"), F.struct((F.col("end") - F.col("match")).alias("start"), "rule", "end"))))
    return ended.groupBy("blob_id").agg(spans.cast(_FINDING).alias("spans"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def scan_versions(versions: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Brings the ledger up to date with all versions, then returns (blob_id, spans) from it for the rule version.

    A null text is the empty blob. Equal texts, however many, are scanned once; pairs of the ledger never again.
    A repeated or interrupted call leaves at worst equal findings twice, which count once.
    """
    spark = versions.sparkSession
    old = read_ledger(spark, ledger)
    texts = versions.select(blob_id(F.col(text_col)).alias("blob_id"), F.col(text_col).cast("string").alias("text"))
    if old is not None:
        # copies are combined before the shuffle; distinct blobs meet the ledger where the shuffle has put them
        texts = texts.groupBy("blob_id").agg(F.first("text").alias("text")).join(old.where(F.col("rule_version") == rule_version).select("blob_id"), "blob_id", "left_anti")
    # most blobs hold nothing; their text goes no further than this filter
    possible = F.regexp_like(F.coalesce("text", F.lit("")), F.lit("|".join(f"(?:{r.pattern})" for r in rules)))
    unseen = texts.select("blob_id", F.when(possible, F.col("text")).alias("text"))
    fresh = unseen.groupBy("blob_id").agg(F.first("text").alias("text")) if old is None else unseen
    scan_blobs(fresh, rules).withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(ledger)
    now = spark.read.parquet(ledger).where(F.col("rule_version") == rule_version).select("blob_id", "spans")
    return now if old is None else now.dropDuplicates(["blob_id"])


def secret_scan(docs: DataFrame, ledger: str | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, spans_col: str = "spans") -> DataFrame:
    """All rows and columns of docs, and `spans`: the sorted (start, rule number, end) of every secret in the text.

    Empty and null texts have none; repeated rows have the same. Without a ledger a new one is begun in the shared folder.
    A column of docs with the name of `spans_col` is replaced; all others stay. An empty table gives an empty one.
    """
    ledger = ledger or f"{shared_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    rest = docs.drop(spans_col)
    key, text = unused("blob_id", rest), F.col(f"`{text_col}`")
    found = scan_versions(docs.select(text.alias("text")), ledger, "text", rules, rule_version).where("size(spans) > 0")
    joined = rest.withColumn(key, blob_id(text)).join(found.select(F.col("blob_id").alias(key), F.col("spans").alias(spans_col)), key, "left").drop(key)
    return joined.withColumn(spans_col, F.coalesce(F.col(spans_col), F.array().cast(_FINDING)))


def span_digest(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, spans_col: str = "spans", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """Replaces the spans of secret_scan() by a mask; overlapping spans become one. A null text stays null, one without
    spans stays as it is; the spans' column goes, the others stay."""
    spans, text = F.col(spans_col), F.col(text_col)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def cut(state, x):
        more = F.when(x["start"] >= state["at"], F.concat(F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["out"], more).alias("out"))

    clean = F.aggregate(spans, start, cut, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(spans_col)
