"""Found symbols against known ones: one-to-one matches within line gaps of a language, per-file proxies, mergeable summaries."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import outline as O

#: By language and bucket the line gap up to which equal names of equal bucket still match.
GAPS = {
    "java": {"class": 12, "interface": 12, "enum": 12, "module": 12, "method": 12, "field": 512},
    "javascript": {"class": 12, "method": 12, "function": 12, "field": 12},
    "kotlin": {"class": 8, "method": 8, "function": 8, "interface": 8, "enum": 8, "field": 8},
    "python": {"class": 6, "method": 6, "function": 6, "field": 6},
    "scala": {"module": 8, "class": 8, "interface": 8, "enum": 8, "method": 8, "field": 8},
}
#: The gap of a language that counts as a loose place, where it is not that of the bucket.
LOOSE = {"java": 12}
#: Names that a compiler made.
SYNTHETIC = r"^[A-Za-z_][A-Za-z0-9_]*Builder(?:Impl)?$"
#: Patterns that a summary shows of a language.
TOP = 10

_ROW = "matched boolean, same_kind boolean, gap int"


def normalised(symbols: DataFrame, by: list[str], language: str = "lang") -> DataFrame:
    """(by, language, name, bucket, kind, line, end_line): names and kinds as they are compared. Symbols without a name are dropped, a missing
    or negative line is 0, an end before the line is the line; of a Java file's fields of one name the first stays."""
    kind = F.lower(F.trim("kind"))
    line = F.greatest(F.coalesce("line", F.lit(0)), F.lit(0)).cast("int")
    t = symbols.select(*by, language, O.symbol_name(F.col(language), F.col("name")).alias("name"), kind.alias("kind"), line.alias("line"), F.coalesce("end_line", F.lit(0)).cast("int").alias("end_line"))
    t = t.where("name <> ''").withColumns({"bucket": O.kind_bucket(F.col(language), F.coalesce("kind", F.lit("other"))), "end_line": F.greatest("line", "end_line")})
    field = (F.col(language) == "java") & (F.col("bucket") == "field")
    once = t.where(field).groupBy(*by, language, "name", "bucket").agg(F.min(F.struct("line", "end_line", "kind")).alias("x"))
    return t.where(~F.coalesce(field, F.lit(False))).unionByName(once.select(*by, language, "name", "bucket", "x.*"))


def _gap(language: Column, bucket: Column, tables: dict) -> Column:
    out = F.lit(0)
    for lang, table in tables.items():
        out = F.when(language == lang, C.lookup(table, bucket, 0)).otherwise(out)
    return out


def tolerance_match(found: DataFrame, known: DataFrame, by: list[str], tolerance: int = 2, language: str = "lang") -> DataFrame:
    """Rows of both sides (normalised(), side: found or known) with matched, same_kind and gap.

    Found symbols in order of (line, kind, bucket) each take a free known symbol of the same name: of the same bucket within the tolerance; else of
    the same bucket within the language's gap; else of any bucket within the tolerance; the nearest each time, then the first by
    (line, end_line, kind, bucket). A line within a known symbol is at gap 0.

    Names never meet, nor do lines further apart than the largest gap: such runs, cut by a running maximum of ends, are swept each in order of line, with no
    more in memory than what lies within that gap of one another."""
    reach = F.greatest(F.lit(tolerance), _gap(F.col(language), F.lit("field"), GAPS), *(_gap(F.col(language), F.lit(b), GAPS) for b in ("class", "method", "function", "module")))
    side = lambda df, s: df.select(*by, language, "name", "bucket", "kind", "line", F.col("end_line") if s == "known" else F.col("line").alias("end_line"), F.lit(s).alias("side"))
    rows = side(found, "found").unionByName(side(known, "known")).withColumns({"reach": reach, "most": F.greatest(F.lit(tolerance), _gap(F.col(language), F.col("bucket"), GAPS))})
    key = [*by, language, "name"]
    order = Window.partitionBy(*key).orderBy("line", "end_line", "side", "kind")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("far", F.coalesce((F.col("line") - before > F.col("reach")).cast("int"), F.lit(0))).withColumn("run", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.drop("far").repartition(*key, "run").sortWithinPartitions(*key, "run", "line", "end_line", "kind", "bucket", "side")
    names = rows.columns
    at = {c: names.index(c) for c in ("line", "end_line", "side", "bucket", "reach", "most")}
    run_key = [names.index(c) for c in (*key, "run")]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, free, out = None, deque(), [], []
        schema = None

        def settle(line: int | None) -> None:
            """Found symbols that nothing from this line on can reach take theirs; known ones that no later found symbol can reach go."""
            while waiting and (line is None or waiting[0][at["line"]] + waiting[0][at["reach"]] < line):
                one = waiting.popleft()
                mine, bucket, most = one[at["line"]], one[at["bucket"]], one[at["most"]]
                best = None
                for i, k in enumerate(free):
                    a, b = k[at["line"]], k[at["end_line"]]
                    gap = 0 if a <= mine <= b else min(abs(mine - a), abs(mine - b))
                    same = k[at["bucket"]] == bucket
                    rank = 0 if same and gap <= tolerance else 1 if same and gap <= most else 2 if gap <= tolerance else None
                    if rank is not None and (best is None or (rank, gap) < best[:2]):
                        best = rank, gap, i
                if best:
                    taken = free.pop(best[2])
                    same = taken[at["bucket"]] == bucket
                    out.extend(((*one, True, same, best[1]), (*taken, True, same, best[1])))
                else:
                    out.append((*one, False, False, None))
            oldest = waiting[0][at["line"]] if waiting else line
            gone = [k for k in free if oldest is None or k[at["end_line"]] + k[at["reach"]] < oldest]
            if gone:
                out.extend((*k, False, False, None) for k in gone)
                free[:] = [k for k in free if not (oldest is None or k[at["end_line"]] + k[at["reach"]] < oldest)]

        def table() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([*batch.schema, ("matched", pa.bool_()), ("same_kind", pa.bool_()), ("gap", pa.int32())])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (own := tuple(row[i] for i in run_key)):
                    settle(None)
                    now = own
                settle(row[at["line"]])
                (waiting if row[at["side"]] == "found" else free).append(row)
            yield table()
        settle(None)
        if schema:
            yield table()

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(sweep, f"{types}, {_ROW}").drop("run", "reach", "most")


def file_quality(matches: DataFrame, by: list[str], tolerance: int = 2, language: str = "lang") -> DataFrame:
    """By file: found, known, matched, the proxies recall, precision, kind_rate, place_rate and loose_rate (1 of nothing), flags, and the
    missing patterns with their counts. Known symbols that a compiler made do not count unless they are matched."""
    lang, unmatched = F.col(language), ~F.col("matched")
    made = ((lang == "java") & F.regexp_like("name", F.lit(SYNTHETIC))) | ((lang == "kotlin") & ((F.col("kind") == "9") | ((F.col("name") == "get") & (F.col("bucket") == "method"))))
    ours, theirs = F.col("side") == "found", F.col("side") == "known"
    loose = F.greatest(F.lit(tolerance), F.least(_gap(lang, F.col("bucket"), GAPS), F.coalesce(C.lookup(LOOSE, lang, None), F.lit(1 << 30))))
    ignored = F.coalesce(theirs & unmatched & made, F.lit(False))
    pattern = F.when(theirs & unmatched & ~ignored, O.missing_pattern(lang, F.col("kind"), F.col("bucket"), F.col("name")))
    hit = ours & F.col("matched")
    each = matches.groupBy(*by, language, pattern.alias("pattern")).agg(F.count_if(ours).alias("found"), F.count_if(theirs).alias("all_known"), F.count_if(theirs & ~ignored).alias("known"), F.count_if(hit).alias("matched"),
        F.count_if(hit & F.col("same_kind")).alias("kinds"), F.count_if(hit & (F.col("gap") <= tolerance)).alias("places"), F.count_if(hit & (F.col("gap") <= loose)).alias("loose"))
    sums = ("found", "all_known", "known", "matched", "kinds", "places", "loose")
    t = each.groupBy(*by, language).agg(*(F.sum(c).alias(c) for c in sums), F.array_sort(F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct("pattern", F.col("known").alias("n"))))).alias("missing"))  # at most as many as there are patterns
    rate = lambda part, of: F.coalesce(F.try_divide(F.col(part), F.col(of)), F.lit(1.0))
    some = F.col("matched") > 0
    flags = (("ast_missing_symbols", F.col("known") > F.col("found")), ("ast_extra_symbols", F.col("found") > F.col("all_known")), ("kind_mismatch_present", some & (F.col("kinds") < F.col("matched"))),
             ("position_mismatch_present", some & (F.col("places") < F.col("matched"))), ("no_proxy_matches", (F.col("known") > 0) & ~some))
    return t.select(*by, language, "found", "known", "matched", rate("matched", "known").alias("recall"), rate("matched", "found").alias("precision"), rate("kinds", "matched").alias("kind_rate"), rate("places", "matched").alias("place_rate"),
                    rate("loose", "matched").alias("loose_rate"), F.array_compact(F.array(*(F.when(c, name) for name, c in flags))).alias("flags"), "missing")


_RATES = ("recall", "precision", "kind_rate", "place_rate", "loose_rate")


def shadow_counts(files: DataFrame, language: str = "lang") -> DataFrame:
    """What adds up over any parts of the files: (language, what, name, n, total) of file counts, sums of rates, flags and missing
    patterns. Two such tables together, added up by merge_shadow(), are the table of both."""
    # rates count in billionths, so that sums do not depend on their order
    whole = lambda c: F.round(F.col(c) * 1_000_000_000).cast("bigint")
    row = lambda what, name, n: F.struct(F.lit(what).alias("what"), F.lit(name).cast("string").alias("name") if isinstance(name, str) else name.alias("name"), n.cast("bigint").alias("n"))
    rows = F.concat(F.array(row("files", "", F.lit(1)), *(row("rate", c, whole(c)) for c in _RATES)), F.transform("flags", lambda x: row("flag", x, F.lit(1))), F.transform("missing", lambda x: row("missing", x["pattern"], x["n"])))
    return merge_shadow(files.select(language, F.explode(rows).alias("x")).select(language, "x.*"), language)


def merge_shadow(counts: DataFrame, language: str = "lang") -> DataFrame:
    return counts.groupBy(language, "what", "name").agg(F.sum("n").alias("n"))


def shadow_summary(counts: DataFrame, language: str = "lang", top: int = TOP) -> DataFrame:
    """By language: files, mean rates, flags and the most frequent missing patterns (by count, then name), from merged counts."""
    ranked = counts.where("what = 'missing'").withColumn("at", F.row_number().over(Window.partitionBy(language).orderBy(F.desc("n"), "name"))).where(F.col("at") <= top)
    best = ranked.groupBy(language).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "n"))), lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))).alias("top_missing"))
    flags = counts.where("what = 'flag'").groupBy(language).agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", F.col("n").cast("string")))).alias("flags"))
    sums = counts.where("what in ('files', 'rate')").groupBy(language).agg(F.sum(F.when(F.col("what") == "files", F.col("n"))).alias("files"), *(F.sum(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in _RATES))
    means = (F.round(F.col(c) / F.col("files") / 1_000_000_000, 6).alias(c) for c in _RATES)
    none = F.array().cast("array<string>")
    return sums.select(language, "files", *means).join(flags, language, "left").join(best, language, "left").withColumns({c: F.coalesce(c, none) for c in ("flags", "top_missing")})


def recall_regression(summary: DataFrame) -> DataFrame:
    """One row: regression_pct, by how much the mean recall falls short of all, languages weighted by their files (at least 1 each); recalls above 1 are
    percentages. Null without a language."""
    ratio = F.when(F.col("recall") > 1, F.col("recall") / 100).otherwise(F.col("recall"))
    ratio, weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)), F.greatest(F.lit(1.0), F.coalesce(F.col("files").cast("double"), F.lit(1.0)))
    short = (1 - F.try_divide(F.sum(ratio * weight), F.sum(weight))) * 100
    return summary.where("recall is not null").agg(F.when(short.isNotNull(), F.greatest(F.lit(0.0), short)).alias("regression_pct"))


def stage_exit(values: DataFrame) -> DataFrame:
    """values with a_to_b and b_to_c: whether a stage may be left. parse_pct, degraded_pct, admission_pct, admission_base, regression_pct, pending_p95, pending_base,
    pending; null means not measured, which fails, but for the bases (then fixed bounds hold) and where nothing is pending."""
    c, holds = F.col, lambda x: F.coalesce(x, F.lit(False))
    a = holds(c("parse_pct") >= 95) & holds(c("degraded_pct") <= 10) & holds(c("admission_pct") <= F.coalesce(c("admission_base") * 1.3, F.lit(30.0)))
    age = holds(c("pending_p95") <= F.coalesce(c("pending_base") * 1.2, F.lit(10.0))) | holds(c("pending") == 0)
    return values.withColumns({"a_to_b": a, "b_to_c": holds(c("regression_pct") <= 1) & age & holds(c("admission_pct") <= 5)})
