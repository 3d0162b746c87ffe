"""Quality rules as a short-circuit cascade (operator 8). DataFrame functions only.

A rule is a condition over statistics of the text; a statistic is an expression over the text, its words and its
lines, so a rule can be evaluated from the raw text alone. Each rule's cost and rejection rate are estimated on a sample;
the cascade asks the rules in the order of rejections per cost and stops at the first that rejects, and with it stop
the statistics that only later rules need. Those that the result shows are computed for all rows and are free to the
rules. A cost is what the rule reads, not a time: order, `rejected_by` and verdict are the same at every rerun.

Statistics are computed within the row: words and lines are arrays, repeated three-word windows are found through
sorted window hashes (xxhash64 over the three words), never by exploding.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import unused

#: Rows of the sample that orders the rules, about; it decides no verdict.
SAMPLE_ROWS = 4000


@dataclass(frozen=True)
class Rule:
    """rejects: a condition; {name} stands for a statistic."""

    name: str
    rejects: str


#: Base rules: a document that one of them rejects has base_failed.
BASE_RULES = (Rule("few_words", "{n_words} < 50"), Rule("repeats", "100 * {n_repeat_words} > 50 * {n_words}"))
RULES = BASE_RULES + (
    Rule("word_length", "{word_chars} < 2 * {n_words} or {word_chars} > 14 * {n_words}"),
    Rule("symbols", "2 * {n_symbols} > {n_words}"),
    Rule("dup_lines", "100 * {n_dup_lines} > 60 * {n_lines}"),
    Rule("letters", "2 * {n_letters} < {word_chars}"),
    Rule("capitals", "2 * {n_capitals} > {word_chars}"),
    Rule("bullets", "100 * {n_bullets} > 40 * {n_words}"),
)

_SPACE = r"[\\x20\\x09-\\x0D]"
_TRIMMED = "trim(both ' \\t\\n\\u000b\\f\\r' from {text})"

# let-bindings: transform(array(x), x -> ...)[0] evaluates x once, also where the optimizer inlines x into a filter
# twice: the window hashes that occur twice or more; at: positions of such windows in order; each covers up to three words.
_COVERED = "aggregate(zip_with({at}, slice({at}, 2, size({at})), (a, b) -> least(3, coalesce(b - a, 3))), 0, (s, x) -> s + x)"
_FEW = "filter(transform(g, (h, i) -> if(array_contains(twice, h), i, null)), i -> i is not null)"
# beyond some distinct repeats, sort (hash, position) pairs and keep those equal to a neighbour
_MANY = """transform(array(array_sort(transform(g, (h, i) -> struct(h, i)))), s ->
  array_sort(filter(zip_with(zip_with(s, slice(s, 2, size(s)), (a, b) -> struct(a.h as h, a.i as i, coalesce(a.h = b.h, false) as n)),
    concat(array(cast(null as struct<h:bigint,i:int>)), s), (a, b) -> if(a.n or coalesce(a.h = b.h, false), a.i, null)), i -> i is not null)))[0]"""
_REPEATS = f"""transform(array(@), g -> case when size(array_distinct(g)) = size(g) then 0 else
  transform(array(transform(array(sort_array(g)), s ->
      array_distinct(filter(zip_with(s, slice(s, 2, size(s)), (a, b) -> if(a = b, a, null)), h -> h is not null)))[0]), twice ->
    transform(array(if(size(twice) <= 64, {_FEW}, {_MANY})), found -> {_COVERED.format(at="found")})[0])[0] end)[0]"""

#: {text} is the text, null as empty; {words} and {lines} (with a word) are arrays of it.
STATISTICS = {
    "words": f"if({_TRIMMED} = '', cast(array() as array<string>), split({_TRIMMED}, '{_SPACE}+'))",
    "lines": f"filter(split({{text}}, '\\n'), x -> regexp_like(x, '{_SPACE.replace('[', '[^')}'))",
    "n_words": "cast(size({words}) as bigint)",
    "word_chars": "cast(length(array_join({words}, '')) as bigint)",
    "n_symbols": "cast(regexp_count({text}, '[#*$%&|<>]') as bigint)",
    "n_lines": "cast(size({lines}) as bigint)",
    "n_dup_lines": "transform(array({lines}), l -> cast(size(l) - size(array_distinct(l)) as bigint))[0]",
    "n_repeat_words": "cast(" + _REPEATS.replace("@", "transform(array({words}), w -> case when size(w) < 4 then array() else transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) end)[0]") + " as bigint)",
    "n_letters": r"length(regexp_replace({text}, '\\P{{L}}+', ''))",
    "n_capitals": r"length(regexp_replace({text}, '\\P{{Lu}}+', ''))",
    "n_bullets": f"regexp_count({{text}}, '(?<!{_SPACE.replace('[', '[^')})[-*•|](?!{_SPACE.replace('[', '[^')})')",
}
#: What the result shows of every row.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


class _Names(dict):
    """Columns by the name of a statistic; a statistic without one stands for its expression."""

    def __missing__(self, name: str) -> str:
        return STATISTICS[name].format_map(self)


def condition(rule: Rule, columns: dict[str, str]) -> str:
    """The rule as SQL. columns: column of each statistic that has one, `text` at least."""
    return rule.rejects.format_map(_Names({k: f"`{v}`" for k, v in columns.items()}))


def text_statistics(docs: DataFrame, shown: tuple[str, ...] = SHOWN, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the text (null: empty), its words and its lines under names that docs does not have, and the statistics
    `shown` under their own names, which replace columns of docs; and the columns by statistic."""
    rest = docs.drop(*shown)
    at = {x: unused(x, docs) for x in ("text", "words", "lines")} | {x: x for x in shown}
    t = rest.withColumn(at["text"], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    names = _Names({"text": f"`{at['text']}`"})
    t = t.withColumns({at[x]: F.expr(STATISTICS[x].format_map(names)) for x in ("words", "lines")})
    names |= {x: f"`{at[x]}`" for x in ("words", "lines")}
    return t.withColumns({x: F.expr(STATISTICS[x].format_map(names)) for x in shown}), at


_CALL = re.compile(r"\b[a-z_]\w*\(")


def work(rule: Rule, columns: dict[str, str]) -> str:
    """SQL for what a row's evaluation of the rule touches: one for its comparison, and the bytes of the text or elements of the
    words and lines that it reads, once for each function called on them. Statistics that have a column are free."""
    size = {"text": "octet_length({})", "words": "size({})", "lines": "size({})"}

    def touched(expression: str) -> list[str]:
        calls = len(_CALL.findall(expression))
        found = []
        for name in dict.fromkeys(x for _, x, _, _ in string.Formatter().parse(expression) if x):
            if name not in columns:
                found += touched(STATISTICS[name])
            elif name in size:
                found.append(f"{max(calls, 1)} * {size[name].format(f'`{columns[name]}`')}")
        return found

    return " + ".join(["1", *touched(rule.rejects)])


def rule_order(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, shown: tuple[str, ...] = SHOWN) -> list[Rule]:
    """The rules by rejections per unit of work (`work`), given that the statistics `shown` are computed anyway, from one
    aggregation over a sample of about `rows` rows of docs. Nothing is timed, so reruns over the same table agree. Rules within a
    hundredth of each other keep the given order; an empty table gives it whole."""
    total = docs.count()
    if not total:
        return [*rules]
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).sample(min(1.0, rows / total), seed=5)
    t, at = text_statistics(texts, shown)
    measures = [F.count_if(F.expr(condition(r, at))).alias(f"rejected{i}") for i, r in enumerate(rules)] + [F.sum(F.expr(work(r, at))).alias(f"work{i}") for i, r in enumerate(rules)]
    found = t.agg(*measures).first()
    value = {r.name: float(f"{found[f'rejected{i}'] / (found[f'work{i}'] or 1):.2e}") for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: -value[r.name])


def first_rejection(order: list[Rule], columns: dict[str, str]) -> Column:
    """The name of the first rule in order that rejects, or null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(order):
        out = F.when(F.coalesce(F.expr(condition(r, columns)), F.lit(False)), F.lit(r.name)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, shown: tuple[str, ...] = SHOWN) -> DataFrame:
    """docs with the statistics `shown`, base_failed, rejected_by (first rule of the cascade; null: none) and kept; columns
    of docs with these names are replaced, all others stay. With fewer statistics shown more of the cascade is skipped.

    Null and empty texts have no words and fail. Repeated rows are judged alike. A share exactly at a rule's bound passes.
    With ties between rules the given order holds. An empty table gives an empty one.
    """
    order = rule_order(docs, text_col, rules, shown=shown)
    t, at = text_statistics(docs.drop("base_failed", "rejected_by", "kept"), shown, text_col)
    base = F.lit(False)
    for r in BASE_RULES:
        base = base | F.expr(condition(r, at))
    t = t.withColumns({"base_failed": base, "rejected_by": first_rejection(order, at)})
    return t.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop(at["text"] if at["text"] != text_col else "", at["words"], at["lines"])
