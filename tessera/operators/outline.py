"""Symbols out of source text by patterns, all in the JVM; kind buckets, names and missing-pattern rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C

#: The declarations of each language, as (kind, pattern); the first group is the name.
PATTERNS = {
    "python": (
        ("class", r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*(\(|:)"),
        ("function", r"^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ),
    "typescript": (
        ("class", r"^\s*(?:export\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ),
    "javascript": (
        ("class", r"^\s*(?:export\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)\b"),
        ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\("),
    ),
    "java": (
        ("class", r"^\s*(?:public\s+)?(?:abstract\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("method", r"^\s*(?!return\b|new\b|if\b|for\b|while\b|switch\b|catch\b|throw\b)(?:public|protected|private)?\s*(?:static\s+)?[A-Za-z_$][A-Za-z0-9_$.<>\[\], ?]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ),
    "scala": (
        ("module", r"^\s*package\s+([A-Za-z_][A-Za-z0-9_\.]*)\b"),
        ("class", r"^\s*(?:sealed\s+|final\s+|case\s+|abstract\s+)*(?:class|trait|object|enum)\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
        ("method", r"^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:\[|\()"),
        ("field", r"^\s*(?:lazy\s+)?(?:val|var)\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
    ),
}
#: Words that open a line which is no method, though it looks like one.
KEYWORD_LINE = r"^[^\S\n]*(?:return|new|if|for|while|switch|catch|throw)\b"
#: A whole line that opens a Java method, and words that are no method's name.
JAVA_METHOD_LINE = (r"^\s*(?:public|protected|private)?\s*(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?(?:native\s+)?(?:abstract\s+)?(?:<[^>]+>\s*)?(?:[A-Za-z_$\u0080-￿][\w$<>\[\],?.]*?)\s+"
                    r"([A-Za-z_$\u0080-￿][\w$\u0080-￿]*)\s*\([^)\n;]*\)\s*(?:throws\s+[A-Za-z0-9_.$,\s]+)?\s*\{\s*\}?\s*$")
JAVA_KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "new", "throw")
#: Extensions that another analyser handles, and the bytes from which a text is put off.
FAST_PATH = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
LARGE_BYTES = 262_144

#: The bucket of a kind. What a language says itself comes first, then what holds for all.
LANGUAGE_BUCKETS = {
    "java": {"constructor": "method", "constructor_declaration": "method", "record": "class", "enum_constant": "field", "variable": "field", "property": "field"},
    "javascript": {"class_declaration": "class", "function_declaration": "function", "method_definition": "method", "lexical_declaration": "field", "variable_declaration": "field", "property_definition": "field"},
    "kotlin": {"variable": "field", "13": "field", "19": "class", "23": "class"},
    "python": {"variable": "field", "13": "field"},
    "scala": {"trait": "interface", "object": "class", "function": "method", "variable": "field", "13": "field"},
    "typescript": {"method_definition": "method", "function_declaration": "function", "lexical_declaration": "variable", "property_definition": "field"},
}
BUCKETS = {
    "2": "module", "4": "module", "5": "class", "6": "method", "7": "field", "8": "field", "9": "method", "10": "enum", "11": "interface", "12": "function", "13": "variable", "14": "field", "22": "field",
    "class": "class", "method": "method", "function": "function", "field": "field", "constant": "field", "enum_member": "field", "variable": "variable", "interface": "interface", "enum": "enum", "module": "module",
}
#: How a known symbol that was not found is named, as (language, raw kinds, buckets, parts of the name, result); the first rule
#: that holds counts, an empty condition always holds.
MISSING_RULES = (
    ("java", ("9", "constructor", "constructor_declaration"), (), (), "missing_constructor"),
    ("java", (), ("field",), (), "missing_field"),
    ("java", (), ("class", "interface", "enum"), (".", "$"), "missing_nested_type"),
    ("scala", (), ("field",), (), "missing_field"),
    ("scala", (), ("method", "function"), (), "missing_method"),
    ("scala", (), ("class", "interface", "enum"), (), "missing_type"),
)


def outline(sources: DataFrame, by: list[str], language: str = "lang", text: str = "text") -> DataFrame:
    """(by, name, kind, line, end_line, symbol_key) of the declarations in source texts of the languages of PATTERNS.

    A declaration's line is that where its match begins, empty lines before it included; equal (name, kind, line) of a file
    count once; `by` names a file. The line is a running sum over the file's matches of the newlines between and within them, so no position is kept
    and no text leaves its task: what is shuffled are names and counts. Null texts and other languages have no symbols.
    """
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def found(n: int, lang: str, kind: str, pattern: str) -> Column:
        rule = F.lit("(?md)" + pattern)
        whole, names, gaps = F.regexp_extract_all(text, rule, F.lit(0)), F.regexp_extract_all(text, rule, F.lit(1)), F.split(F.col(text), "(?md)" + pattern, -1)
        each = F.transform(F.arrays_zip(whole.alias("m"), names.alias("name"), F.slice(gaps, 1, F.size(whole)).alias("g")), lambda x: F.struct(
            x["name"].alias("name"), newlines(x["g"]).alias("before"), newlines(x["m"]).alias("inside"), (F.regexp_like(x["m"], F.lit("(?d)" + KEYWORD_LINE)) if kind == "method" else F.lit(False)).alias("keyword")))
        return F.when(F.col(language) == lang, F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), each.alias("found")))

    rules = F.array_compact(F.array(*(found(n, lang, kind, pattern) for lang, some in PATTERNS.items() for n, (kind, pattern) in enumerate(some))))
    rows = sources.where(F.col(language).isin(*PATTERNS) & F.col(text).isNotNull()).select(*by, F.explode(rules).alias("r")).select(*by, "r.n", "r.kind", F.posexplode("r.found").alias("at", "x"))
    order = Window.partitionBy(*by, "n").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line", (F.sum(F.col("x.before") + F.col("x.inside")).over(order) - F.col("x.inside") + 1).cast("int"))
    return _symbols(rows.where("not x.keyword").select(*by, "x.name", "kind", "line"))


def _symbols(rows: DataFrame) -> DataFrame:
    return rows.distinct().withColumn("end_line", F.col("line")).withColumn("symbol_key", F.concat_ws(":", "name", F.col("line").cast("string")))


def unicode_methods(sources: DataFrame, by: list[str], language: str = "lang", text: str = "text") -> DataFrame:
    """Java methods whose names have letters beyond ASCII, which outline() does not see: line by line, columns as there."""
    lines = sources.where(F.col(language) == "java").select(*by, F.posexplode(F.split(F.col(text), "\r\n|\r|\n", -1)).alias("at", "x"))
    named = lines.where(F.regexp_like("x", F.lit(r"[^\x00-\x7F]"))).withColumn("name", F.regexp_extract("x", "(?Ud)" + JAVA_METHOD_LINE, 1))
    named = named.where(F.regexp_like("name", F.lit(r"[^\x00-\x7F]")) & ~F.col("name").isin(*JAVA_KEYWORDS))
    return _symbols(named.select(*by, "name", F.lit("method").alias("kind"), (F.col("at") + 1).alias("line")))


def decision(path: Column, text: Column, language: Column, symbols: Column) -> Column:
    """What becomes of a file before deeper analysis, as (decision, source, reason), from its number of outline symbols."""
    known = language.isin(*PATTERNS)
    pick = lambda d, s, r: F.struct(F.lit(d).alias("decision"), F.lit(s).alias("source"), F.lit(r).alias("reason"))
    fast = F.regexp_like(F.lower(path), F.lit("(" + "|".join(x.replace(".", r"\.") for x in FAST_PATH) + ")$"))
    return (F.when(fast, pick("needs_l5", "none", "l3_preprocess_tsls_fast_path")).when(F.octet_length(text) > LARGE_BYTES, pick("deferred_heavy", "none", "l3_preprocess_large_file"))
            .when(~known, pick("needs_l5", "none", "l3_preprocess_unsupported_language")).when(symbols == 0, pick("needs_l5", "regex_outline", "l3_preprocess_no_symbols")).otherwise(pick("needs_l5", "regex_outline", "l3_preprocess_supported_language")))


def kind_bucket(language: Column, kind: Column) -> Column:
    """The bucket of a raw kind (lower-case name or number) in a language; "other" if unknown."""
    own = F.lit(None).cast("string")
    for lang, table in LANGUAGE_BUCKETS.items():
        own = F.when(language == lang, C.lookup(table, kind, None)).otherwise(own)
    return F.coalesce(own, C.lookup(BUCKETS, kind, "other"))


def symbol_name(language: Column, name: Column) -> Column:
    """A known symbol's name as the outline has it; empty if it is no declaration."""
    bare = F.trim(name)
    js = F.regexp_replace(bare, r"^(['\"`])(.*)\1$", "$2")
    js = F.trim(F.regexp_replace(F.trim(js), r"^\[(.*)\]$", "$1"))
    callback = F.regexp_extract(js, r"^(?:.+\.)?([A-Za-z_$][A-Za-z0-9_$]*)\(\)\s+callback$", 1)
    js = F.when(js == "<function>", "").when(callback != "", callback).otherwise(js)
    java = F.when(F.endswith(bare, F.lit(")")), F.trim(F.regexp_extract(bare, r"^([^(]*)\(", 1))).otherwise(bare)
    java = F.trim(F.regexp_replace(java, "^([^<]+)<.*$", "$1"))
    java = F.when(F.startswith(bare, F.lit("new ")) | F.regexp_like(bare, F.lit(r"\$(value|set)")), "").otherwise(java)
    return F.when(language == "javascript", js).when(language == "java", java).otherwise(bare)


def missing_pattern(language: Column, kind: Column, bucket: Column, name: Column) -> Column:
    """How a known symbol that was not found is reported, by the first rule that holds."""
    found = F.lit(None).cast("string")
    for lang, kinds, buckets, parts, result in reversed(MISSING_RULES):
        holds = language == lang
        holds = holds & kind.isin(*kinds) if kinds else holds
        holds = holds & bucket.isin(*buckets) if buckets else holds
        for some in (parts,) if parts else ():
            holds = holds & F.exists(F.array(*map(F.lit, some)), lambda x: F.contains(name, x))
        found = F.when(holds, F.lit(result)).otherwise(found)
    return F.coalesce(found, F.concat(F.lit("missing_"), bucket))
