"""Which files are collected: size, ignore files with folder scope, hidden parts, extensions and excluded globs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """(regular expression over the path below the ignore file's folder, whether it takes back) of a line; None of a comment or an empty line.

    * and ? stay within a part of the path, ** crosses parts; a slash before the end ties the pattern to the folder, otherwise it holds at any
    depth; a slash at the end means folders only; whatever matches covers all below it."""
    text = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not text or text[0] == "#":
        return None
    back = text[0] == "!"
    text = text[1:] if back else text
    folder, text = text.endswith("/"), text.rstrip("/") if text.strip("/") else ""
    if not text:
        return None
    parts = text.lstrip("/").split("/")
    out = "" if text[0] == "/" or len(parts) > 1 else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _part(part) + ("" if last else "/")
    return f"^{out}{'/.+' if folder else '(?:/.*)?'}$", back


def _part(part: str) -> str:
    out, i = "", 0
    while i < len(part):
        c, end = part[i], part.find("]", i + 2)
        if c == "*":
            out += "" if out.endswith("[^/]*") else "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and end > 0:
            inner = part[i + 1 : end]
            out += "[" + ("^" if inner[0] in "!^" else "") + re.sub(r"([\\\[\]&])", r"\\\1", inner.lstrip("!^") if inner[0] in "!^" else inner) + "]"
            i = end
        else:
            i += c == "\\" and i + 1 < len(part)
            out += re.sub(r"([^\w])", r"\\\1", part[i])
        i += 1
    return out


def ignore_rules(ignores: DataFrame) -> DataFrame:
    """(repo_root, folder, at, rule, back) of ignore files (repo_root, folder: "" for the root, text), a row a line that says something."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(root, folder, at, *rule) for root, folder, text in zip(batch["repo_root"], batch["folder"], batch["text"], strict=True) for at, line in enumerate((text or "").split("\n")) if (rule := ignore_rule(line))]
            yield pd.DataFrame(rows, columns=["repo_root", "folder", "at", "rule", "back"])

    return ignores.select("repo_root", "folder", "text").mapInPandas(run, "repo_root string, folder string, at int, rule string, back boolean")


def ignored(files: DataFrame, ignores: DataFrame) -> DataFrame:
    """(repo_root, relative_path) of the files that their folders' ignore files leave out, each once: rules are inherited from every folder above (an equal
    join of a file's folders with those that have rules); the last line of the deepest folder that matches decides."""
    parts = F.split("relative_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = files.select("repo_root", "relative_path").distinct().select("repo_root", "relative_path", F.explode(above).alias("folder"))
    below = F.when(F.col("folder") == "", F.col("relative_path")).otherwise(F.expr("substring(relative_path, length(folder) + 2)"))
    hits = rows.join(ignore_rules(ignores), ["repo_root", "folder"]).where(F.regexp_like(below, F.col("rule")))
    return hits.groupBy("repo_root", "relative_path").agg(F.max_by("back", F.struct(F.length("folder"), "at")).alias("back")).where("not back").select("repo_root", "relative_path")


def collectible(files: DataFrame, ignores: DataFrame, extensions: tuple[str, ...], exclude: tuple[str, ...] = (), most_bytes: int = 512 * 1024) -> DataFrame:
    """files (repo_root, relative_path, size_bytes) with `reason`, null of those to collect: the first of size, ignored, hidden, extension and excluded
    that holds. exclude: patterns over the whole path, like the lines of an ignore file; they become one expression. A null size counts as 0."""
    suffix = F.lower(F.regexp_extract("relative_path", r"[^/](\.[^./]*)$", 1))
    back = F.lit(False)
    for rule in filter(None, map(ignore_rule, exclude)):
        back = F.when(F.regexp_like("relative_path", F.lit(rule[0])), F.lit(not rule[1])).otherwise(back)
    left_out = ignored(files, ignores).withColumn("ignored", F.lit(True))
    t = files.join(left_out, ["repo_root", "relative_path"], "left")
    reason = (F.when(F.coalesce("size_bytes", F.lit(0)) > most_bytes, "size").when(F.coalesce("ignored", F.lit(False)), "ignored").when(F.regexp_like(F.concat_ws("/", "repo_root", "relative_path"), F.lit(r"(^|/)\.")), "hidden")
              .when(~suffix.isin(*extensions), "extension").when(back, "excluded"))
    return t.withColumn("reason", reason).drop("ignored")
