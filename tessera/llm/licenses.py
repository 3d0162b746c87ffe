"""License scan: exact set-similarity join of text blocks with templates (operator 2).

Blocks are a text's lines and its paragraphs (runs of lines without a blank one); each meets every template that it
contains at least `threshold` of the distinct tokens of, so a notice is found on one line or wrapped over several.
Tokens are put in one global order, by the number of documents that hold them, rarest first. A block and a template
can only overlap enough if they share a token of the template's prefix at positions that leave room for the rest
(prefix and positional filter) and the block has enough tokens of templates at all (length filter); candidates are
verified by the exact overlap. Templates are parameters, so their index is bounded; blocks never meet blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import small
from tessera.sources.shared import materialize

#: ASCII letters and digits and every character beyond ASCII, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words must stand consecutively, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """One paragraph or line; the texts of a license are several."""

    label: str
    text: str


#: Short notices, and the paragraphs of the texts and headers of common licenses.
TEMPLATES = (
    Template("mit", "Released under the MIT License"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    Template("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text) -> F.Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _lowered(text):
    # the Kelvin sign would become an ASCII k; another letter beyond ASCII keeps the word what it was
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))


def _tokens(text: str) -> list[str]:
    import re

    return sorted(set(re.findall(WORD, text.lower())))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, places (sorted array of start word and phrase number), matches
    (array of block kind, block number, template number, containment; sorted).

    Null and empty texts have no words; a block is matched however long it is. Repeated rows are matched each. A
    containment of exactly the threshold is a match. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sets = [_tokens(t.text) for t in templates]
    need = [max(1, -(-int(round(threshold * 1000)) * len(s) // 1000)) for s in sets]
    vocabulary = sorted({x for s in sets for x in s})
    known = F.array(*(F.lit(x) for x in vocabulary)) if vocabulary else F.array().cast("array<string>")
    least = min(need, default=1 << 30)
    t = docs.select(F.col(id_col).alias("doc_id"), _lowered(F.col(text_col)).alias("low"))
    t = t.select("doc_id", F.transform(F.split("low", "\n"), words).alias("lines"))
    t = t.select("doc_id", "lines", F.flatten("lines").alias("words"))
    # a paragraph's number is that of its first line
    breaks = F.expr("filter(transform(lines, (x, i) -> if(size(x) = 0, i, null)), i -> i is not null)")
    t = t.withColumn("hits", F.array_intersect("words", known))
    t = t.withColumn("breaks", F.when(F.size("hits") >= least, breaks))
    bounds = "concat(array(-1), breaks, array(size(lines)))"
    paragraphs = f"transform(filter(zip_with({bounds}, slice({bounds}, 2, size(breaks) + 1), (a, b) -> struct(a + 1 as a, b - a - 1 as n)), p -> p.n > 0), p -> struct('paragraph' as kind, p.a as no, flatten(slice(lines, p.a + 1, p.n)) as words))"
    lines = "transform(lines, (x, i) -> struct('line' as kind, i as no, x as words))"
    none = "cast(array() as array<struct<kind:string,no:int,words:array<string>>>)"
    t = t.withColumn("blocks", F.expr(f"concat(case when breaks is not null then {lines} else {none} end, case when breaks is not null then {paragraphs} else {none} end)"))
    slim = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["no"].alias("no"), F.array_intersect(b["words"], known).alias("tokens")))
    t = t.withColumn("blocks", F.filter(slim, lambda b: F.size(b["tokens"]) >= least))
    places = []
    for number, (phrase, _) in enumerate(phrases):
        parts = phrase.split()
        same = " and ".join(f"get(words, i + {k}) = '{p}'" for k, p in enumerate(parts))
        places.append(f"case when array_contains(words, '{parts[0]}') and array_contains(words, '{parts[-1]}') then filter(transform(words, (w, i) -> if(w = '{parts[0]}' and {same}, struct(cast(i as bigint) as start, {number} as phrase), null)), x -> x is not null) else cast(array() as array<struct<start:bigint,phrase:int>>) end")
    t = t.withColumn("places", F.expr(f"array_sort(concat({', '.join(places)}))") if places else F.array().cast("array<struct<start:bigint,phrase:int>>"))
    t = materialize(t.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("bigint").alias("n_words"), "places", "hits", "blocks"), "blocks")
    # the global order, over all documents: a count for each token of the templates
    counts = {r["tok"]: r["df"] for r in t.select(F.explode("hits").alias("tok")).groupBy("tok").agg(F.count("*").alias("df")).collect()}
    order = {x: i for i, x in enumerate(sorted(vocabulary, key=lambda x: (counts.get(x, 0), x)))}
    index = []
    for i, (s, n) in enumerate(zip(sets, need, strict=True)):
        ranked = sorted(s, key=order.__getitem__)
        index += [(order[x], i, at, len(s), n, sorted(order[y] for y in s)) for at, x in enumerate(ranked[: len(s) - n + 1])]
    index_bytes = sum(32 + 4 * len(x[5]) for x in index)
    index = spark.createDataFrame(index, "rank int, template int, at int, size int, need int, whole array<int>")
    ranks = F.create_map(*(v for x, i in order.items() for v in (F.lit(x), F.lit(i)))) if order else F.create_map().cast("map<string,int>")
    b = t.select("row", F.explode("blocks").alias("b")).select("row", "b.kind", "b.no", F.array_sort(F.transform("b.tokens", lambda x: F.try_element_at(ranks, x))).alias("tokens"))
    b = b.select("*", F.posexplode("tokens").alias("place", "rank"))
    room = F.least(F.size("tokens") - F.col("place"), F.col("size") - F.col("at")) >= F.col("need")
    pairs = b.join(small(index, index_bytes), "rank").where(room).withColumn("common", F.size(F.array_intersect("tokens", "whole")))
    met = pairs.where("common >= need").select("row", F.struct("kind", F.col("no").cast("bigint").alias("no"), "template", (F.col("common") / F.col("size")).alias("containment")).alias("m")).distinct()
    met = met.groupBy("row").agg(F.sort_array(F.collect_list("m")).alias("matches"))
    empty = F.array().cast("array<struct<kind:string,no:bigint,template:int,containment:double>>")
    return t.select("row", "doc_id", "n_words", "places").join(met, "row", "left").select("doc_id", "n_words", "places", F.coalesce("matches", empty).alias("matches"))
