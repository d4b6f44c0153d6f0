"""License scans, native: normalised texts against licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .quality_rules import COMMON_WORDS, vocabulary

# Notices by which texts name their licence, the grants of short licences, and the texts of those that are
# short enough to stand in a file. Names and years are not part of them.
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TERMS = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        MIT_GRANT,
        f"{MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD": [BSD_GRANT, f"{BSD_GRANT} {BSD_TERMS} {BSD_AS_IS}", f"{BSD_GRANT} {BSD_TERMS} {BSD_NAMES} {BSD_AS_IS}"],
    "ISC": [ISC_GRANT, f"{ISC_GRANT} {ISC_AS_IS}"],
    "0BSD": [f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {ISC_AS_IS}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
}
MOST_TEMPLATE_BYTES = 1 << 20
OTHERS = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> tuple[DataFrame, list[int]]:
    """(bigram, template, license, template_size) and all sizes; the templates are a parameter of bounded size."""
    if sum(len(t) for x in templates.values() for t in x) > MOST_TEMPLATE_BYTES:
        raise ValueError("templates are too large to broadcast")
    rows, sizes = [], []
    for name, texts in templates.items():
        for k, text in enumerate(texts):
            grams = bigrams_of(text)
            if not grams:
                raise ValueError(f"{name}: a template needs two words")
            sizes.append(len(grams))
            rows += [{"bigram": g, "template": f"{name}/{k}", "license": name, "template_size": len(grams)} for g in sorted(grams)]
    kind = "array<struct<bigram string, template string, license string, template_size int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind))), sizes


def needed_words(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which any text that reaches the threshold with some template has one at least.

    Such a text has t/(2-t) or more of the template's bigrams, so one at least of any larger part of them than the rest:
    words are taken, the longest first and frequent ones last, until they are in so many bigrams."""
    found, frequent = set(), set(vocabulary(COMMON_WORDS))
    for text in (t for x in templates.values() for t in x):
        grams = bigrams_of(text)
        left, covered = len(grams) - threshold / (2 - threshold) * len(grams) + 1e-9, set()
        for word in sorted(set(words_of(text)), key=lambda w: (w in frequent, -len(w), w)):
            if len(covered) > left:
                break
            found.add(word)
            covered |= {g for g in grams if word in g.split(" ")}
    return sorted(found)


def with_bigrams(units: DataFrame) -> DataFrame:
    """unit replaced by grams, its word bigrams (lower case, letters and digits alone), and size, the number of distinct ones.

    The words are a column of their own, so that they are made once for each unit. Distinct ones are counted by 64-bit
    hashes, in a hash set; arrays of strings would be compared pair by pair. Units below two words go."""
    others = [c for c in units.columns if c != "unit"]
    words = units.select(*others, F.split(F.btrim(F.regexp_replace(F.lower("unit"), OTHERS, " ")), " ").alias("words")).where(F.size("words") > 1)
    pairs = F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.select(*others, pairs.alias("grams")).withColumn("size", F.size(F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g)))))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8, windows: bool = True) -> DataFrame:
    """(id, license, n_lines, overlap, sizes) for every row of df and licence that one of its units resembles.

    Units are the whole text (line 0) and each of its lines (from 1). Dice of bigram sets A and B is 2|A n B| / (|A|+|B|);
    it can reach the threshold t only if |A| is between t/(2-t) and (2-t)/t times |B|, so units outside all templates'
    bounds end there and others meet only the templates within theirs; texts without any of needed_words go before. n_lines: lines at or above the threshold; overlap
    and sizes (of both sets added) are those of the best unit and template, so that its Dice is 2 * overlap / sizes.
    windows: the windows of license_windows are units too, of no line, so that a notice within a longer line and a grant
    over several lines have their row.
    Rows with null or empty texts, or without a match, have no row. Repeated rows give one, as do rows that share an id;
    rows with a null id are one. Other columns are ignored; an empty table gives an empty result."""
    table, sizes = template_table(df.sparkSession, templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(sizes) * low - 1e-9, max(sizes) * high + 1e-9
    wanted = "|".join(needed_words(templates, threshold))  # of letters and digits alone
    # written, as the optimiser would put the costlier conditions on words before this one
    df = written(df.select(id_col, text_col).where(F.lower(text_col).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{wanted})(?![\p{{L}}\p{{N}}])")), "licensed")
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line", "unit"))
    units = lines.withColumn("line", F.col("line") + 1).unionByName(df.select(F.col(id_col).alias("id"), F.lit(0).alias("line"), F.col(text_col).alias("unit")))
    units = units.where(F.length("unit") >= 2 * int(least) + 1)  # n bigrams are n + 1 words at least, so 2n + 1 characters
    units = with_bigrams(units)
    units = units.where((F.col("size") >= least) & (F.col("size") <= most))
    grams = units.select("id", "line", "size", F.explode("grams").alias("bigram"))
    met = grams.join(F.broadcast(table), "bigram").where((F.col("size") >= F.col("template_size") * low - 1e-9) & (F.col("size") <= F.col("template_size") * high + 1e-9))
    scored = met.groupBy("id", "line", "template", "license", "size", "template_size").agg(F.count_distinct("bigram").alias("overlap"))
    sums = F.col("size") + F.col("template_size")
    scored = scored.where(2 * F.col("overlap") >= F.lit(threshold) * sums - 1e-9).withColumn("sizes", sums.cast("long"))
    if windows:
        scored = scored.select("id", "line", "license", "overlap", "sizes").unionByName(license_windows(df, id_col, text_col, table, max(sizes), threshold))
    best = F.max(F.struct((2 * F.col("overlap") / F.col("sizes")).alias("dice"), "overlap", "sizes")).alias("best")
    out = scored.groupBy("id", "license").agg(F.count_distinct(F.when(F.col("line") > 0, F.col("line"))).alias("n_lines"), best)
    return out.select(F.col("id").alias(id_col), "license", "n_lines", F.col("best.overlap").alias("overlap"), F.col("best.sizes").alias("sizes"))


def license_windows(df: DataFrame, id_col: str, text_col: str, table: DataFrame, largest: int, threshold: float) -> DataFrame:
    """(id, line 0, license, overlap, sizes) of windows of consecutive words that reach the threshold with a template.

    A window of a template begins and ends with one of its bigrams, as others at the ends only lower the Dice, and has
    (2-t)/t times the template's bigrams at most, repeats counted. It needs t/(2-t) of them, so only places followed by so
    many within that length are looked at; of each the best window is given."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    df = written(df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("unit")), "windowed")
    units = written(with_bigrams(df).drop("size"), "bigrams")
    grams = units.select("row", F.posexplode("grams").alias("pos", "bigram"))
    hits = grams.join(F.broadcast(table), "bigram").withColumn("span", F.floor(F.col("template_size") * high + 1e-9).cast("int")).withColumn("hash", F.xxhash64("bigram"))
    # a frame has one length, that of the largest template; what is beyond the template's own goes
    ahead = Window.partitionBy("row", "template").orderBy("pos").rangeBetween(0, int(largest * high + 1e-9) - 1)
    hits = hits.withColumn("ahead", F.collect_list(F.struct("pos", "hash")).over(ahead))
    hits = hits.withColumn("ahead", F.expr("filter(ahead, x -> x.pos < pos + span)")).where(F.size("ahead") >= F.col("template_size") * low - 1e-9)
    found = hits.join(units, "row").withColumn("near", F.expr("transform(slice(grams, pos + 1, span), g -> xxhash64(g))"))
    scores = """transform(filter(ahead, x -> x.pos - pos + 1 >= least), x -> named_struct(
        'overlap', size(array_distinct(transform(filter(ahead, y -> y.pos <= x.pos), y -> y.hash))),
        'sizes', size(array_distinct(slice(near, 1, x.pos - pos + 1))) + template_size))"""
    found = found.withColumn("least", F.ceil(F.col("template_size") * low - 1e-9)).withColumn("scores", F.expr(scores))
    best = F.expr("array_max(transform(scores, s -> struct(2 * s.overlap / s.sizes as dice, s.overlap as overlap, s.sizes as sizes)))")
    found = found.select("id", F.lit(0).alias("line"), "license", best.alias("best"))
    found = found.where(2 * F.col("best.overlap") >= F.lit(threshold) * F.col("best.sizes") - 1e-9)
    return found.select("id", "line", "license", F.col("best.overlap").cast("long").alias("overlap"), F.col("best.sizes").cast("long").alias("sizes"))


def license_sql(templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """The scan of `documents` in DuckDB's SQL, windows among its units."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(g)}, {quoted(f'{n}/{k}')}, {quoted(n)}, {len(bigrams_of(t))})" for n, x in templates.items() for k, t in enumerate(x) for g in sorted(bigrams_of(t)))
    return rf"""
        with templates(bigram, template, license, template_size) as (values {rows}),
        lines as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, unnest(string_split(text, chr(10))) as unit from documents),
        units as (select * from lines union all select doc_id, 0, text from documents),
        words as (select doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as w from units),
        grams as (select doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) as g from words where len(w) > 1),
        single as (select doc_id, line, len(g) as size, unnest(g) as bigram from grams),
        texts as (
            select row_number() over () as r, doc_id, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) as g from words where line = 0 and len(w) > 1),
        places as (select r, unnest(range(1, len(g) + 1)) as pos, unnest(g) as bigram from texts),
        hits as (select r, pos, bigram, template, license, template_size from places join templates using (bigram)),
        ahead as (
            select a.r, a.template, a.license, a.template_size, a.pos, list(b.pos order by b.pos) as ps, list(b.bigram order by b.pos) as bs
            from hits a join hits b on a.r = b.r and a.template = b.template and b.pos >= a.pos and b.pos < a.pos + floor(a.template_size * {high}::double + 1e-9)
            group by all having count(*) >= a.template_size * {low}::double - 1e-9),
        ends as (select *, unnest(range(1, len(ps) + 1)) as k from ahead),
        windows as (
            select doc_id, template, license, template_size, len(list_distinct(list_slice(g, pos, ps[k]))) as size, len(list_distinct(list_slice(bs, 1, k))) as overlap
            from ends join texts using (r)
            where ps[k] - pos + 1 >= ceil(template_size * {low}::double - 1e-9)
              and 2 * len(list_distinct(list_slice(bs, 1, k))) >= {threshold} * (len(list_distinct(list_slice(g, pos, ps[k]))) + template_size) - 1e-9),
        scored as (
            select doc_id, line, template, license, size, template_size, count(*) as overlap from single join templates using (bigram)
            group by all having 2 * count(*) >= {threshold} * (size + template_size) - 1e-9
            union all by name select doc_id, 0 as line, template, license, size, template_size, overlap from windows),
        ranked as (select *, row_number() over (partition by doc_id, license order by 2 * overlap / (size + template_size) desc, overlap desc) as place from scored)
        select doc_id, license, count(distinct case when line > 0 then line end) as n_lines,
               max(case when place = 1 then overlap end)::bigint as overlap, max(case when place = 1 then size + template_size end)::bigint as sizes
        from ranked group by doc_id, license"""
