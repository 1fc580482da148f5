"""License scans: normalised text against templates, by Dice over word bigrams; built-in functions only.

A unit is a run of consecutive lines. Normalised, it is the sequence of its words in lower case, a word being a run of
letters and digits; its bigrams are all pairs of words that follow each other, across lines too. The Dice coefficient
of a unit with a template is twice the bigrams that both have, as often as both have them, by the sum of both numbers of
bigrams. So a notice is found on one line, wrapped over several, or in paragraphs with empty lines between.

Runs begin and end on lines where one of the template's bigrams begins or ends: more lines would only make them less
like. A run is reported if its coefficient is at least ``threshold`` and no run that shares a line with it is better: of
equal ones the first, then the shortest, then the license that sorts first.

Only what can't reach the threshold is left out. Dice of a and t bigrams is at most 2 min(a, t) / (a + t), so runs have
between theta / (2 - theta) and (2 - theta) / theta times a template's bigrams; and a text that doesn't hold that share
of a template's bigrams anywhere has no run like it, which anchor words tell before any bigram is made.

Null and empty texts have no unit. Very long texts are searched whole, in parts of PART words: each with so many of the
next part's that no run which begins in it is cut, so that the work grows with the text's length. Rows that repeat are reported each, so are rows
that share an id; null ids are ids. Other columns are not read, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, text_of

THRESHOLD, PART, LETTERS = 0.8, 4096, 8  # words of a part, letters of a word: longer texts are cut

# Words too common to be anchors unless nothing else is left.
COMMON = {"a", "an", "and", "any", "as", "be", "by", "can", "for", "in", "is", "of", "on", "or", "that", "the", "this", "to", "was", "will", "with", "you"}

# Customary short notices and permission texts of public licenses.
TEMPLATES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_bigrams(text: str) -> Counter[str]:
    words = template_words(text)
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words that touch so many bigrams of each template that a text without all of them can't hold its least share.

    The word that touches most of what is still asked for comes first, common words last.
    """
    grams = {name: template_bigrams(text) for name, text in templates.items()}
    asked = {name: g.total() - threshold / (2 - threshold) * g.total() for name, g in grams.items()}
    chosen: list[str] = []
    while any(a >= 0 for a in asked.values()):
        gains: Counter[str] = Counter()
        for name in (n for n, a in asked.items() if a >= 0):
            touched: Counter[str] = Counter()
            for g, n in grams[name].items():
                for w in set(g.split()):
                    touched[w] += n
            gains += Counter({w: min(n, asked[name] + 1) for w, n in touched.items()})
        word = min(gains, key=lambda w: (2 if w in COMMON or w.isdigit() else len(w) < 4, -gains[w], w))
        chosen.append(word)
        for name, some in grams.items():
            for g in [g for g in some if word in g.split()]:
                asked[name] -= some.pop(g)
    return sorted(chosen)


NAMED = ["row", "doc_id", "part", "offset", "own", "cut"]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def parts(docs: DataFrame, templates: dict[str, str], threshold: float, part: int = PART) -> DataFrame:
    """(row, doc_id, part, offset, own, cut, lines) of texts that hold an anchor: their lines as words, those of long texts in
    parts. ``offset`` is the first line's number, ``own`` how many lines are the part's own, before those of the next one;
    ``cut`` says that there may be others."""
    c = F.col
    needed = anchors(templates, threshold)
    longest = math.ceil(max((template_bigrams(t).total() for t in templates.values()), default=0) * (2 - threshold) / threshold) + 2
    part = max(part, longest)
    # As parts of words anchors are soon told from most texts; of the rest, only those that have one as a word are cut up.
    word = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(needed)})(?![\p{{L}}\p{{N}}])"
    holds = bound(F.lower(text_of()), lambda t: functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(a)) for a in needed]) & t.rlike(word))
    # A number for each row in each step: with it, no step is merged into the next and computed again there.
    one = F.monotonically_increasing_id()
    texts, long = docs.select("doc_id", text_of().alias("text")), F.length("text") > LETTERS * part  # told before a text is cut up
    lines = F.transform(F.split("text", "\n", -1), words).alias("lines")
    whole = texts.where(~long).where(holds).select(one.alias("row"), "doc_id", lines)
    whole = whole.select(one, "row", "doc_id", F.lit(0).cast("long").alias("part"), F.lit(0).alias("offset"), F.size("lines").alias("own"), F.lit(False).alias("cut"), "lines").select(*NAMED, "lines")
    each = texts.where(long).where(holds).select((-one - 1).alias("row"), "doc_id", lines).select("row", "doc_id", F.posexplode("lines").alias("line", "w"))
    before = F.coalesce(F.sum(F.size("w")).over(Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("before", before).withColumn("part", F.floor(c("before") / part))
    also = F.when((c("part") > 0) & (c("before") - c("part") * part < longest), F.array(c("part") - 1)).otherwise(F.array().cast("array<bigint>"))
    dealt = each.select("row", "doc_id", "line", "w", c("part").alias("mine"), F.explode(F.concat(F.array("part"), also)).alias("part"))
    grouped = dealt.groupBy("row", "doc_id", "part").agg(F.sort_array(F.collect_list(F.struct("line", "w"))).alias("x"), F.count_if(c("mine") == c("part")).cast("int").alias("own"))
    return whole.unionByName(grouped.where("own > 0").select("row", "doc_id", "part", F.get("x.line", F.lit(0)).alias("offset"), "own", F.lit(True).alias("cut"), c("x.w").alias("lines")))


def candidates(some: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """``parts`` with (license, size, hits, starts, ends) for each template whose least share they hold somewhere.

    ``hits`` are the part's bigrams that the template has, ``n`` times there: struct<gram, n, last, i>, the line in which
    it ends and its place. ``starts`` are the own lines in which one begins, with the place of the line's first bigram,
    ``ends`` those in which one ends, with the place of the last bigram that does.
    """
    c, low = F.col, threshold / (2 - threshold)
    struct = lambda name, g: F.struct(F.lit(name).alias("license"), F.lit(g.total()).alias("size"), F.array(*map(F.lit, g)).alias("grams"), F.array(*map(F.lit, g.values())).alias("times"))
    known = F.array(*[struct(name, template_bigrams(text)) for name, text in sorted(templates.items())])
    one = F.monotonically_increasing_id()
    rows = some.select(one, *NAMED, "lines")
    flat = F.flatten("lines")
    grams = bound(flat, lambda w: F.slice(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b)), F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))
    line_of = F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, F.size(x))))
    rows = rows.select(one, *NAMED, "lines", grams.alias("all"), line_of.alias("line_of"))
    # Of a bigram that a template has n times, a text's share counts n if it holds it at all: never less than it has.
    share = lambda t: F.aggregate(F.array_intersect("all", t["grams"]), F.lit(0), lambda n, g: n + F.get(t["times"], F.array_position(t["grams"], g).cast("int") - 1))
    able = F.filter(known, lambda t: share(t) >= F.ceil(t["size"] * low - 1e-9))
    rows = rows.select(one, *NAMED, "lines", "all", "line_of", able.alias("able"))
    rows = rows.select(*NAMED, "lines", "all", "line_of", F.explode("able").alias("t"))
    place = lambda g: F.array_position("t.grams", g).cast("int")
    every = F.transform("all", lambda g, i: F.struct(g.alias("gram"), i.alias("i"), place(g).alias("at")))
    hits = F.transform(F.filter(every, lambda h: h["at"] > 0), lambda h: F.struct(h["gram"], F.get("t.times", h["at"] - 1).alias("n"), F.get("line_of", h["i"] + 1).alias("last"), h["i"]))
    rows = rows.select(one, *NAMED, "t.license", "t.size", "lines", "line_of", hits.alias("hits"))
    first_word = lambda line: F.array_position("line_of", line).cast("int") - 1
    lines_of = lambda line: F.array_distinct(F.transform("hits", line))
    starts = F.transform(F.filter(lines_of(lambda h: F.get("line_of", h["i"])), lambda x: x < c("own")), lambda x: F.struct(x.alias("line"), first_word(x).alias("i")))
    ends = F.transform(lines_of(lambda h: h["last"]), lambda x: F.struct(x.alias("line"), (first_word(x) + F.size(F.get("lines", x)) - 2).alias("i")))
    return rows.select(*NAMED, "license", "size", "hits", starts.alias("starts"), ends.alias("ends"))


def runs(some: DataFrame, threshold: float) -> DataFrame:
    """(row, doc_id, part, cut, first_line, last_line, license, dice) of all runs that reach the threshold.

    A bigram counts as long as it has come less often since the run's first line than the template has it, so the
    bigrams that both have are those counted up to a run's end.
    """
    c, low, high = F.col, threshold / (2 - threshold), (2 - threshold) / threshold
    begun = some.select(*NAMED, "license", "size", "hits", "ends", F.explode("starts").alias("s"))
    near = F.filter("hits", lambda h: (h["i"] >= c("s.i")) & (h["i"] <= c("s.i") + c("size") * high))
    begun = begun.select(F.monotonically_increasing_id().alias("one"), *NAMED, "license", "size", "s", "ends", near.alias("hits"))
    counted = F.filter("hits", lambda h, k: F.size(F.filter(F.slice("hits", F.lit(1), k), lambda x: x["gram"] == h["gram"])) < h["n"])
    begun = begun.select(F.monotonically_increasing_id().alias("one"), *NAMED, "license", "size", "s", "ends", counted.alias("counted"))
    fit = F.filter("ends", lambda e: (e["i"] - c("s.i") + 1 >= c("size") * low - 1e-9) & (e["i"] - c("s.i") + 1 <= c("size") * high + 1e-9))
    shared = lambda e: F.size(F.filter("counted", lambda h: h["i"] <= e["i"]))
    run = lambda e: F.struct((c("s.line") + c("offset")).cast("long").alias("first_line"), (e["line"] + c("offset")).cast("long").alias("last_line"), c("license"), (F.lit(2.0) * shared(e) / (c("size") + e["i"] - c("s.i") + 1)).alias("dice"))
    ended = begun.select("row", "doc_id", "part", "cut", F.explode(F.transform(fit, run)).alias("r"))
    return ended.where(c("r.dice") >= threshold).select("row", "doc_id", "part", "cut", "r.*")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """doc_id, first_line, last_line (from 0), license, dice: a row for each run of lines of ``docs`` with a license.

    Short texts are pruned and compared where they lie; only the runs found are dealt out, by text, those of long ones by part:
    a run can be beaten by those that begin in its own part, the one before and the one after only.
    """
    templates, c = TEMPLATES if templates is None else templates, F.col
    found = runs(candidates(parts(docs, templates, threshold, part), templates, threshold), threshold)
    near = F.when(c("cut"), F.array(c("part") - 1, c("part"), c("part") + 1)).otherwise(F.array("part"))
    found = found.select("row", "doc_id", F.explode(near).alias("at"), "part", "first_line", "last_line", "license", "dice")
    found = found.groupBy("row", "doc_id", "at").agg(F.collect_list(F.struct("first_line", "last_line", "license", "dice", (c("at") == c("part")).alias("own"))).alias("r"))  # three parts' own
    better = lambda x, y: (x["dice"] > y["dice"]) | ((x["dice"] == y["dice"]) & (F.struct(x["first_line"], x["last_line"], x["license"]) < F.struct(y["first_line"], y["last_line"], y["license"])))
    beaten = lambda y: F.exists("r", lambda x: (x["first_line"] <= y["last_line"]) & (x["last_line"] >= y["first_line"]) & better(x, y))
    return found.select("doc_id", F.explode(F.filter("r", lambda y: y["own"] & ~beaten(y))).alias("u")).select("doc_id", "u.first_line", "u.last_line", "u.license", "u.dice")


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same as ANSI SQL over ``documents``, for ids that don't repeat."""
    templates = TEMPLATES if templates is None else templates
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows = ", ".join(f"('{name}', '{g}', {n})" for name, text in sorted(templates.items()) for g, n in template_bigrams(text).items())
    return f"""
WITH templates(license, gram, n) AS (VALUES {rows}),
sizes AS (SELECT license, sum(n)::BIGINT AS size FROM templates GROUP BY license),
lines AS (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
words AS (SELECT doc_id, line, unnest(range(len(w))) AS k, unnest(w) AS w FROM (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM lines)),
pairs AS (SELECT doc_id, row_number() OVER o AS i, line AS first, lead(line) OVER o AS last, w || ' ' || lead(w) OVER o AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY line, k)),
hits AS (SELECT doc_id, license, i, first, last, p.gram, n FROM pairs p JOIN templates USING (gram)),
able AS (SELECT doc_id, license, size FROM (SELECT DISTINCT doc_id, license, gram, n FROM hits) JOIN sizes USING (license) GROUP BY ALL HAVING sum(n) >= size * {low} - 1e-9),
begins AS (SELECT doc_id, line, min(i) AS i FROM (SELECT doc_id, first AS line, i FROM pairs WHERE gram IS NOT NULL) GROUP BY ALL),
ends AS (SELECT doc_id, last AS line, max(i) AS i FROM pairs WHERE gram IS NOT NULL GROUP BY ALL),
firsts AS (SELECT DISTINCT doc_id, license, size, h.first AS a, b.i AS ai FROM hits h JOIN able USING (doc_id, license) JOIN begins b USING (doc_id) WHERE b.line = h.first),
lasts AS (SELECT DISTINCT doc_id, license, h.last AS b, e.i AS bi FROM hits h JOIN able USING (doc_id, license) JOIN ends e USING (doc_id) WHERE e.line = h.last),
runs AS (SELECT doc_id, license, size, a, ai, b, bi FROM firsts JOIN lasts USING (doc_id, license) WHERE bi - ai + 1 BETWEEN size * {low} - 1e-9 AND size * {high} + 1e-9),
shared AS (SELECT doc_id, license, size, a, ai, b, bi, gram, least(count(*), n) AS m FROM runs JOIN hits h USING (doc_id, license) WHERE h.i BETWEEN ai AND bi GROUP BY doc_id, license, size, a, ai, b, bi, gram, n),
scored AS (SELECT doc_id, license, a, b, 2.0::DOUBLE * sum(m)::BIGINT / (size + bi - ai + 1) AS dice FROM shared GROUP BY doc_id, license, size, a, ai, b, bi),
kept AS (SELECT * FROM scored WHERE dice >= {threshold})
SELECT doc_id, a AS first_line, b AS last_line, license, dice FROM kept y WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.doc_id = y.doc_id AND x.a <= y.b AND x.b >= y.a AND (x.dice > y.dice OR (x.dice = y.dice AND (x.a, x.b, x.license) < (y.a, y.b, y.license))))
"""
