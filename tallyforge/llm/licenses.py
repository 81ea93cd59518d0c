"""Licence scans in DataFrame functions only: windows of words, lines and whole texts against licence templates.

Similarity is the Dice coefficient of the sets of word bigrams. Templates whose
size is out of bounds for the threshold are never compared, and texts that hold
none of the words that a match can't do without aren't cut into words at all.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: What the permissive licences below disclaim in the same words.
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} General Public License for more details."
#: Templates (fixed values): public notices, and whole licences where they are short.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("AGPL-3.0", _GPL.format("Affero", 3, "Affero")),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("GPL-2.0", _GPL.format("", 2, "")),
    ("GPL-3.0", _GPL.format("", 3, "")),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
]
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed(templates: list[tuple[str, str]], threshold: float) -> tuple[list[str], list[str]]:
    """Words and bigrams of which any match holds at least one.

    A text that matches shares at least t / (2 - t) of the template's bigrams,
    so of any few more than the others it must have one. These are covered by
    words of 5 letters or more, long ones and those in many bigrams first, and
    by bigrams where only short words are left.
    """
    words: set[str] = set()
    pairs: set[str] = set()
    for grams in sorted((template_bigrams(text) for _, text in templates), key=len):
        left = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9) + 1
        rest = [g for g in grams if not words.intersection(g.split()) and g not in pairs]
        left -= len(grams) - len(rest)
        while left > 0:
            held: dict[str, int] = {}
            for g in rest:
                for w in set(g.split()):
                    held[w] = held.get(w, 0) + 1
            best = max((w for w in held if len(w) > 4), key=lambda w: (min(held[w], left) * (len(w) - 4), w), default=None)
            gone = [g for g in rest if best in g.split()] if best else rest[:left]
            words.add(best) if best else pairs.update(gone)
            left -= len(gone)
            rest = [g for g in rest if g not in gone]
    return sorted(w for w in words if not any(o != w and o in w for o in words)), sorted(pairs)


def bigrams(text: Column) -> Column:
    """The distinct word bigrams of a text: words are runs of a-z and 0-9 after A-Z is lower-cased."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")
    pairs = F.transform(F.array(words), lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.filter(F.element_at(pairs, 1), lambda g: g.isNotNull()))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, *, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with an array ``into`` of (line, license, dice), by line.

    Each line, and the whole text of several lines as line 0, is compared with
    the templates; its best one counts if the Dice coefficient reaches the
    threshold, and of equal ones the first by name. A null or empty text has no
    matches; neither has one without bigrams. Rows are judged each for itself,
    without a shuffle, and other columns stay as they are; one that is called
    like ``into`` is replaced.
    """
    kind = "array<struct<line:int,license:string,dice:double>>"
    known = sorted({(name, tuple(g)) for name, t in templates if (g := template_bigrams(t))})
    if not known:
        return docs.withColumn(into, F.array().cast(kind))
    every = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for name, g in known))
    low = F.translate(F.col(text), UPPER, LOWER)
    words, pairs = needed(templates, threshold)
    tests = [F.contains(low, F.lit(w)) for w in words]
    if pairs:
        tests.append(low.rlike("|".join(g.replace(" ", "[^a-z0-9]+") for g in pairs)))
    maybe = reduce(lambda a, b: a | b, tests)
    lines = F.split(F.col(text), "\n")
    units = F.transform(F.concat(F.array(F.when(F.size(lines) > 1, F.col(text))), lines), lambda u, i: F.struct(i.alias("line"), bigrams(F.coalesce(u, F.lit(""))).alias("grams")))
    least = min(len(g) for _, g in known) * threshold / (2 - threshold)
    units = F.filter(units, lambda u: F.size(u.grams) >= math.ceil(least - 1e-9))

    def best(u: Column) -> Column:
        size = F.size(u.grams)
        bounded = F.filter(every, lambda t: (size * (2 - threshold) >= t.n * threshold - 1e-9) & (size * threshold <= t.n * (2 - threshold) + 1e-9))
        scored = F.transform(bounded, lambda t: F.struct((-2.0 * F.size(F.array_intersect(u.grams, t.grams)) / (size + t.n)).alias("less"), t["name"].alias("name")))
        return F.struct(u.line.alias("line"), F.array_min(scored).alias("top"))

    found = F.filter(F.transform(units, best), lambda m: m.top.less <= -threshold + 1e-12)
    told = F.transform(found, lambda m: F.struct(m.line.alias("line"), m.top["name"].alias("license"), (-m.top.less).alias("dice")))
    return docs.withColumn(into, F.when(F.coalesce(maybe, F.lit(False)), told).otherwise(F.array().cast(kind)))


def find_passages(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, *, text: str = "text", into: str = "passages") -> DataFrame:
    """``docs`` with an array ``into`` of (start, end, license, dice): notices inside a line, and licences wrapped over several.

    The windows of a template of n bigrams are all runs of the text's words,
    over any lines, of at most n (2 - t) / t word pairs, repeats counted. Of
    those that begin at one word the best counts if it reaches the threshold t,
    of equal ones the shortest; of these that end at one word, the best, of
    equal ones the first. Such a window is dropped if another template is as
    good a match for the same words and better or first by name, or if it
    overlaps one that is better (by Dice, name, template and place) and stays.
    So every occurrence of a licence is found, repeated ones too. Places are
    words of the text, from 0, end exclusive; passages are by place.

    A best window begins and ends with a bigram of its template, so others are
    never looked at; and only from bigrams that are followed by enough others
    of the template in reach is anything counted. The work grows with the text.
    A null or empty text has no passages; repeated rows are judged each. A
    column that is called like ``into`` is replaced, the others stay.
    """
    kind = "array<struct<start:int,end:int,license:string,dice:double>>"
    known = sorted({(name, tuple(g)) for name, t in templates if (g := template_bigrams(t))})
    if not known:
        return docs.withColumn(into, F.array().cast(kind))
    reach = lambda n: math.floor(n * (2 - threshold) / threshold + 1e-9)
    least = lambda n: math.ceil(n * threshold / (2 - threshold) - 1e-9)
    every = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.lit(reach(len(g))).alias("reach"), F.lit(least(len(g))).alias("least"), F.array(*map(F.lit, g)).alias("grams")) for i, (name, g) in enumerate(known)))
    inside = sorted({x for _, g in known for x in g})
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)

    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    words, pairs = needed(templates, threshold)
    tests = [F.contains(low, F.lit(w)) for w in words]
    if pairs:
        tests.append(low.rlike("|".join(g.replace(" ", "[^a-z0-9]+") for g in pairs)))
    maybe = reduce(lambda a, b: a | b, tests)

    def window(grams: Column, t: Column, first: Column) -> Column:
        """The best window from one bigram on: (less, start, size), its size in bigrams."""
        part = F.slice(grams, first + 1, t.reach)

        def step(a: Column, x: Column) -> Column:
            new = (F.array_position(part, x.g) == x.k + 1).cast("int")
            hit = F.array_contains(t.grams, x.g)
            d, h = a.d + new, a.h + F.when(hit, new).otherwise(0)
            less = -2.0 * h / (d + t.n)
            top = F.when(hit, F.least(a.top, F.struct(less.alias("less"), first.alias("start"), (x.k + 1).alias("size")))).otherwise(a.top)
            return F.struct(d.alias("d"), h.alias("h"), top.alias("top"))

        none = F.struct(F.lit(0.0).alias("less"), first.alias("start"), F.lit(0).alias("size"))
        return F.aggregate(F.transform(part, lambda g, k: F.struct(g.alias("g"), k.alias("k"))), F.struct(F.lit(0).alias("d"), F.lit(0).alias("h"), none.alias("top")), step, lambda a: a.top)

    def best(grams: Column, hits: Column, t: Column) -> Column:
        """The windows of a template that reach the threshold: the best from each start, and of these the best to each end."""
        own = F.transform(F.filter(hits, lambda x: F.array_contains(t.grams, x.g)), lambda x: x.k)
        near = lambda at: F.filter(at, lambda k, i: F.coalesce(F.get(at, i + t.least - 1) - k < t.reach, F.lit(False)))
        tops = F.filter(F.transform(let(own, near), lambda k: window(grams, t, k)), lambda m: m["less"] <= -threshold + 1e-12)
        ends = F.array_sort(F.transform(tops, lambda m: F.struct((m.start + m["size"]).alias("end"), m["less"].alias("less"), m.start.alias("start"), m["size"].alias("size"))))
        first = lambda held: F.filter(held, lambda m, i: F.coalesce(F.get(held, i - 1).end != m.end, F.lit(True)))
        return F.transform(let(ends, first), lambda m: F.struct(m["less"].alias("less"), t["name"].alias("name"), t.i.alias("i"), m.start.alias("start"), m["size"].alias("size")))

    def first_of(grams: Column, m: Column) -> Column:
        """Whether no other template is a better match for a window's words, or as good and first by name."""
        part = F.array_distinct(F.slice(grams, m.start + 1, m["size"]))
        scored = F.transform(every, lambda t: F.struct((-2.0 * F.size(F.array_intersect(part, t.grams)) / (F.size(part) + t.n)).alias("less"), t["name"].alias("name")))
        return F.array_min(scored)["name"] == m["name"]

    def passages(grams: Column) -> Column:
        placed = F.transform(grams, lambda g, k: F.struct(g.alias("g"), k.alias("k")))
        found = let(F.filter(placed, lambda x: x.g.isin(inside)), lambda hits: F.flatten(F.transform(every, lambda t: best(grams, hits, t))))
        found = F.filter(F.array_sort(found), lambda m: first_of(grams, m))
        apart = lambda a, b: (a.start >= b.start + b["size"]) | (b.start >= a.start + a["size"])
        kept = F.aggregate(found, F.filter(found, lambda m: F.lit(False)), lambda a, m: F.when(F.forall(a, lambda o: apart(o, m)), F.array_append(a, m)).otherwise(a))
        return F.array_sort(F.transform(kept, lambda m: F.struct(m.start.alias("start"), (m.start + m["size"] + 1).alias("end"), m["name"].alias("license"), (-m.less).alias("dice"))))

    cut = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")
    grams = let(cut, lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    grams = F.filter(grams, lambda g: g.isNotNull())
    return docs.withColumn(into, F.when(maybe, let(grams, passages)).otherwise(F.array().cast(kind)))


def _report(docs: DataFrame, found: str) -> DataFrame:
    """One row per document: its number of matches, its licences, and the best match."""
    top = F.array_min(F.transform(found, lambda m: F.struct((-m.dice).alias("less"), m.license.alias("license"))))
    return docs.select("doc_id", found).withColumn("top", top).select(
        "doc_id",
        F.size(found).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m.license))), ",").alias("licenses"),
        F.col("top.license").alias("best_license"),
        F.round(-F.col("top.less"), 6).alias("best_dice"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document: whole, inside a line or over several."""
    return _report(find_passages(table(spark, sf_dir, "documents").select("doc_id", "text")), "passages")


def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document, and the whole texts, that are a licence."""
    return _report(scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")), "licenses")


def _templates_sql() -> str:
    known = sorted({(name, tuple(template_bigrams(t))) for name, t in TEMPLATES})
    return ", ".join(f"({i}, {name!r}, [{', '.join(map(repr, g))}])" for i, (name, g) in enumerate(known))


#: Windows from one of a template's bigrams to another in its reach; those that hold too few of them to match are left out.
OP2_SQL = f"""
WITH RECURSIVE t(i, name, grams) AS (VALUES {_templates_sql()}),
r AS (SELECT i, name, grams, len(grams) AS n, floor(len(grams) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9)::BIGINT AS reach, ceil(len(grams) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9)::BIGINT AS least FROM t),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS ws FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS words FROM w WHERE len(ws) > 1),
p AS (SELECT doc_id, unnest(words) AS gram, unnest(range(0, len(words))) AS pos FROM g),
h AS (SELECT doc_id, i, n, reach, least, pos, row_number() OVER (PARTITION BY doc_id, i ORDER BY pos) AS rn FROM p JOIN (SELECT i, n, reach, least, unnest(grams) AS gram FROM r) USING (gram)),
win AS (SELECT a.doc_id, a.i, a.pos AS lo, b.pos - a.pos + 1 AS size FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.i = b.i AND b.pos BETWEEN a.pos AND a.pos + a.reach - 1 AND b.rn - a.rn + 1 >= a.least),
s AS (SELECT win.doc_id, win.i, r.name, lo, size, list_distinct(words[lo + 1:lo + size]) AS part, 2.0 * len(list_intersect(part, grams)) / (len(part) + n) AS dice FROM win JOIN g USING (doc_id) JOIN r USING (i)),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, i, lo ORDER BY dice DESC, size) = 1),
b AS (SELECT * FROM o WHERE dice >= {THRESHOLD} - 1e-12 QUALIFY row_number() OVER (PARTITION BY doc_id, i, lo + size ORDER BY dice DESC, lo) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name, i, lo, size) AS k FROM b WHERE name = (SELECT arg_min(r.name, (-2.0 * len(list_intersect(b.part, r.grams)) / (len(b.part) + r.n), r.name)) FROM r)),
c AS (
  SELECT doc_id, 0::BIGINT AS k, []::STRUCT(lo BIGINT, hi BIGINT, name VARCHAR, dice DOUBLE)[] AS kept FROM documents
  UNION ALL SELECT c.doc_id, f.k, CASE WHEN len(list_filter(kept, lambda o: f.lo < o.hi AND o.lo < f.lo + f.size)) = 0 THEN list_append(kept, {{'lo': f.lo, 'hi': f.lo + f.size, 'name': f.name, 'dice': f.dice}}) ELSE kept END FROM c JOIN f ON f.doc_id = c.doc_id AND f.k = c.k + 1
), e AS (SELECT doc_id, kept FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)
SELECT doc_id, len(kept)::BIGINT AS n_matches, array_to_string(list_sort(list_distinct(list_transform(kept, lambda o: o.name))), ',') AS licenses,
  (list_sort(list_transform(kept, lambda o: {{'less': -o.dice, 'name': o.name}})))[1].name AS best_license, round(list_max(list_transform(kept, lambda o: o.dice)), 6)::DOUBLE AS best_dice FROM e"""

LINES_SQL = f"""
WITH t(i, name, grams) AS (VALUES {_templates_sql()}),
l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS unit FROM l UNION ALL SELECT doc_id, 0, text FROM l WHERE len(lines) > 1),
w AS (SELECT doc_id, line, regexp_extract_all(translate(unit, '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS ws FROM u),
g AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM w WHERE len(ws) > 1),
s AS (SELECT doc_id, line, name, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM g, t),
b AS (SELECT doc_id, line, name, dice FROM s WHERE dice >= {THRESHOLD} - 1e-12 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, name) = 1),
d AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, arg_min(name, (-dice, name)) AS best, max(dice) AS dice FROM b GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(names, '') AS licenses, best AS best_license, round(d.dice, 6)::DOUBLE AS best_dice FROM documents LEFT JOIN d USING (doc_id)"""
