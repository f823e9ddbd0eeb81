"""License notices and whole license texts in documents, with DataFrame expressions only.

A template is the set of its runs of WIDTH words. A text is looked at in overlapping windows, twice as long as a template
and half of that apart, so that a notice of the template's length lies whole in one of them. Only shingles that some
template has can make a window match; the others are dropped as a text is scanned (first by the longest word of a
shingle, then by its hash), and most texts have none left.

Windows with such shingles get BANDS MinHash values, each a band of its own: a window that contains a template shares a
band's value with probability J, the Jaccard similarity of both sets, so it is retrieved with probability
1 - (1 - J) ** BANDS. Templates are taken by classes of length, so a window has less than four times a template's
words: if it holds 0.8 of the template, J is above 0.19 even where all its other shingles are of other
templates as well, which BANDS makes over 0.9999; without such others J is 0.8 and more. Retrieved windows count if they
hold at least the share CONTAINMENT of the template's shingles, counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import stored
from .decontamination import _bit_table, _hash, _in_table, words

WIDTH, CONTAINMENT, BANDS = 5, 0.8, 48
#: Shingles of all templates up to which their tables are broadcast; beyond it, shingles are found in several passes.
TABLE_SHINGLES = 200_000

# Customary one-line license notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Whole license texts, without their copyright lines.
LICENSES = [
    ("MIT-text", _MIT),
    ("BSD-2-Clause-text", "\n".join([_BSD_2, _BSD_END])),
    ("BSD-3-Clause-text", "\n".join([_BSD_2, _BSD_NAMES, _BSD_END])),
    ("ISC-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense-text", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("Apache-2.0-notice-text", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later-notice-text", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("LGPL-2.1-or-later-notice-text", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("AGPL-3.0-or-later-notice-text", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def notices(spark) -> DataFrame:
    """Customary notices and whole license texts as (template, text)."""
    return spark.createDataFrame(NOTICES + LICENSES, "template string, text string")


def scan(df: DataFrame, templates: DataFrame, text: str = "text", name: str = "template", template_text: str = "text") -> DataFrame:
    """(columns of ``df`` but ``text``, template, start, shared, containment), a row for each template a text contains.

    start: the first word of the first window with the highest containment; shared: shingles of the template in it. A
    template of fewer words than WIDTH is one shingle of them all; templates without words and null names match nothing.
    Null and empty texts match nothing. Rows of ``df`` that repeat give rows that repeat. Very long texts are scanned whole,
    by their windows. Columns of ``df`` of the new names are replaced.
    """
    names = [c for c in df.columns if c not in (text, "template", "start", "shared", "containment")]
    size = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(size - WIDTH, F.lit(0)))
    known = templates.select(F.col(name).alias("template"), words(F.col(template_text).cast("string")).alias("w")).where((size > 0) & F.col("template").isNotNull()).distinct()
    each = known.select("template", "w", F.explode(starts).alias("s"), F.least(size, F.lit(WIDTH)).alias("len"), size.alias("n"))
    info = each.groupBy("len").agg(F.count("*").alias("c")).collect()  # WIDTH rows at most
    kept = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(1))
    rows = df.select(kept.alias("__kept"), words(F.col(f"`{text}`").cast("string")).alias("__w"))
    if not info:
        return rows.limit(0).select(*[F.col("__kept")[c].alias(c) for c in names], F.lit(None).cast("string").alias("template"), F.lit(0).alias("start"), F.lit(0).alias("shared"), F.lit(0.0).alias("containment"))
    lengths, total = sorted(r["len"] for r in info), sum(r["c"] for r in info)
    h = F.coalesce(*[F.when(F.col("len") == k, _hash(F.col("w"), F.col("s"), k)) for k in lengths])
    longest = F.array_max(F.transform(F.slice("w", F.col("s") + 1, WIDTH), lambda x: F.struct(F.octet_length(x).alias("l"), x.alias("x"))))["x"]
    shingles = each.select("template", "n", h.alias("h"), F.xxhash64(longest).alias("anchor"), F.octet_length(longest).alias("l"))
    # Tables are of so many shingles at most, whatever templates they are of; each is a pass over the words.
    parts = -(-total // TABLE_SHINGLES)
    marks = rows.withColumn("__marks", F.array().cast(_MARKS))
    for part in range(parts):
        own = shingles if parts == 1 else shingles.where(F.pmod("h", F.lit(parts)) == part)
        marks = _mark(marks, own, lengths)
        if part + 1 < parts:
            marks = stored(marks, "marking")
    marks = stored(marks.select("__kept", F.array_distinct("__marks").alias("__marks"), F.monotonically_increasing_id().alias("__row")), "marks").where(F.size("__marks") > 0)

    # Templates fall into classes of length, a window length for each: twice the next power of two.
    step = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")
    sets = shingles.groupBy("template").agg(F.collect_set("h").alias("set"), F.max("n").alias("n")).withColumn("step", step)
    sets = stored(sets.withColumn("id", F.xxhash64("template")), "templates")
    steps = sorted(r["step"] for r in sets.select("step").distinct().collect())  # one for each power of two
    bands = lambda of: F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.xxhash64(k, F.array_min(F.transform(of, lambda x: F.xxhash64(x, k)))))
    table = sets.select("id", "step", F.explode(bands(F.col("set"))).alias("band")).distinct()
    # Each mark lies in two windows of every length: those that begin at its step and at the one before.
    begins = F.concat(*[F.array_distinct(F.flatten(F.transform("__marks", lambda m: F.array(F.struct(F.lit(s).alias("step"), F.floor(m["s"] / s).cast("int").alias("k")), F.struct(F.lit(s).alias("step"), F.greatest(F.floor(m["s"] / s).cast("int") - 1, F.lit(0)).alias("k")))))) for s in steps])
    begun = marks.select("__row", "__marks", F.explode(begins).alias("x"))
    windows = begun.select("__row", (F.col("x.step") * F.col("x.k")).alias("start"), F.col("x.step").alias("step"), F.array_distinct(F.transform(F.filter("__marks", lambda m: (m["s"] >= F.col("x.step") * F.col("x.k")) & (m["s"] < F.col("x.step") * (F.col("x.k") + 2))), lambda m: m["h"])).alias("own"))
    once = ["band", "step"]
    met = windows.select("__row", "start", "step", "own", F.explode(F.array_distinct(bands(F.col("own")))).alias("band"))
    few = total <= TABLE_SHINGLES  # then the tables are small enough to be broadcast
    small = F.broadcast if few else (lambda x: x)
    met = met.join(small(table), once).select("__row", "start", "own", "id").dropDuplicates(["__row", "start", "id"])
    met = met.join(small(sets.select("id", "template", "set")), "id")
    shared = F.size(F.array_intersect("own", "set"))
    hits = met.select("__row", "template", "start", shared.alias("shared"), (shared / F.size("set")).alias("containment")).where(F.col("containment") >= CONTAINMENT)
    best = hits.groupBy("__row", "template").agg(F.max_by(F.struct("start", "shared", "containment"), F.struct("containment", -F.col("start"))).alias("b"))
    return best.join(marks.select("__row", "__kept"), "__row").select(*[F.col("__kept")[c].alias(c) for c in names], "template", "b.start", "b.shared", "b.containment")


_MARKS = "array<struct<s:int,h:bigint>>"


def _mark(rows: DataFrame, shingles: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` with the places and hashes of the shingles that occur in the words ``__w`` appended to ``__marks``."""
    shortest = shingles.agg(F.min("l")).first()[0] or 0
    w = F.col("__w")
    marked = lambda i: (F.octet_length(F.get(w, i)) >= shortest) & _in_table("__bits", F.xxhash64(F.get(w, i)))
    # No filter on what is computed here: it would be pushed into the scan and repeat the words for every place.
    places = F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), marked)).otherwise(F.array().cast("array<int>"))
    near = rows.withColumn("__bits", _bit_table(shingles.select(F.col("anchor").alias("h")))).withColumn("__near", places).drop("__bits")

    def likely(length: int):
        last = F.size(w) - F.lit(length)
        at = F.flatten(F.transform(F.filter("__near", lambda i: i - F.lit(length - 1) <= last), lambda i: F.sequence(F.greatest(i - F.lit(length - 1), F.lit(0)), F.least(i, last))))
        found = F.transform(F.array_distinct(at), lambda s: F.struct(s.alias("s"), _hash(w, s, length).alias("h")))
        return F.when(last >= 0, F.filter(found, lambda x: _in_table("__bits", x["h"]))).otherwise(F.array())

    some = F.size("__near") > 0
    found = F.when(some, F.concat(*[likely(k) for k in lengths])).otherwise(F.array().cast(_MARKS))
    return near.withColumn("__bits", F.when(some, _bit_table(shingles.select("h")))).withColumn("__marks", F.concat("__marks", found)).drop("__bits", "__near")
