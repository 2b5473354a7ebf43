"""License scan: MinHash bands over overlapping text windows, then exact containment.

Templates and texts become words (lower-cased runs of letters and digits) and
five-word shingles. Templates fall into size classes: a class holds those of up
to ``size`` shingles, sizes growing by a quarter, and has windows of
``size + step - 1`` shingles that begin at every ``step``-th shingle, a step being
about a quarter of the size. A whole template so lies within one window, with a
similarity of 0.6 at least. Windows that hold no shingle of a template of their
class can't hold it and are left out beforehand.

A window's signature has 64 minima, in 32 bands of two: a pair of similarity 0.6
shares a band with probability above 0.999999, one of 0.45 (four fifths of a
template in the least fitting window) with 0.999. Templates that share a band are
verified by the exact share of their distinct shingles that the window holds.

Templates of different licenses may have most of their words in common, as those of two versions or
of GPL and AGPL. Where a template's text alone would give four fifths of another's, the two are rivals:
a window counts for one of them only if it also holds half of the shingles that tell it
from the other. So each notice gives its own license and no other.

Only DataFrame operations run on the executors. Defined results: null or blank
texts and templates of fewer than five words match nothing; rows with a null
doc_id are left out; repeated rows count once; repeated templates match each by
their own id. Templates may have any length. Ties go to the first window. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import K, shingles, sized, word_list
from lodestone.llm.shared import table, written

BANDS, ROWS = 32, 2

#: The license texts and notices that the query looks for (id, license, text).
NOTICES = (
    ("mit-released", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "This project is licensed under the MIT License."),
    ("mit-permission", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2-header", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("gpl-3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-conditions", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit-text", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-text", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-text", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib-text", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense-text", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("mpl-2-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("gpl-2-line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-header", "LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-header", "AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("gpl-warranty", "GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc-by-sa-4-line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4-long-line", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-line", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)



def class_sizes(most: int) -> list[int]:
    """1 to 8, then each a quarter above the last, up to ``most`` at least."""
    sizes = list(range(1, 9))
    while sizes[-1] < most:
        sizes.append(sizes[-1] + sizes[-1] // 4)
    return sizes


def size_class(n: Column, most: int) -> Column:
    """The least class size of at least ``n`` shingles, ``n`` being at most ``most``."""
    return F.array_min(F.filter(F.lit(class_sizes(most)).cast("array<int>"), lambda s: s >= n))


def step_of(size: Column) -> Column:
    return (F.floor((size + 3) / 4)).cast("int")


def signature(sh: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """(band, key) of an array of shingle hashes."""

    def least(i: int) -> Column:
        return F.array_min(F.transform(sh, lambda h: F.xxhash64(h, F.lit(i))))

    return F.array(*[F.struct(F.lit(b).alias("b"), F.xxhash64(*[least(b * rows + r) for r in range(rows)]).alias("v")) for b in range(bands)])


def rivals(known: DataFrame, num: int, den: int) -> DataFrame:
    """template_id, own: for each rival of another license the shingles that tell the template from it. ``known``: template_id, license, t_sh."""
    each = known.select("template_id", "license", F.size("t_sh").alias("n"), F.explode("t_sh").alias("h"))
    other = each.select(F.col("template_id").alias("rival"), F.col("license").alias("r_license"), "h")
    both = each.join(other, "h").where(~F.col("license").eqNullSafe(F.col("r_license")))
    near = both.groupBy("template_id", "rival", "n").count().where(F.col("count") * den >= F.col("n") * num).select("template_id", "rival")
    pairs = near.join(known.select("template_id", "t_sh"), "template_id").join(known.select(F.col("template_id").alias("rival"), F.col("t_sh").alias("r_sh")), "rival")
    own = pairs.select("template_id", F.array_except("t_sh", "r_sh").alias("own")).where(F.size("own") > 0)
    return own.groupBy("template_id").agg(F.collect_list("own").alias("own"))


def scan(docs: DataFrame, templates: DataFrame, num: int = 80, den: int = 100, k: int = K, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, template_id, license, start, containment: the best window of each document and template that holds num / den of it.

    ``docs``: doc_id, text; ``templates``: template_id, license, text. What comes
    from the templates is broadcast only up to ``broadcast_bytes``.
    """
    known = templates.select("template_id", "license", word_list(F.col("text")).alias("words")).where(F.size("words") >= k)
    known = known.select("template_id", "license", F.array_distinct(shingles(F.col("words"), k)).alias("t_sh"), F.size("words").alias("w"))
    known = written(known)
    longest = known.agg(F.coalesce(F.max("w"), F.lit(k))).first()[0]
    known = known.withColumn("size", size_class(F.col("w") - (k - 1), longest - (k - 1)))
    known = written(known.join(rivals(known, num, den), "template_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<array<bigint>>"))))
    own = F.aggregate("own", F.lit(0), lambda n, o: n + F.size(o))
    of = known.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("t_sh")), F.lit(0)).alias("n"), F.coalesce(F.sum(own), F.lit(0)).alias("own")).first()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    anchors = known.select("size", F.explode("t_sh").alias("h")).distinct()
    found = texts.select("doc_id", word_list(F.col("text")).alias("words")).where(F.size("words") >= k).select("doc_id", F.posexplode(shingles(F.col("words"), k)).alias("p", "h"))
    hits = found.join(sized(anchors, 32 * of["n"], broadcast_bytes), "h").select("doc_id", "p", "size", step_of(F.col("size")).alias("step"))
    # The windows around a hit begin at multiples of the step, at most size + step - 2 before it.
    first = F.greatest(F.ceil((F.col("p") - F.col("size") - F.col("step") + 2) / F.col("step")).cast("int"), F.lit(0))
    last = F.floor(F.col("p") / F.col("step")).cast("int")
    at = hits.select("doc_id", "size", "step", F.explode(F.sequence(first, last)).alias("i")).select("doc_id", F.struct("size", (F.col("i") * F.col("step")).alias("start"), (F.col("size") + F.col("step") - 1).alias("span")).alias("at"))
    wanted = written(at.distinct().groupBy("doc_id").agg(F.collect_list("at").alias("at")))

    held = texts.join(wanted, "doc_id").select("doc_id", "at", word_list(F.col("text")).alias("words")).select("doc_id", "at", shingles(F.col("words"), k).alias("sh"))
    cut = F.transform("at", lambda a: F.struct(a["size"].alias("size"), a["start"].alias("start"), F.array_distinct(F.slice(F.col("sh"), a["start"] + 1, a["span"])).alias("sh")))
    windows = held.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*").where(F.size("sh") > 0)

    index = known.select("template_id", "size", "w", F.explode(signature(F.col("t_sh"))).alias("k")).select("template_id", "size", "w", "k.b", "k.v").distinct()
    probes = windows.select("doc_id", "size", "start", "sh", F.explode(signature(F.col("sh"))).alias("k")).select("doc_id", "size", "start", "sh", "k.b", "k.v")
    shared = F.size(F.array_intersect("sh", "t_sh")) / F.size("t_sh")
    near = probes.join(sized(index, 64 * BANDS * of["rows"], broadcast_bytes), ["size", "b", "v"])
    full = known.select("template_id", "size", "w", "license", "t_sh", "own")
    told = F.forall("own", lambda o: 2 * F.size(F.array_intersect("sh", o)) >= F.size(o))
    near = near.join(sized(full, 128 * of["rows"] + 8 * (of["n"] + of["own"]), broadcast_bytes), ["template_id", "size", "w"])
    hit = near.select("doc_id", "template_id", "license", "start", shared.alias("containment"), told.alias("told")).where((F.col("containment") * den >= num) & F.col("told"))
    best = F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("x")
    return hit.groupBy("doc_id", "template_id", "license").agg(best).select("doc_id", "template_id", "license", (-F.col("x.back")).alias("start"), F.col("x.containment").alias("containment"))


def op8_license_scan(spark, sf_dir):
    """The fixed notices in all ``documents``."""
    return scan(table(spark, sf_dir, "documents"), spark.createDataFrame(list(NOTICES), "template_id string, license string, text string"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP8_SQL = r"""
WITH n(template_id, license, text) AS (VALUES """ + ", ".join("(" + ", ".join(map(_quoted, x)) + ")" for x in NOTICES) + r"""),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
t AS (SELECT template_id, license, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM n),
ts AS MATERIALIZED (SELECT DISTINCT template_id, license, len(w) - 4 AS n, array_to_string(w[p + 1:p + 5], ' ') AS h FROM t, unnest(range(0, len(w) - 4)) AS x(p)),
ds AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS h FROM d, unnest(range(0, len(w) - 4)) AS x(p)),
sizes AS (SELECT list_min(list_filter(""" + str(class_sizes(2000)) + r""", lambda s: s >= m.n)) AS size, m.* FROM (SELECT template_id, any_value(n) AS n, count(*) AS total FROM ts GROUP BY 1) m),
hits AS (SELECT doc_id, p, ts.h, template_id, license, size, (size + 3) // 4 AS step, total FROM ds JOIN ts USING (h) JOIN sizes USING (template_id)),
win AS (SELECT doc_id, template_id, license, total, i * step AS start, h FROM hits, unnest(range(greatest(CAST(ceil((p - size - step + 2) / step) AS BIGINT), 0), p // step + 1)) AS x(i)),
c AS (SELECT doc_id, template_id, license, start, count(DISTINCT h) / any_value(total) AS containment FROM win GROUP BY ALL),
v AS (SELECT template_id, rival FROM (SELECT b.template_id, a.template_id AS rival, count(*) AS k FROM ts b JOIN ts a ON a.h = b.h WHERE a.license <> b.license GROUP BY 1, 2) x JOIN sizes USING (template_id) WHERE 100 * k >= 80 * total),
ow AS MATERIALIZED (SELECT v.template_id, v.rival, b.h FROM v JOIN ts b ON b.template_id = v.template_id WHERE NOT EXISTS (SELECT 1 FROM ts a WHERE a.template_id = v.rival AND a.h = b.h)),
os AS (SELECT template_id, rival, count(*) AS n FROM ow GROUP BY 1, 2),
f AS MATERIALIZED (SELECT * FROM c WHERE 100 * containment >= 80),
have AS (SELECT win.doc_id, win.template_id, win.start, ow.rival, count(DISTINCT win.h) AS k FROM win JOIN ow ON ow.template_id = win.template_id AND ow.h = win.h GROUP BY ALL),
bad AS (SELECT DISTINCT f.doc_id, f.template_id, f.start FROM f JOIN os ON os.template_id = f.template_id
  LEFT JOIN have ON have.doc_id = f.doc_id AND have.template_id = f.template_id AND have.start = f.start AND have.rival = os.rival WHERE 2 * coalesce(have.k, 0) < os.n),
r AS (SELECT f.*, row_number() OVER (PARTITION BY f.doc_id, f.template_id ORDER BY containment DESC, f.start) AS k FROM f ANTI JOIN bad ON bad.doc_id = f.doc_id AND bad.template_id = f.template_id AND bad.start = f.start)
SELECT doc_id, template_id, license, start, containment FROM r WHERE k = 1
"""
