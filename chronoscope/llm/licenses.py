"""License scans: MinHash bands over overlapping windows, verified by exact shingle containment.

Templates of one length share a window length: theirs and a quarter more, the
quarter being the step between windows, so every place a template can stand is
whole in some window. With containment c of a template, window and template
have a Jaccard similarity of at least c * 0.8 / (1 + (1 - c)); with ``BANDS``
bands of one value each they collide with a probability beyond 1 - 1e-5.
Windows that hold no shingle of any template can't be verified and are not
hashed: a document's shingles are first intersected with those of all templates. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import once

SHINGLE, CONTAINED, BANDS = 5, 0.8, 16
#: Templates at most: their shingles and bands are broadcast.
TEMPLATES = 2_000

#: Words of all templates at most.
TEMPLATE_WORDS = 400_000

# Wordings of public license notices and texts.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

# The license of each wording; a wording that several licenses of a family share is the family's.
LICENSE = {
    "bsd-notice": "bsd", "bsd-2-clause-text": "bsd", "mit-grant": "mit", "mit-text": "mit", "isc-text": "isc", "zlib-text": "zlib",
    "apache-2.0-notice": "apache-2.0", "gpl-3.0-notice": "gpl-3.0", "unlicense-text": "unlicense",
}


def sql() -> str:
    """The scan of ``NOTICES`` in DuckDB's SQL: every window of every template, without bands."""
    rows = ", ".join(f"('{i}', '{LICENSE.get(i, i)}', '{t.replace(chr(39), chr(39) * 2)}')" for i, t in NOTICES.items())
    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH n(license_id, of, text) AS (VALUES {rows}),
t AS (SELECT license_id, ws, len(ws) AS n, least({SHINGLE}, len(ws)) AS k, greatest(1, len(ws) // 4) AS step FROM (SELECT license_id, {split} AS ws FROM n)),
ts AS (SELECT DISTINCT license_id, n, k, step, ws[p : p + k - 1] AS sh FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM t)),
tn AS (SELECT license_id, count(*) AS size FROM ts GROUP BY ALL),
d AS (SELECT doc_id, {split} AS ws FROM documents),
ds AS (SELECT doc_id, k, p - 1 AS p, ws[p : p + k - 1] AS sh FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM t))),
hit AS (SELECT doc_id, license_id, sh, unnest(range(greatest(-((n + step - k - 1 - p) // step), 0), p // step + 1)) AS s FROM ds JOIN ts USING (k, sh)),
hits AS (SELECT doc_id, license_id, s, count(DISTINCT sh) / any_value(size)::DOUBLE AS share FROM hit JOIN tn USING (license_id) GROUP BY ALL),
best AS (SELECT doc_id, license_id, max(share) AS share FROM hits WHERE share >= {CONTAINED} GROUP BY ALL),
lic AS (SELECT doc_id, of, max(share) AS share FROM best JOIN n USING (license_id) GROUP BY ALL),
found AS (SELECT doc_id, string_agg(of, ',' ORDER BY of) AS license_ids, count(*) AS n_licenses, max(share) AS containment FROM lic GROUP BY doc_id),
texts AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS licenses FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(license_ids, '') AS license_ids, coalesce(n_licenses, 0)::BIGINT AS n_licenses, containment FROM d LEFT JOIN found USING (doc_id) LEFT JOIN texts USING (doc_id)
"""


def templates(spark: SparkSession) -> DataFrame:
    """``license_id, text, license`` of each wording: its own id, its words, and the license that it stands for."""
    return spark.createDataFrame([(i, t, LICENSE.get(i, i)) for i, t in NOTICES.items()], "license_id string, text string, license string")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles(ws: Column, k: int) -> Column:
    n = F.size(ws) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, k)))).otherwise(F.array().cast("array<bigint>"))


def bands(items: Column) -> Column:
    """``band, value`` for each band: the least of the shingles' values under its hash."""

    def least(b: int) -> Column:
        return F.array_min(F.transform(items, lambda x: F.xxhash64(x, F.lit(b))))

    return F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("value")) for b in range(BANDS)])


def _windows(n: int, k: int) -> Column:
    """The windows for templates of ``n`` words that hold one of the places ``_at``; they start at multiples of the step."""
    step = max(1, n // 4)
    size = n + step - k  # shingles of a window

    def around(p: Column) -> Column:
        lo = F.greatest(F.ceil((p - size + 1) / step), F.lit(0)).cast("int")
        return F.sequence(lo, F.greatest(F.floor(p / step).cast("int"), lo))

    starts = F.array_distinct(F.flatten(F.transform("_at", around)))
    return F.transform(starts, lambda s: F.struct(F.lit(n).alias("len"), s.alias("start"), (s * step).alias("first"), F.lit(size).alias("size")))


def scan(docs: DataFrame, notices: DataFrame, contained: float = CONTAINED, limit: int = TEMPLATES) -> DataFrame:
    """``doc_id, license_id, places, containment`` for each document and license found in it.

    ``places`` counts the windows that hold the license, ``containment`` is the
    best of them. Null and empty texts hold none; a long text is scanned whole;
    documents of one id count as one; templates without words are left out, and
    more than ``limit``, or of more than ``TEMPLATE_WORDS`` words, are an error,
    as they are broadcast. An empty table gives no rows; other columns are not
    read.
    """
    t = notices.select("license_id", tokens(F.col("text")).alias("_t")).where(F.size("_t") > 0).withColumn("_len", F.size("_t"))
    lengths = [r["_len"] for r in t.groupBy("_len").count().orderBy("_len").collect()]
    size = t.agg(F.count("*").alias("n"), F.sum("_len").alias("words")).first()
    if size["n"] > limit or (size["words"] or 0) > TEMPLATE_WORDS:
        raise ValueError(f"more than {limit} templates or {TEMPLATE_WORDS} words in them")
    words = once(docs.select("doc_id", "text"), _ws=tokens(F.col("text"))).drop("text")
    found = None
    for k in sorted({min(SHINGLE, n) for n in lengths}):
        own = [n for n in lengths if min(SHINGLE, n) == k]
        mine = t.where(F.col("_len").isin(own)).withColumn("_sh", F.array_distinct(shingles(F.col("_t"), k)))
        all_ = mine.select(F.explode("_sh").alias("h")).agg(F.collect_set("h").alias("a")).scalar()
        d = once(words, _sh=shingles(F.col("_ws"), k)).drop("_ws")
        d = once(d, _met=F.array_intersect(F.col("_sh"), all_)).where(F.size("_met") > 0)
        d = once(d, _at=F.filter(F.transform("_sh", lambda h, i: F.when(F.array_contains(F.col("_met"), h), i)), lambda i: i.isNotNull())).drop("_met")
        each = d.select("doc_id", "_sh", F.explode(F.flatten(F.array(*[_windows(n, k) for n in own]))).alias("_w"))
        each = each.select("doc_id", F.col("_w.len").alias("_len"), F.col("_w.start").alias("_start"), F.slice("_sh", F.col("_w.first") + 1, F.col("_w.size")).alias("_win"))
        keyed = each.withColumn("_band", F.explode(F.when(F.size("_win") > 0, bands(F.col("_win")))))
        marks = F.broadcast(mine.select("license_id", F.col("_len").alias("_tlen"), F.col("_sh").alias("_tsh"), F.explode(bands(F.col("_sh"))).alias("_tband")))
        met = keyed.join(marks, (F.col("_len") == F.col("_tlen")) & (F.col("_band") == F.col("_tband")))
        share = F.size(F.array_intersect("_win", "_tsh")) / F.size("_tsh")
        hits = once(met.select("doc_id", "license_id", "_start", "_win", "_tsh"), _share=share).drop("_win", "_tsh").where(F.col("_share") >= contained)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("license_id"), F.lit(0).cast("long").alias("places"), F.lit(0.0).alias("containment")).where("false")
    places = found.groupBy("doc_id", "license_id", "_start").agg(F.max("_share").alias("_share"))
    return places.groupBy("doc_id", "license_id").agg(F.count("*").alias("places"), F.max("_share").alias("containment"))


def by_license(found: DataFrame, notices: DataFrame) -> DataFrame:
    """``doc_id, license, template, templates, containment`` of ``scan``'s rows: each license once, with its wordings that were found, the longest of them, and the best containment.

    Where notices have no ``license``, each wording is a license of its own.
    """
    named = notices.select("license_id", (F.col("license") if "license" in notices.columns else F.col("license_id")).alias("license"), F.size(tokens(F.col("text"))).alias("_len"))
    each = found.join(F.broadcast(named), "license_id").groupBy("doc_id", "license")
    return each.agg(F.max_by("license_id", F.struct("_len", "license_id")).alias("template"), F.collect_set("license_id").alias("templates"), F.max("containment").alias("containment"))


def digest(docs: DataFrame, notices: DataFrame) -> DataFrame:
    """For each document: ``licenses`` (the wordings found) and ``license_ids`` (what they stand for), both sorted and comma-joined, ``n_licenses`` of the latter and ``containment`` of the best."""
    f = by_license(scan(docs, notices), notices).groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.flatten(F.collect_list("templates"))), ",").alias("licenses"), F.array_join(F.sort_array(F.collect_list("license")), ",").alias("license_ids"),
        F.count("*").alias("n_licenses"), F.max("containment").alias("containment"),
    )
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return docs.select("doc_id").join(f, "doc_id", "left").select("doc_id", none("licenses"), none("license_ids"), F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), "containment")
