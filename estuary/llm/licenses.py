"""License scans with SQL functions only: MinHash bands over overlapping windows retrieve templates, exact shingle containment checks them."""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, BAND_ROWS = 32, 2
#: Windows start so many times in the length of a template.
STEPS = 4

# Names and opening words of public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
    "cc-by": "This work is licensed under a Creative Commons Attribution",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# Whole public licence notices, without their copyright line.
FULL_TEMPLATES = {
    "full-mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "full-isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "full-bsd-2": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
        OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "full-apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "full-gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/""",
    "full-unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law.""",
}

#: Notices shorter than a shingle; each counts as one shingle of its own length.
SHORT_TEMPLATES = {"all-rights-reserved": "All rights reserved."}

ALL_TEMPLATES = TEMPLATES | FULL_TEMPLATES | SHORT_TEMPLATES

SPLIT = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors(templates: dict[str, str], shingle: int, containment: float) -> dict[str, list[int]]:
    """Words of which any text with enough of a template must hold at least one, with the template lengths they stand for.

    Enough of each template's shingles hold an anchor that those without one are too few for the containment.
    Words in fewer shingles of everyday text are better, so long ones come first among equals.
    """
    words = {k: template_words(t) for k, t in templates.items()}
    shingles = {k: [set(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] for k, w in words.items()}
    need = {k: int((1 - containment) * len(s) + 1e-9) + 1 for k, s in shingles.items()}
    chosen: list[str] = []
    while open_ := {k for k, s in shingles.items() if sum(not x.isdisjoint(chosen) for x in s) < need[k]}:
        left = [w for k in open_ for s in shingles[k] if s.isdisjoint(chosen) for w in s]
        gain = Counter(w for w in left if len(w) > 4) or Counter(left)
        chosen.append(max(gain, key=lambda w: (gain[w] * len(w), w)))
    return {a: sorted({len(w) for w in words.values() if a in w}) for a in chosen}


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of `size` words; words are read by place, so the cost is linear."""
    n = F.size(words) - size + 1
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(words, i + j) for j in range(size)))))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def step_of(words: Column | int) -> Column | int:
    """Words from one window to the next, for templates of so many words."""
    return max(1, words // STEPS) if isinstance(words, int) else F.greatest(F.lit(1), F.floor(words / STEPS)).cast("int")


def _bands(shingles: Column, bands: int, rows: int) -> Column:
    """(band, sign) for each band: the hash of its rows' minima."""
    low = lambda seed: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, seed)))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(*(low(b * rows + r) for r in range(rows))).alias("sign")))


def template_table(spark: SparkSession, templates: dict[str, str], shingle: int) -> DataFrame:
    """license, words (how many), shingles (distinct hashes)."""
    rows = F.explode(F.create_map(*(F.lit(x) for k, t in templates.items() for x in (k, " ".join(template_words(t)))))).alias("license", "joined")
    split = spark.range(1).select(rows).select("license", F.split("joined", " ").alias("w"))
    return split.select("license", F.size("w").alias("words"), F.array_distinct(_shingles(F.col("w"), shingle)).alias("shingles"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, shingle: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word): the licence notices of each document.

    Words are runs of letters and digits in lower case. For a template of T words, windows start every T / STEPS words
    and are so long that any run of T words lies in one. MinHash bands of `band_rows` hashes retrieve the templates of
    each window; a pair counts if the window holds the containment of the template's distinct shingles. The best
    window is told by its containment, then its first word.

    A window that holds enough of a template has a Jaccard similarity of 0.55 with it at least, at 0.8: 32 bands of two
    rows miss one such window in 100,000, and a whole notice, in four windows or more, practically never. Only windows
    with an anchor word are hashed: others cannot reach the containment. Nothing is shuffled but the notices found.

    Templates are a parameter, their number bounds what is broadcast; one shorter than `shingle` counts as one shingle
    of its own length. Very long texts are scanned whole, in time linear in their words. Null and empty texts match
    nothing; repeated rows count as one document each; other columns are ignored, whatever their names; empty table:
    no rows.
    """
    templates = TEMPLATES if templates is None else templates
    by_size: dict[int, dict[str, str]] = {}
    for k, t in templates.items():
        by_size.setdefault(min(shingle, len(template_words(t))), {})[k] = t
    if 0 in by_size:
        raise ValueError("a template needs a word")
    parts = (_scan(docs, id_col, text_col, part, size, containment, bands, band_rows) for size, part in sorted(by_size.items(), reverse=True))
    return functools.reduce(DataFrame.unionByName, parts)


def _windows(words: Column, sizes: dict[str, list[int]]) -> Column:
    """Every window with an anchor word, as its template length times 2 ** 40 and its number."""
    lengths = F.create_map(*(x for a, ts in sizes.items() for x in (F.lit(a), F.array(*map(F.lit, ts)))))
    spots = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*sizes))

    def around(i: Column, t: Column) -> Column:
        step = step_of(t)
        first = F.greatest(F.lit(0), F.ceil((i - t - step + 2) / step))
        numbers = F.sequence(first.cast("long"), F.floor(i / step).cast("long"))
        return F.transform(numbers, lambda k: F.shiftleft(t.cast("long"), 40) + k)

    each = F.transform(spots, lambda i: F.flatten(F.transform(F.element_at(lengths, F.get(words, i)), lambda t: around(i, t))))
    return F.when(F.size(words) > 0, F.array_distinct(F.flatten(each)))


def _scan(docs: DataFrame, id_col: str, text_col: str, templates: dict[str, str], shingle: int, containment: float, bands: int, band_rows: int) -> DataFrame:
    """scan() for templates of at least `shingle` words."""
    known = template_table(docs.sparkSession, templates, shingle)  # a fixed list: small by construction
    sizes = anchors(templates, shingle, containment)
    lower = F.lower(F.col("text"))
    holds = functools.reduce(operator.or_, (lower.contains(word) for word in sizes))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(holds)
    words = F.filter(F.split(lower, SPLIT), lambda w: w != "")
    split = source.select("id", F.monotonically_increasing_id().alias("row"), words.alias("w"))
    base = split.select("id", "row", _windows(F.col("w"), sizes).alias("windows"), _shingles(F.col("w"), shingle).alias("shingles"))
    each = base.select("id", "row", "shingles", F.explode("windows").alias("window"))
    placed = each.select("id", "row", "shingles", F.shiftright("window", 40).cast("int").alias("words"), F.col("window").bitwiseAND((1 << 40) - 1).cast("int").alias("k"))
    step = step_of(F.col("words"))
    held = F.slice("shingles", F.col("k") * step + 1, F.col("words") + step - shingle)
    cut = placed.where(F.col("k") * step < F.size("shingles")).select("id", "row", "words", "k", held.alias("held"))
    ours = F.broadcast(known.select("license", "words", F.col("shingles").alias("wanted"), F.explode(_bands(F.col("shingles"), bands, band_rows)).alias("b")).select("license", "words", "wanted", "b.band", "b.sign"))
    met = cut.select("*", F.explode(_bands(F.col("held"), bands, band_rows)).alias("b")).select("id", "row", "words", "k", "held", "b.band", "b.sign").join(ours, ["words", "band", "sign"])
    share = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
    pairs = met.withColumn("containment", share).where(F.col("containment") >= containment - 1e-9)
    best = F.max(F.struct("containment", (-F.col("k") * step).alias("back"))).alias("best")
    out = pairs.select("id", "row", "license", "containment", "k", "words").distinct().groupBy("id", "row", "license").agg(best, F.count("*").alias("n_windows"))
    return out.select(F.col("id").alias("doc_id"), "license", F.round("best.containment", 6).alias("containment"), "n_windows", (-F.col("best.back")).cast("long").alias("first_word"))


def oracle(templates: dict[str, str] = TEMPLATES, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for scan() over documents: every window's containment, without bands."""
    rows = ", ".join(f"('{k}', '{' '.join(template_words(t))}')" for k, t in templates.items())
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(shingle))
    return f"""
WITH t AS (SELECT license, string_split(joined, ' ') AS w FROM (VALUES {rows}) v(license, joined)),
ts AS (SELECT DISTINCT license, words, greatest(1, words // {STEPS}) AS step, gram FROM (
  SELECT license, len(w) AS words, unnest([{gram} for i in range(1, len(w) - {shingle - 2})]) AS gram FROM t)),
d AS (SELECT doc_id, row_number() OVER () AS r, [x for x in regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] AS w FROM documents),
g AS (SELECT doc_id, r, unnest([{gram} for i in range(1, len(w) - {shingle - 2})]) AS gram, unnest(range(0, len(w) - {shingle - 1})) AS pos FROM d WHERE len(w) >= {shingle}),
hit AS (SELECT g.doc_id, g.r, g.pos, g.gram, ts.license, ts.words, ts.step FROM g JOIN ts USING (gram)),
win AS (SELECT doc_id, r, license, step, gram, unnest(range(greatest(0, (pos + {shingle} - words) // step), pos // step + 1)) AS k, pos, words FROM hit),
share AS (SELECT doc_id, r, license, step, k, count(DISTINCT gram) AS n FROM win
  WHERE k * step <= pos AND pos + {shingle} <= k * step + words + step - 1 GROUP BY ALL),
good AS (SELECT s.*, n / m AS containment FROM share s JOIN (SELECT license, count(*) AS m FROM ts GROUP BY 1) USING (license) WHERE n / m >= {containment} - 1e-9)
SELECT doc_id, license, round(max(containment), 6) AS containment, count(*) AS n_windows,
  arg_min(k * step, (-containment, k)) AS first_word
FROM good GROUP BY doc_id, r, license
"""


def oracle_of_all() -> str:
    """DuckDB SQL for scan() with all lists: oracle() for each length of shingle."""
    sizes = sorted({min(SHINGLE, len(template_words(t))) for t in ALL_TEMPLATES.values()})
    parts = [oracle({k: t for k, t in ALL_TEMPLATES.items() if min(SHINGLE, len(template_words(t))) == n}, n) for n in sizes]
    return " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in parts)
