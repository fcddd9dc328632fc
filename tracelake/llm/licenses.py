"""License scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance along directories.

DataFrame operations only. The vector space has the words of the templates without STOP words; every other word of a text
is a term seen nowhere else, so it lengthens the vector without matching. Document frequencies of the template words are
counted over all texts.

* Headers: each window of a text that begins with a word of a notice and has as many words as it (from its first to its last
  that isn't in STOP) is compared with the notice, wherever it stands and however its lines are broken.
* Licence files (by name): the vector of the whole text is compared with the templates of whole licences, too.

A text is only looked at if it holds an anchor of some template: words that weigh so much that without any of them the cosine
can't reach the threshold. Windows and cosines are array expressions inside the row, so no row meets another one here.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, whole_text, written

#: License id and a short notice or title in the words commonly used; several rows may stand for one license.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
]
#: Fixed texts of whole licences, for licence files.
LICENSE_TEXTS = [
    (
        "MIT",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
        "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
]
STOP = set("the of and to in is a any this that are with or into for by on as be without use all form source person work code".split())
THRESHOLD = 0.8
NO_WORD = r"[^\p{L}\p{N}]+"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.\-_][^/]*)?$"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def terms_of(text: str) -> list[str]:
    return [w for w in words_of(text) if w not in STOP]


def width_of(notice: str) -> int:
    """Words from the first to the last that isn't in STOP."""
    at = [i for i, w in enumerate(words_of(notice)) if w not in STOP]
    return at[-1] - at[0] + 1 if at else 0


def vocabulary(templates) -> list[str]:
    return sorted({w for _, t in templates for w in terms_of(t)})


def _strings(words) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def _words(text: str = "_t") -> Column:
    return F.array_remove(F.split(F.lower(text), NO_WORD), "")


def frequencies(files: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each of the (fixed, few) words, by grouped counts; one row per word comes back."""
    found = files.select(F.explode(F.array_append(F.array_intersect(_words(), _strings(words)), F.lit(""))).alias("w"))
    count = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return count.pop("", 0), {w: count.get(w, 0) for w in words}


def weighted(template: str, idf: dict[str, float]) -> dict[str, float]:
    """The template's unit vector."""
    counts = Counter(terms_of(template))
    length = math.sqrt(sum((c * idf[w]) ** 2 for w, c in counts.items()))
    return {w: c * idf[w] / length for w, c in counts.items()}


def anchors(share: dict[str, float], threshold: float) -> list[str]:
    """The heaviest terms, so many that the others alone stay below the threshold: a cosine is at most the length of the part of
    the template's vector that the text has words of."""
    left, out = 1.0, []
    for w in sorted(share, key=lambda w: (-share[w], w)):
        if left < threshold**2 - 1e-9:
            break
        out.append(w)
        left -= share[w] ** 2
    return out


def _cosine(words: Column, shares: Column, idf: Column, alone: float) -> Column:
    """Cosine of an array of words to a template (map from term to share). Terms with a weight count by their numbers, others each by itself."""
    kept = F.filter(words, lambda w: ~F.array_contains(_strings(sorted(STOP)), w))
    known = F.filter(kept, lambda w: F.map_contains_key(idf, w))
    weights = F.transform(F.array_distinct(known), lambda w: F.struct(w.alias("w"), (F.size(F.filter(known, lambda y: y == w)) * F.element_at(idf, w)).alias("x")))
    add = lambda of: lambda a, p: a + of(p)
    dot = F.aggregate(weights, F.lit(0.0), add(lambda p: p["x"] * F.coalesce(F.try_element_at(shares, p["w"]), F.lit(0.0))))
    square = F.aggregate(weights, F.lit(0.0), add(lambda p: p["x"] * p["x"])) + (F.size(kept) - F.size(known)) * F.lit(alone**2)
    return F.when(square > 0, dot / F.sqrt(square)).otherwise(0.0)


def scores(rows: DataFrame, templates, whole, threshold: float) -> Column:
    """The best (negative score, license) of a text, or null: over the windows of its words, and for licence files over all its words."""
    words = vocabulary([*templates, *whole])
    n, df = frequencies(rows, words)
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in words}
    alone = math.log(1 + n) + 1
    weight = F.create_map(*(F.lit(x) for w in words for x in (w, idf[w])))
    table = lambda share: F.create_map(*(F.lit(x) for w, y in share.items() for x in (w, y)))
    pair = lambda score, license_: F.struct((-F.round(score, 9)).alias("negative"), license_.alias("license"))

    shares = [(license_, width_of(t), weighted(t, idf)) for license_, t in templates]
    longest = max((n for _, n, _ in shares), default=1)
    given = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(n).alias("width"), table(x).alias("share")) for k, n, x in shares))
    first = _strings(sorted({w for _, _, x in shares for w in x}))
    at = F.filter(F.sequence(F.lit(1), F.size("_words")), lambda i: F.array_contains(first, F.element_at("_words", i)))
    windows = F.transform(at, lambda i: F.slice("_words", i, longest))
    one = lambda w: F.transform(
        F.filter(given, lambda t: F.map_contains_key(t["share"], w[0])), lambda t: pair(_cosine(F.slice(w, F.lit(1), t["width"]), t["share"], weight, alone), t["license"])
    )
    heads = F.array_min(F.flatten(F.transform(windows, one)))
    any_anchor = sorted({w for _, _, x in shares for w in anchors(x, threshold)})
    best = F.when(F.arrays_overlap("_words", _strings(any_anchor)), heads)

    # A whole licence: so many of its heaviest terms at least must be there.
    files = [(k, weighted(t, idf)) for k, t in whole]
    least = min((next(i for i in range(1, len(x) + 1) if sum(sorted((y * y for y in x.values()), reverse=True)[:i]) >= threshold**2 - 1e-9) for _, x in files), default=0)
    if files:
        all_ = F.array(*(F.struct(F.lit(k).alias("license"), table(x).alias("share")) for k, x in files))
        enough = F.col("_path").rlike(LICENSE_FILE) & (F.size(F.array_intersect("_words", _strings(sorted({w for _, x in files for w in x})))) >= least)
        best = F.least(best, F.when(enough, F.array_min(F.transform(all_, lambda t: pair(_cosine(F.col("_words"), t["share"], weight, alone), t["license"])))))
    return F.when(-best["negative"] >= threshold, best)


def scan(files: DataFrame, path: str = "path", text: str = "text", id_: str = "doc_id", templates=TEMPLATES, whole=LICENSE_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, origin, license_path of each row of ``files``.

    A text has the license of the window with the highest cosine to a notice (``templates``), or of the whole text's to a whole
    licence (``whole``) if it is a licence file by its base name; the score must reach ``threshold`` (ties: the first license by
    name). Origin is then ``file`` for a licence file and ``header`` otherwise. A text without
    one takes that of the nearest directory above it that holds a license file with one (the highest score, then the first
    path), as ``inherited``; else origin is ``none`` and license, score and license_path are null. Null and empty texts can
    only inherit; a null path has no directories. Texts of any length are looked at whole; each row is scored by itself, repeated
    ones alike. Other columns are left out. No rows give no rows.
    """
    rows = files.select(F.col(id_).alias("_id"), F.col(path).cast("string").alias("_path"), whole_text(text).alias("_t"))
    best = scores(rows, templates, whole, threshold)
    found = rows.select("_id", "_path", _words().alias("_words")).select("_id", "_path", best.alias("b"))
    marked = written(found.select("_id", "_path", F.col("b.license").alias("license"), (-F.col("b.negative")).alias("score")))

    is_file = F.col("_path").rlike(LICENSE_FILE)
    folder = F.regexp_replace("_path", r"/?[^/]*$", "")
    holders = marked.where(is_file & F.col("license").isNotNull()).groupBy(folder.alias("_dir")).agg(F.min(F.struct((-F.col("score")).alias("negative"), F.col("_path").alias("license_path"), "license")).alias("h"))
    # Directories are far fewer than files: each finds its nearest holder once.
    dirs = marked.where("license is null and _path is not null").select(folder.alias("_own")).distinct()
    steps = F.split("_own", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    nearest = dirs.select("_own", F.explode(F.array_distinct(above)).alias("_dir")).join(holders, "_dir").groupBy("_own").agg(F.max_by("h", F.length("_dir")).alias("h"))
    missing = marked.where("license is null").withColumn("_own", folder).join(nearest, "_own", "left")
    with_own = marked.where("license is not null").select("_id", "_path", "license", "score", F.when(is_file, "file").otherwise("header").alias("origin"), F.col("_path").alias("license_path"))
    inherited = missing.select("_id", "_path", F.col("h.license").alias("license"), (-F.col("h.negative")).alias("score"), F.when(F.col("h").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("h.license_path").alias("license_path"))
    return with_own.unionByName(inherited).select(F.col("_id").alias("doc_id"), F.col("_path").alias("path"), "license", F.round("score", 6).alias("score"), "origin", "license_path")


def document_paths(docs: DataFrame) -> DataFrame:
    """A path for each document, whose table has none: source / thousands / hundreds / name. Ids ending in 00 to 04 stand for
    the license files of the hundred, those ending in 500 for the license file of the thousand."""
    i, source = F.col("doc_id"), F.coalesce(F.col("source"), F.lit("unknown"))
    thousand, hundred = F.floor(i / 1000), F.floor(F.pmod(i, F.lit(1000)) / 100)
    name = F.when(F.pmod(i, F.lit(100)) < 5, F.concat(F.lit("LICENSE."), i)).otherwise(F.concat(F.lit("doc"), i, F.lit(".txt")))
    deep = F.when(F.pmod(i, F.lit(1000)) == 500, F.concat_ws("/", source, thousand, name)).otherwise(F.concat_ws("/", source, thousand, hundred, name))
    return docs.withColumn("path", F.when(i.isNotNull(), deep))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_paths(read(spark, sf_dir, "documents")))


QUERIES = {"op1_license_scan": op1_license_scan}
