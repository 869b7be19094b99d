"""License scans: TF-IDF cosine of passages to templates, then inheritance from the nearest directory; DataFrame functions only.

A passage is a line of a file, a paragraph of several lines (between blank lines), or the whole file, of any size. Its
vector holds each different word once (license words hardly repeat in a notice, so the term frequency is taken as
binary), weighted by its inverse document frequency over all lines of all files, whether a template has it or not. A
passage whose cosine with a template is COSINE or more carries the template's license; the best passage (then the first
license by name) decides a file's own license. A file at least half of whose words stand in such passages is a license
file and covers its directory and all below it. A file without a license of its own gets that of the nearest directory
above it that has a license file (ties: the first path).

A passage is only scored if the cosine could be reached were all its words that no template has as light as the lightest
word of all. A notice that is broken over lines within a paragraph of much other text is not found. Null and empty texts
have no license of their own but may inherit one. A null path is a file outside of all directories. Repeated rows of one
id are one file (their best passage); so are all rows without an id. Extra columns are not read. An empty table gives an
empty result. Texts and lines of any length are passages.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WorkTables, broadcast_if_small

COSINE = 0.75
#: Weights of up to so many words are sent to all executors; beyond, words are shuffled to them.
BROADCAST_WORDS = 500_000
_BETWEEN = r"[^\p{L}\p{N}.]+"

# Notices by which files declare well-known licenses, and the texts of short ones.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/."""),
]


def words_of(text: Column) -> Column:
    """Different words in lower case; a full stop stays only inside a word, as in 2.0."""
    spaced = F.regexp_replace(F.lower(text), r"\.(?![\p{L}\p{N}])", " ")
    return F.array_distinct(F.array_remove(F.split(spaced, _BETWEEN), ""))


def _once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """df with a column that is computed once a row: as a generator's output, no later filter computes it again."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def _lines(files: DataFrame) -> DataFrame:
    """id, place (counted from 1), words: one row per line."""
    lines = files.select("id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return _once(lines.select("id", (F.col("place") + 1).alias("place"), "line"), words_of(F.col("line")), "words").drop("line")


def _paragraphs(files: DataFrame) -> DataFrame:
    """id, place (counted from -1 down), words: one row per paragraph of several lines, of texts that have several paragraphs."""
    parts = files.where(F.col("text").rlike(r"\n[ \t]*\n")).select("id", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("place", "part")).where(F.trim("part").contains("\n"))
    return _once(parts.select("id", (-1 - F.col("place")).alias("place"), "part"), words_of(F.col("part")), "words").drop("part")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per file: own_license, own_score, is_license_file, directory_license, license (own, else the directory's)."""
    spark = files.sparkSession
    work = WorkTables(spark, "licenses")
    named = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    forms = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, name string, text string")
    forms = work.keep(forms.select("template", "name", words_of(F.col("text")).alias("words")))
    of_template = forms.select("template", "name", F.explode("words").alias("word"))
    vocabulary = sorted(r[0] for r in of_template.select("word").distinct().collect())  # the templates' words: a parameter's size
    # Frequencies of all words over all lines; '' counts the lines.
    frequency = work.keep(_lines(named).where(F.size("words") > 0).select(F.explode(F.concat("words", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    of_vocabulary = dict(frequency.where(F.col("word").isin(["", *vocabulary])).collect())
    n_lines = of_vocabulary.get("", 0)
    most = frequency.where("word <> ''").agg(F.max("df")).first()[0] or 1
    weight = lambda df: (math.log((1 + n_lines) / (1 + df)) + 1) ** 2
    given = {w: weight(of_vocabulary.get(w, 1)) for w in vocabulary}
    weights = spark.createDataFrame(list(given.items()), "word string, weight double")
    weighed = work.keep(of_template.join(F.broadcast(weights), "word").select("template", "name", "word", "weight"))
    norms = weighed.groupBy("template").agg(F.sum("weight").alias("norm"))
    table = F.create_map(*(F.lit(x) for pair in given.items() for x in pair)) if given else F.create_map().cast("map<string,double>")
    heavy = lambda words: F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.element_at(table, w))
    known = F.array_intersect("words", F.array(*map(F.lit, vocabulary))) if vocabulary else F.array().cast("array<string>")
    least = (COSINE - 1e-6) ** 2
    reach = [
        F.pow(heavy(F.array_intersect("known", F.array(*map(F.lit, r["words"])))), F.lit(2)) >= F.lit(least * sum(given[w] for w in r["words"])) * F.col("low")
        for r in forms.collect() if r["words"]
    ]

    def possible(passages: DataFrame) -> DataFrame:
        """Passages that may reach the cosine. No own norm is below `low`; with it the cosine can only be too high. The words of
        one template are no heavier than all known ones, and a cosine's square is no more than their share."""
        some = _once(passages, known, "known").where(F.size("known") > 0)
        some = _once(some, heavy(F.col("known")), "weight_known")
        some = some.withColumn("low", F.col("weight_known") + (F.size("words") - F.size("known")) * F.lit(weight(most))).where(F.col("weight_known") >= least * F.col("low"))
        return some.where(functools.reduce(operator.or_, reach, F.lit(False))).select("id", "place", "words")

    whole = _once(named, words_of(F.coalesce("text", F.lit(""))), "words")
    sizes = whole.groupBy("id").agg(F.min("path").alias("path"), F.max(F.size("words")).alias("n_words"))
    files = whole.select("id", F.lit(0).alias("place"), "words")
    possible = work.keep(possible(_lines(named)).union(possible(_paragraphs(named))).union(possible(files)).distinct())
    passage = ["id", "place", "words"]
    terms = possible.select(*passage, F.explode("words").alias("word"))
    needed = work.keep(terms.select("word").distinct().join(frequency, "word").select("word", F.pow(F.log(F.lit(1.0 + n_lines) / (1 + F.col("df"))) + 1, F.lit(2)).alias("weight")))
    # A whole file may have words of no line only where a full stop ends a line; such words count as rare.
    own_norm = terms.join(broadcast_if_small(needed, BROADCAST_WORDS), "word", "left").groupBy(*passage).agg(F.sum(F.coalesce("weight", F.lit(weight(1)))).alias("own_norm"))
    dots = terms.join(F.broadcast(weighed), "word").groupBy(*passage, "template", "name").agg(F.sum("weight").alias("dot"))
    scored = dots.join(own_norm, passage).join(F.broadcast(norms), "template").withColumn("n", F.size("words"))
    scored = scored.withColumn("cosine", F.least(F.lit(1.0), F.col("dot") / F.sqrt(F.col("own_norm") * F.col("norm")))).where(F.round("cosine", 9) >= COSINE)
    best = scored.groupBy("id", "place", "n").agg(F.min(F.struct((-F.round("cosine", 9)).alias("less"), "name")).alias("b"))
    own = best.groupBy("id").agg(F.min("b").alias("b"), *(F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).alias(name) for name, side in (("in_lines", F.col("place") > 0), ("in_parts", F.col("place") < 0))), F.max((F.col("place") == 0).cast("int")).alias("is_whole"))
    own = work.keep(own.select("id", F.col("b.name").alias("own_license"), (-F.col("b.less")).alias("own_score"), F.greatest("in_lines", "in_parts").alias("in_lines"), (F.col("is_whole") == 1).alias("is_whole")))
    # Rows without an id are one file, as for groups.
    listed = sizes.join(own, sizes.id.eqNullSafe(own.id), "left").drop(own.id)
    parts = F.split("path", "/")
    listed = listed.withColumn("directory", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).when(F.col("path").isNotNull(), F.lit("")))
    listed = work.keep(listed.withColumn("is_license_file", F.coalesce(F.col("is_whole") | (2 * F.col("in_lines") >= F.col("n_words")), F.lit(False))))
    covering = listed.where("is_license_file and directory is not null").groupBy("directory").agg(F.min(F.struct("path", "own_license")).alias("c")).select(F.col("directory").alias("above"), F.col("c.own_license").alias("directory_license"))
    # Directories, not files, look for their nearest licensed ancestor, so that one full directory is one row.
    folders = listed.select("directory").where("directory is not null").distinct()
    up = F.split("directory", "/")
    chains = folders.select("directory", F.explode(F.sequence(F.lit(0), F.size(up))).alias("depth")).withColumn("above", F.array_join(F.slice(up, 1, F.col("depth")), "/"))
    nearest = chains.join(covering, "above").groupBy("directory").agg(F.max_by("directory_license", "depth").alias("directory_license"))
    return listed.join(nearest, "directory", "left").select(
        F.col("id").alias(id_col), "path", "own_license", "own_score", "is_license_file", "directory_license",
        F.coalesce("own_license", "directory_license").alias("license"),
    )
