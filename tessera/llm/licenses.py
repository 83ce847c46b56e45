"""Operator 1: licence scans. DataFrame and SQL functions only.

Every line of a file, windows of consecutive lines about as long as each template, and the file as a whole are compared
to licence templates by the cosine of sparse TF-IDF vectors, with document frequencies counted over all files. A text
reaches the threshold t with a template only if the template's terms that it holds have t squared of the template's
squared length (Cauchy-Schwarz), so files and windows that hold less are left out and nothing is lost. A file without a
licence of its own inherits that of the licence file in its nearest ancestor directory, found by joining each
directory's ancestor paths with the directories that hold one.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import let, materialise, partitions, spread, table

TERM = "[a-z0-9]+"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Licence statements, notices, titles and identifiers by SPDX name, as they stand in headers and at the top of licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *((name, f"{what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{mark2} either version {version} of the License, or (at your option) any later version.") for name, what, kind, version, mark, mark2 in (("GPL-2.0", "This program", "General Public License", "2", ";", ";"), ("LGPL-2.1", "This library", "Lesser General Public License", "2.1", ";", ";"), ("LGPL-3.0", "This library", "Lesser General Public License", "3", ":", ","), ("AGPL-3.0", "This program", "Affero General Public License", "3", ":", ","))),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "ISC", "Unlicense")),
)
#: Full texts.
TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. {_BSD_1} 2. {_BSD_2} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. {_BSD_1} 2. {_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}"),
)
#: Base names of licence files.
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)([-._].*)?$"


def terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def _weight(tf: int, idf: float) -> float:
    return (1 + math.log(tf)) * idf


def document_frequencies(files: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """(files, files that hold each term of the vocabulary), over all files; as many rows come here as the vocabulary has."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(TERM), F.lit(0))
    held = files.select(F.explode(F.concat(F.array_intersect(words, F.array(*map(F.lit, vocabulary))), F.array(F.lit("")))).alias("term"))
    got = {r["term"]: r["count"] for r in held.groupBy("term").count().collect()}
    return got.pop("", 0), got


def vectors(templates, n: int, df: dict[str, int]) -> tuple[list[dict[str, float]], dict[str, float], float]:
    """Unit template vectors, the vocabulary's idf, and that of any other term (in no file, as it were)."""
    idf = lambda t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1
    out = []
    for _, text in templates:
        v = {t: _weight(k, idf(t)) for t, k in terms(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / size for t, x in v.items()})
    return out, {t: idf(t) for v in out for t in v}, math.log(n + 1) + 1


def _literal(values: list, kind: str):
    """A literal array column; ``kind`` is the type of its elements."""
    return F.expr(f"from_json('{json.dumps(values)}', 'array<{kind}>')")  # terms are [a-z0-9]+


def _mass(words, squares, template):
    """The sum of the squared weights of a template's terms that are among ``words``: no vector with those terms alone
    has a cosine over its root (Cauchy-Schwarz)."""
    own = F.element_at(squares, template + 1)
    of = lambda held: F.aggregate(F.filter(own, lambda x: F.array_contains(held, x["term"])), F.lit(0.0), lambda a, x: a + x["w2"])
    return let(F.array_intersect(own["term"], words), of)


def license_scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", templates=TEMPLATES + TEXTS, threshold: float = 0.8) -> DataFrame:
    """(path, license, similarity, how, found_in) for each row of ``files``.

    how: header (a line or consecutive lines of the file are a licence statement), file (it is a licence file: by its base name with such
    lines, or as a whole a licence text), inherited (from found_in, the licence file of the nearest ancestor directory) or
    none (license null, similarity 0). The best template wins, ties to the earlier one; of several licence files in a
    directory the most similar, then the least path. Null text: as if empty. Null path: own licence only, nothing to
    inherit. Repeated rows give repeated rows. Other columns are ignored. An empty table gives an empty table.
    """
    spark = files.sparkSession
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({t for _, x in templates for t in terms(x)})
    n, df = document_frequencies(rows, vocabulary)
    vecs, idf, other = vectors(templates, n, df)
    words = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    weights = spark.createDataFrame([(t, i, x) for i, v in enumerate(vecs) for t, x in sorted(v.items())], "term string, template int, w double")
    squares = _literal([[{"term": t, "w2": x * x} for t, x in sorted(v.items())] for v in vecs], "array<struct<term:string,w2:double>>")
    enough, words_of = threshold * threshold * (1 - 1e-9), lambda c: F.regexp_extract_all(c, F.lit(TERM), F.lit(0))

    # files that hold enough of a template's terms, with those templates
    keyed = rows.select("path", F.xxhash64("text").alias("h"), F.lower("text").alias("t"))
    have = F.array_intersect(words_of(F.col("t")), F.array(*map(F.lit, vocabulary)))
    likely = let(have, lambda held: F.filter(F.sequence(F.lit(0), F.lit(len(vecs) - 1)), lambda i: _mass(held, squares, i) >= enough))
    some = materialise(keyed.withColumn("templates", likely).where(F.size("templates") > 0).select("path", "h", "t", "templates")).repartition(partitions(spark), "path", "h").dropDuplicates(["path", "h"])
    # a row for each line and template: the terms that it starts after, and how much of the template it holds
    lines = some.select("path", "h", "templates", F.posexplode(F.split("t", "[\\r\\n]+")).alias("i", "l")).withColumn("w", words_of(F.col("l"))).where(F.size("w") > 0).withColumn("n", F.size("w"))
    file = Window.partitionBy("path", "h").orderBy("i")
    lines = lines.withColumn("s", F.sum("n").over(file.rowsBetween(Window.unboundedPreceding, -1))).withColumn("s", F.coalesce("s", F.lit(0).cast("bigint")))
    lines = lines.select("path", "h", "s", "n", "w", F.explode("templates").alias("template")).withColumn("m", _mass(F.col("w"), squares, F.col("template")))
    # from each line on, the lines that start within the template's length: the longest window within it and the next longer
    length = F.element_at(F.array(*(F.lit(sum(terms(x).values())) for _, x in templates)), F.col("template") + 1)
    ahead = Window.partitionBy("path", "h", "template").orderBy(F.col("s") / length * 1_000_000).rangeBetween(0, 1_000_001)  # rounding apart
    lines = lines.withColumn("all", F.sum("m").over(ahead)).withColumn("ahead", F.collect_list(F.struct("s", "n", "w")).over(ahead)).where((F.col("m") > 0) & (F.col("all") >= enough))
    within = F.filter("ahead", lambda x: x["s"] + x["n"] - F.col("s") <= length)
    text = lambda a: F.flatten(F.transform(a, lambda x: x["w"]))
    spans = F.array_distinct(F.array(F.lit(1), F.size(within), F.size("ahead")))
    windows = lines.select("path", "h", "template", "s", "ahead", F.explode(spans).alias("size")).where("size > 0")
    windows = windows.select("path", "h", "template", F.concat_ws(" ", "s", "size").alias("part"), text(F.slice("ahead", F.lit(1), F.col("size"))).alias("w"))
    whole = some.select("path", "h", F.explode("templates").alias("template"), F.lit("").alias("part"), words_of(F.col("t")).alias("w"))
    parts = windows.where(_mass(F.col("w"), squares, F.col("template")) >= enough).union(whole)
    key = ["path", "h", "template", "part"]
    tf = parts.select(*key, F.explode("w").alias("term")).groupBy(*key, "term").count()
    tf = tf.join(F.broadcast(words), "term", "left").join(F.broadcast(weights), ["term", "template"], "left").select(*key, ((1 + F.log("count")) * F.coalesce("idf", F.lit(other))).alias("x"), "w")  # both come from the templates
    cos = tf.groupBy(*key).agg(F.round(F.sum(F.col("x") * F.coalesce("w", F.lit(0.0))) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 9).alias("cos")).where(F.col("cos") >= threshold)
    best = cos.groupBy("path", "h").agg(F.max(F.struct("cos", -F.col("template"))).alias("b"), F.max((F.col("part") == "")).alias("whole"))
    names = F.array(*(F.lit(k) for k, _ in templates))
    hits = materialise(best.select("path", "h", F.element_at(names, 1 - F.col("b.col2")).alias("license"), F.col("b.cos").alias("similarity"), (F.col("whole") | F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)).alias("is_file")))

    folder = lambda c: F.regexp_replace(F.regexp_extract(c, "^(.*)/[^/]*$", 1), "/+", "/")
    first = F.min(F.struct((-F.col("similarity")).alias("k"), F.col("path").alias("found_in"), "license")).alias("first")
    licensed = hits.where("is_file and path is not null").groupBy(folder("path").alias("dir")).agg(first).select("dir", "first.found_in", "first.license", (-F.col("first.k")).alias("similarity"))
    dirs = keyed.where("path is not null").select(folder("path").alias("of")).distinct()
    up = dirs.select("of", F.explode(F.expr("transform(sequence(0, size(split(of, '/'))), i -> array_join(slice(split(of, '/'), 1, i), '/'))")).alias("dir")).distinct()
    inherited = up.join(licensed, "dir").groupBy("of").agg(F.max_by(F.struct("found_in", "license", "similarity"), F.length("dir")).alias("from"))

    out = keyed.select("path", "h", folder("path").alias("of")).join(hits.withColumnRenamed("path", "p").withColumnRenamed("h", "ph"), F.col("path").eqNullSafe(F.col("p")) & (F.col("h") == F.col("ph")), "left")
    # a directory may hold a third of all files: eight copies of the small side, one for each salt
    salts = inherited.select(F.col("of").alias("o"), "from", F.explode(F.array(*map(F.lit, range(8)))).alias("salt"))
    out = out.join(salts, (F.col("of") == F.col("o")) & (F.pmod("h", F.lit(8)) == F.col("salt")), "left")
    mine = F.col("license").isNotNull()
    return out.select("path", F.coalesce("license", F.col("from.license")).alias("license"), F.coalesce("similarity", F.col("from.similarity"), F.lit(0.0)).alias("similarity"), F.when(mine & F.col("is_file"), "file").when(mine, "header").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("how"), F.coalesce(F.when(mine, F.col("path")), F.col("from.found_in")).alias("found_in"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files: source/lang/hundreds/id."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return docs.select("doc_id", "text", F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(F.floor(F.col("doc_id") / 100)), part(F.col("doc_id"))).alias("path"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``, laid out as files by source, language and id."""
    found = license_scan(document_paths(spread(table(spark, sf_dir, "documents"))))
    return found.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).try_cast("bigint")).select("doc_id", "path", "license", "similarity", "how", "found_in")
