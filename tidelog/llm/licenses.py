"""License scan: MinHash bands over text windows retrieve templates, exact containment verifies; DataFrame functions only.

Texts and templates are lower-cased words ([a-z0-9]+) in shingles of three (notices are
often shorter than five words; fewer words are one shingle). Templates of m shingles are
looked for in windows of 2m shingles that begin every m, so each run of m lies whole in
one of them. A window that holds 80 % of a template has a Jaccard similarity of at least
0.8m / 2.2m with it; with BANDS = 24 bands of one MinHash each, one of them agrees with
probability 1 - (1 - 0.36)^24 > 0.9999. Retrieved pairs are verified exactly: the share
of the template's shingles in the window is at least `least`.

A window without any of the templates' shingles can share no MinHash with them (a shared
minimum is a shared shingle), so signatures are made only for windows that hold one.

Templates are a bounded list (MOST at most), broadcast as literals and small tables.
All work is within rows, without shuffle until the matches of a document are put together.

Defined cases: null and empty texts, and texts without words, match nothing; a text that
repeats a notice counts its windows; extra columns are ignored; rows that repeat an id
are one document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import written

WIDTH, BANDS, LEAST, MOST = 3, 24, 0.8, 2000

#: Names and standard notices of common licenses.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _word_hashes(text: Column) -> Column:
    """Hashes of the words of a text; none if it has none."""
    kept = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.transform(kept, lambda w: F.xxhash64(w))


def _shingles(h: Column) -> Column:
    """Shingle hashes of an array of word hashes; up to WIDTH words: one, of all of them."""
    n = F.size(h)
    run = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: F.xxhash64(*[F.element_at(h, (i + k).cast("int")) for k in range(WIDTH)]))
    return F.when(n >= WIDTH, run).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))


def _minimum(window: Column, band: int) -> Column:
    return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(band))))


def _bands(window: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("band"), _minimum(window, b).alias("low")) for b in range(BANDS)])


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that the optimizer computes once: it doesn't merge a generated column into the expressions that use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def templates(df: DataFrame) -> DataFrame:
    """license, items (distinct shingle hashes), m of a table (license, text)."""
    items = F.array_distinct(_shingles(F.col("h")))
    return _once(df, "h", _word_hashes(F.col("text"))).select("license", items.alias("items")).withColumn("m", F.size("items")).where("m > 0")


def scan(docs: DataFrame, notices: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment (the best window's), windows (that match), word (where the best begins, from 0)."""
    spark = docs.sparkSession
    notices = NOTICES if notices is None else notices
    if not 0 < len(notices) <= MOST:
        raise ValueError(f"1 to {MOST} templates")
    known = written(templates(spark.createDataFrame(sorted(notices.items()), "license string, text string")), "license-templates")
    by_size: dict[int, set[int]] = {}
    for r in known.collect():  # MOST rows at most
        by_size.setdefault(r["m"], set()).update(r["items"])
    literal = lambda values: F.array(*[F.lit(v) for v in sorted(values)])
    every = literal(set().union(*by_size.values()))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = _once(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), "h", _word_hashes(F.col("text"))).select("doc_id", "h")
    hit = _once(hashed, "s", _shingles(F.col("h"))).select("doc_id", "s").where(F.arrays_overlap("s", every))
    hit = written(hit, "license-texts")  # texts with a template's shingle: few, and their shingles are used for each size
    sizes = F.array(*[F.struct(F.lit(m).alias("m"), literal(v).alias("items")) for m, v in sorted(by_size.items())])
    windows = (
        hit.select("doc_id", "s", F.inline(sizes))
        .where(F.arrays_overlap("s", "items"))
        .select("doc_id", "m", "items", "s", F.explode(F.sequence(F.lit(1), F.size("s"), F.col("m"))).alias("start"))
        .select("doc_id", "m", "items", (F.col("start") - 1).alias("word"), F.slice("s", F.col("start"), 2 * F.col("m")).alias("w"))
        .where(F.arrays_overlap("w", "items"))
        .select("doc_id", "m", "word", "w")
    )
    keys = known.select("license", "items", "m", F.inline(_bands(F.col("items"))))
    near = windows.select("doc_id", "m", "word", "w", F.inline(_bands(F.col("w"))))
    # At most MOST * BANDS rows are broadcast.
    met = near.join(F.broadcast(keys), ["m", "band", "low"]).select("doc_id", "license", "word", (F.size(F.array_intersect("items", "w")) / F.col("m")).alias("containment"))
    found = met.where(F.col("containment") >= least)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.count_distinct("word").cast("long").alias("windows"), F.max_by("word", F.struct("containment", -F.col("word"))).cast("long").alias("word"))
