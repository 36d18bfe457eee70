"""License scans: MinHash over overlapping windows retrieves templates, exact containment verifies. [native]

Words are runs of letters and digits, A-Z lower-cased; shingles are five words. A template with m shingles
belongs to the class of the least power of two c >= m (4 at least) and is sought in windows of 2c shingles
that begin every c, so that any run of c shingles lies whole in one window. A window that holds 80 % of a
template's shingles has Jaccard similarity 0.19 with it at least; BANDS bands of one hash each miss it with
probability under 0.81 ** 64 = 1.4e-6. A retrieved template matches if at least 80 % of its distinct
shingles are in the window.

Texts and windows without any template's shingle can hold no match and are left out before hashing; that
loses nothing. Templates are broadcast, AT_ONCE of them in a pass; larger libraries take more passes. Windows
are cut inside a row, so the work on a text is linear in its length. Null, empty and short texts match nothing;
repeated rows each get their own result. A column named licenses is replaced; other columns pass through.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hidden, lower_ascii, once, shown

SHINGLE, BANDS, SHARE = 5, 64, 80
#: Templates that one pass seeks.
AT_ONCE = 1000
# Wordings of public licence notices.
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles_of(words: str) -> Column:
    """Hashes of the five-word shingles of a column of words, in order."""
    w = F.col(words)
    return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def bands_of(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))))


def class_of(n: int) -> int:
    return max(4, 1 << (n - 1).bit_length())


def scan(df: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of df with a match: its doc_id, _tm_rk and licenses (sorted array of template names).

    Rows alike in doc_id and text share one result row.
    """
    names = list(templates := TEMPLATES if templates is None else templates)
    passes = [_pass(df, {n: templates[n] for n in names[at : at + AT_ONCE]}) for at in range(0, max(1, len(names)), AT_ONCE)]
    return functools.reduce(DataFrame.unionAll, passes).groupBy("doc_id", "_tm_rk").agg(F.array_sort(F.collect_set("name")).alias("licenses"))


def _pass(df: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(doc_id, _tm_rk, name) of the matches."""
    spark = df.sparkSession
    lib = spark.createDataFrame(list(templates.items()), "name string, t string")
    lib = lib.withColumn("w", words_of(F.col("t"))).withColumn("ts", F.array_distinct(shingles_of("w"))).where("size(ts) > 0").select("name", "ts")
    known = {r["name"]: list(r["ts"]) for r in lib.collect()}
    by: dict[int, set[int]] = {}
    for ts in known.values():
        by.setdefault(class_of(len(ts)), set()).update(ts)
    literal = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)])
    rk = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))
    hashed = df.where("text is not null").select("doc_id", "text", once(words_of(F.col("text")), "w")).select("doc_id", "text", once(shingles_of("w"), "hs"))
    hashed = hashed.where(F.arrays_overlap("hs", literal({x for ts in by.values() for x in ts}))) if by else hashed.where("false")
    hashed = hashed.select("doc_id", rk.alias("_tm_rk"), "hs")
    kinds = F.array(*[F.struct(F.lit(c).alias("c"), literal(xs).alias("all")) for c, xs in sorted(by.items())]) if by else F.array().cast("array<struct<c:int,all:array<bigint>>>")
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.size("hs"), k["c"]), lambda i: F.struct(k["c"].alias("c"), F.slice("hs", i, 2 * k["c"]).alias("win")))
    met = F.flatten(F.transform(kinds, lambda k: F.filter(cut(k), lambda x: F.arrays_overlap(x["win"], k["all"]))))
    wins = hashed.select("doc_id", "_tm_rk", F.inline(met))
    wins = wins.withColumn("bands", bands_of(F.col("win"))).select("doc_id", "_tm_rk", "c", "win", F.posexplode("bands").alias("b", "v"))
    index = spark.createDataFrame([(n, class_of(len(ts)), ts) for n, ts in known.items()], "name string, c int, ts array<bigint>")
    index = index.select("name", "c", "ts", F.posexplode(bands_of(F.col("ts"))).alias("b", "v"))
    hits = wins.join(F.broadcast(index), ["c", "b", "v"]).where(100 * F.size(F.array_intersect("win", "ts")) >= SHARE * F.size("ts"))
    return hits.select("doc_id", "_tm_rk", "name").distinct()


def annotate(df: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """df with licenses: the sorted names of the templates found, empty if none."""
    found = scan(df.select("doc_id", "text"), templates).select("_tm_rk", "licenses")
    rk = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))
    out = df.select(*hidden(df), rk.alias("_tm_rk")).join(found, "_tm_rk", "left")
    return out.select(*shown(df, ("licenses",)), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))
