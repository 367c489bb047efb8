"""License scan: MinHash bands over overlapping windows, then exact containment.

Templates are grouped in classes by length: a class's windows have the least
power of two of word shingles that holds its templates, and start every quarter
of that.  A passage with 0.8 of a template's shingles then shares at least 0.36
(Jaccard) with some window, and with BANDS bands of one minimum each the chance
that no band meets is at most 0.64 ** 16, less than one in a thousand; an unedited
passage meets in nearly every band.  A template that a band retrieves is verified
by the exact share of its shingles in the window and a quarter on either side.  Where
templates overlap, as those of sibling licenses do, each place goes to the one that
is contained best, and a template that wins less than half of its places is left out.

A window's minimum can equal a template's only if the window has that very
shingle, so minima are computed only for windows around such shingles; the result
is that of computing them for all windows.

All work is in DataFrame and SQL functions.  Templates are a bounded, broadcast
table.

Defined cases: null, empty and short texts (under five words) have no shingles
and no licenses; a template needs five words at least; rows that repeat a doc_id
are reported once for each template, with the best window; ties go to the first
window; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import documents

SHINGLE = 5
BANDS = 16
MIN_CONTAINMENT = 0.8

_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS '
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."
)
_GNU_SHORT = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version."
)

#: License, then the wording of a text, notice or grant.  A wording of under ten words has so few
#: shingles that each must be there; its usual variants are listed instead.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", _BSD + _DISCLAIMER),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _DISCLAIMER),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "The author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("AGPL-3.0-or-later", _GNU.format(name="Affero", version="3")),
    ("AGPL-3.0-or-later", _GNU_SHORT.format(name="Affero", version="3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", _GNU.format(name="", version="2")),
    ("GPL-2.0-or-later", _GNU_SHORT.format(name="", version="2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", _GNU.format(name="", version="3")),
    ("GPL-3.0-or-later", _GNU_SHORT.format(name="", version="3")),
    ("LGPL-2.1-or-later", _GNU.format(name="Lesser", version="2.1").replace("program", "library")),
    ("LGPL-2.1-or-later", _GNU_SHORT.format(name="Lesser", version="2.1").replace("program", "library")),
    ("LGPL-3.0-or-later", _GNU.format(name="Lesser", version="3")),
    ("LGPL-3.0-or-later", _GNU_SHORT.format(name="Lesser", version="3")),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
]


def shingles(text: str) -> F.Column:
    """Hashes of all word shingles of the text column, in order; words are runs of letters and digits in lower case."""
    more = ", ".join(f"get(w, i + {k})" for k in range(1, SHINGLE))
    return F.expr(
        rf"""transform(array(filter(split(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' '), ' '), x -> x <> '')), w ->
          if(size(w) < {SHINGLE}, cast(array() as array<bigint>), transform(slice(w, 1, size(w) - {SHINGLE - 1}), (x, i) -> xxhash64(x, {more}))))[0]"""
    )


def _minimum(values: str) -> str:
    """SQL for (minimum, its shingle) of band j over the array ``values``."""
    return f"array_min(transform({values}, x -> struct(xxhash64(x, j) as m, x as x)))"


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template, license, wording's shingles ts, window size."""
    t = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, wording string")
    t = t.select("template", "license", shingles("wording").alias("ts")).withColumn("n", F.size("ts"))
    t = t.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("a license template needs five words"))))
    return t.withColumn("window", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")).drop("n")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """doc_id, license, template, containment, first_word (of the best window), n_windows."""
    table = template_table(docs.sparkSession, templates)
    bands = table.selectExpr("template", "window", f"explode(sequence(0, {BANDS - 1})) as j", "ts").selectExpr("template", "window as b_window", "j as b_j", f"{_minimum('ts')} as b")
    bands = bands.select("template", "b_window", "b_j", F.col("b.m").alias("b_m"), F.col("b.x").alias("b_x"))
    keys = bands.select(F.col("b_window").alias("k_window"), F.col("b_x").alias("k_x")).distinct()
    # A few hundred values at most: BANDS for each template.
    minima = F.array(*[F.lit(r["k_x"]) for r in keys.select("k_x").distinct().orderBy("k_x").collect()])
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).select("doc_id", F.xxhash64("t").alias("of"), shingles("t").alias("sh")).where(F.arrays_overlap("sh", minima))
    at = d.select("doc_id", "of", "sh", F.posexplode("sh").alias("pos", "x")).join(F.broadcast(keys), F.col("x") == F.col("k_x"))
    starts = at.selectExpr(
        "doc_id", "of", "sh", "k_window as window", "greatest(1, k_window div 4) as stride", "pos",
    ).selectExpr(
        "doc_id", "of", "sh", "window", "stride",
        "explode(sequence(cast(greatest(0, (pos - window) div stride + 1) * stride as int), cast(pos div stride * stride as int), cast(stride as int))) as start",
    ).where("start >= 0")
    # One row for each window and template, however many minima and bands led to it.
    wide = starts.select(
        "doc_id", "of", "window", "start", F.expr("slice(sh, start + 1, window)").alias("win"), F.expr("cast(greatest(0, start - stride) as int)").alias("from"),
        F.expr("slice(sh, cast(greatest(0, start - stride) + 1 as int), cast(window + 2 * stride as int))").alias("around"),
    )
    found = (
        wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("j"))
        .selectExpr("doc_id", "of", "window", "start", "from", "around", "j", f"{_minimum('win')}.m as m")
        .join(F.broadcast(bands), (F.col("window") == F.col("b_window")) & (F.col("j") == F.col("b_j")) & (F.col("m") == F.col("b_m")))
        .join(F.broadcast(table.select(F.col("template").alias("t_template"), "license", "ts")), F.col("template") == F.col("t_template"))
        .select(
            "doc_id", "of", "license", "template", "start", F.size(F.array_distinct("ts")).alias("n"), (F.size(F.array_intersect("around", "ts")) / F.size(F.array_distinct("ts"))).alias("containment"),
            F.expr("filter(transform(around, (x, i) -> if(array_contains(ts, x), from + i, null)), p -> p is not null)").alias("places"),
        )
        .where(F.col("containment") >= min_containment)
        .groupBy("doc_id", "of", "template", "start").agg(F.first("license").alias("license"), F.max("n").alias("n"), F.max("containment").alias("containment"), F.first("places").alias("places"))
    )
    # A place goes to the template that is contained best, of equals the longest; siblings that win few of their places are left out.
    claims = found.select("doc_id", "of", "template", "start", "license", "containment", "n", F.explode("places").alias("place"))
    best = Window.partitionBy("doc_id", "of", "place").orderBy(F.col("containment").desc(), F.col("n").desc(), "template")
    won = claims.withColumn("wins", (F.first("license").over(best) == F.col("license")).cast("int"))
    return (
        won.groupBy("doc_id", "of", "template", "start").agg(F.first("license").alias("license"), F.max("containment").alias("containment"), F.avg("wins").alias("won"))
        .where("won >= 0.5")
        .groupBy("doc_id", "template").agg(
            F.first("license").alias("license"), F.max("containment").alias("containment"),
            F.min_by("start", F.struct((-F.col("containment")).alias("c"), "start")).alias("first_word"), F.count("*").alias("n_windows"),
        )
        .select("doc_id", "license", "template", "containment", F.col("first_word").cast("long").alias("first_word"), "n_windows")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
