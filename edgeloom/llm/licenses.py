"""License scan: MinHash bands retrieve templates for overlapping windows, shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 24
CONTAINMENT = 0.8
#: Public notices, fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def scan_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """A hash for each n consecutive words; fewer words: none."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(words[i + k] for k in range(n))))).otherwise(F.array().cast("array<bigint>"))


def band_minima(hashes: Column, bands: int) -> Column:
    """For each band the least value of its own rehash, with the shingle that has it."""

    def rehashed(band: int):
        return lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("v"), x.alias("h"))

    return F.array(*(F.array_min(F.transform(hashes, rehashed(b))) for b in range(bands)))


def license_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """``(id, license, template, window, first_word, n_words, containment)`` for each window that holds a template.

    For a template of n shingles, windows of 2n shingles begin at every n-th one, so a passage as long as the template lies
    whole in one of them.  A band is one MinHash value.  A window that holds ``containment`` of a template shares at least
    0.8 n of at most 2.2 n shingles; 24 bands then miss it with a probability below 0.001 %.  A band can agree only if the
    window holds the very shingle that is the template's least one in that band, so windows without such a shingle are passed
    over before their bands are computed.  Candidates are verified by the exact share of the template's shingles they hold.

    Null and empty texts and texts under five words hold no template; repeated rows are scanned each; null ids stay; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    t = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    t = t.withColumn("words", scan_words(F.col("text")))
    known = [r for r in t.select("template", "license", F.array_distinct(shingle_hashes(F.col("words"))).alias("h")).withColumn("m", band_minima(F.col("h"), bands)).collect() if r["h"]]
    longs = lambda xs: F.lit([int(x) for x in xs]).cast("array<bigint>")
    list_of = F.array(*(F.struct(F.lit(r["template"]).alias("template"), F.lit(r["license"]).alias("license"), F.lit(len(r["h"])).alias("n"), longs(r["h"]).alias("set"), longs(x["v"] for x in r["m"]).alias("bands"), longs({x["h"] for x in r["m"]}).alias("least")) for r in known))
    least = longs(sorted({x["h"] for r in known for x in r["m"]}))
    # the two generators keep the optimizer from copying words and hashes into what reads them again and again
    d = docs.select(F.col(id_col).alias("id"), F.explode(F.array(scan_words(F.coalesce(F.col(text_col), F.lit(""))))).alias("words"))
    d = d.select("id", F.explode(F.array(shingle_hashes(F.col("words")))).alias("h"))
    d = d.filter(F.arrays_overlap("h", least)).select("id", "h", F.explode(list_of).alias("t"))
    d = d.filter(F.arrays_overlap("h", "t.least"))
    hits = F.expr("filter(sequence(0, size(h) - 1), i -> array_contains(t.least, h[i]))")
    d = d.withColumn("k", F.explode(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array((i / F.col("t.n")).cast("int"), F.greatest((i / F.col("t.n")).cast("int") - 1, F.lit(0))))))))
    d = d.select("id", "t", "k", F.expr("slice(h, k * t.n + 1, 2 * t.n)").alias("w"))
    d = d.withColumn("bands", F.transform(band_minima(F.col("w"), bands), lambda x: x["v"]))
    d = d.filter(F.exists(F.zip_with("bands", "t.bands", lambda a, b: a == b), lambda x: x))
    share = F.size(F.array_intersect("w", "t.set")) / F.col("t.n")
    first = F.expr("array_min(filter(sequence(0, size(w) - 1), i -> array_contains(t.set, w[i])))")
    last = F.expr("array_max(filter(sequence(0, size(w) - 1), i -> array_contains(t.set, w[i])))")
    d = d.withColumn("containment", share).filter(F.col("containment") >= containment)
    return d.select("id", "t.license", "t.template", F.col("k").alias("window"), (F.col("k") * F.col("t.n") + first).cast("long").alias("first_word"), (last - first + SHINGLE).cast("long").alias("n_words"), "containment")


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, license, containment, first_word)``: the best window of each document and license."""
    w = license_windows(docs, id_col, text_col, **options)
    best = w.groupBy("id", "license").agg(F.max(F.struct("containment", -F.col("first_word"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "license", F.round("b.containment", 6).alias("containment"), (-F.col("b.col2")).alias("first_word"))
