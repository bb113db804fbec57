"""License scans, in DataFrame functions only: MinHash bands over overlapping windows, then exact shingle containment.

Templates are sorted into length classes L (powers of two). A document is cut into windows of 2L words every L words, so
each occurrence of a template of the class lies whole in one window. Window and template share a band when the smallest of
their shingle hashes under that band's hash function is the same; with 64 bands of one row each, a window that holds a
template, and so shares at least a sixth of its shingles with it, is retrieved with probability above 1 - 1e-5.
Only windows that hold a shingle some template band rests on can share a band; others are passed over unhashed. A
retrieved window is verified by the exact share of the template's shingles it holds.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwise.llm.sketch import shingle_hashes

# License notices and texts, by name.
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at"
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation"
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met"
    ),
    # Siblings that differ in a name or version are short: one differing shingle keeps them under the containment.
    "mit-name": "under the MIT License",
    "isc": "under the ISC License",
    "0bsd": "under the 0BSD License",
    "zlib": "under the zlib License",
    "bsd-2-clause": "BSD 2-Clause License",
    "bsd-3-clause": "BSD 3-Clause License",
    "bsl-1.0": "Boost Software License, Version 1.0",
    "mpl-1.1": "Mozilla Public License, Version 1.1",
    "mpl-2.0": "Mozilla Public License, Version 2.0",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at"
    ),
    "epl-1.0": "Eclipse Public License, Version 1.0",
    "epl-2.0": "Eclipse Public License, Version 2.0",
    "gpl-2.0": "GNU General Public License, version 2",
    "gpl-3.0-name": "GNU General Public License, version 3",
    "gpl-2.0-short": "GNU General Public License v2.0",
    "gpl-3.0-short": "GNU General Public License v3.0",
    "lgpl-2.1": "Lesser General Public License, version 2.1",
    "lgpl-3.0": "Lesser General Public License, version 3",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-3.0": "Affero General Public License, version 3",
    "agpl-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "artistic-2.0": "Artistic License, Version 2.0",
    "gfdl-1.3": "GNU Free Documentation License, Version 1.3",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-1.0": "CC0 1.0 Universal",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-3.0": "Licensed under CC BY-SA 3.0.",
    "cc-by-3.0": "Licensed under CC BY 3.0.",
    "cc-by-4.0-name": "Creative Commons Attribution 4.0 International",
    "cc-by-sa-4.0-name": "Creative Commons Attribution-ShareAlike 4.0 International",
    "cc-by-nc-4.0-name": "Creative Commons Attribution-NonCommercial 4.0 International",
}
# Whole texts of common licenses.
TEMPLATES |= {f"{p.stem}-text": p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
SHINGLE = 3
BANDS = 64
CONTAINMENT = 0.8
#: Words of all templates together; this bounds the constants and the broadcast.
MOST_WORDS = 200_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _band_keys(hashes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """License, length class, distinct shingle hashes and band keys of each template."""
    rows = spark.createDataFrame(sorted((k, t) for k, t in templates.items() if any(map(str.isalnum, t))), "license string, text string")
    # Each step is collected, else the optimizer puts it into the lambdas of the next one and it runs for every word.
    rows = spark.createDataFrame(rows.select("license", word_list(F.col("text")).alias("words")).collect(), "license string, words array<string>")
    length = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.size("words"), F.lit(4))))).cast("int")
    shingles = F.array_distinct(shingle_hashes(F.col("words"), SHINGLE))
    rows = rows.select("license", length.alias("length"), shingles.alias("shingles"), F.size("words").alias("n_words"))
    rows = spark.createDataFrame(rows.collect(), "license string, length int, shingles array<bigint>, n_words int")
    return rows.withColumn("keys", _band_keys(F.col("shingles")))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each occurrence: ``doc_id``, ``license``, ``word_start``, ``word_end`` (exclusive), ``containment``.

    Words are lower-cased runs of letters and digits. Occurrences of one template that touch or overlap, and repeats of it
    within a window, are one row with the highest containment. Templates of fewer than three words are matched as a whole
    only in texts that hold nothing else. Null and empty texts hold none; rows that repeat doc_id and text are reported
    once; a null doc_id is reported as such. Templates are a list of the caller's, of bounded size.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.split()) for t in templates.values()) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    known = template_table(docs.sparkSession, templates)
    # The shingles that some band's smallest hash comes from.
    bases = known.select("length", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda j: F.array_min(F.transform("shingles", lambda h: F.struct(F.xxhash64(h, j).alias("key"), h.alias("shingle"))))["shingle"],
    )).alias("shingle")).distinct().collect()
    anchors = sorted({r.shingle for r in bases})
    of_class = {n: sorted(r.shingle for r in bases if r.length == n) for n in {r.length for r in bases}}
    lengths = sorted(of_class)
    out = "doc_id", "license", "word_start", "word_end", "containment"
    bands = known.select(
        "license", "length", F.posexplode("keys").alias("band", "key")
    )
    wanted = known.select("license", F.col("shingles").alias("wanted"))
    df = docs.select("doc_id", F.xxhash64("text").alias("__hash"), word_list(F.col("text")).alias("__words"))
    df = df.withColumn("__shingles", shingle_hashes(F.col("__words"), SHINGLE)).drop("__words")
    df = df.withColumn("__at", F.filter(
        F.transform("__shingles", lambda h, i: F.when(h.isin(anchors) if anchors else F.lit(False), F.struct(i.alias("i"), h.alias("h")))),
        lambda a: a.isNotNull(),
    ))

    def around(length: int) -> Column:
        k = F.transform(F.filter("__at", lambda a: a["h"].isin(of_class[length])), lambda a: F.floor(a["i"] / length).cast("int"))
        both = F.array_distinct(F.concat(k, F.transform(k, lambda x: F.greatest(x - 1, F.lit(0)))))
        return F.transform(both, lambda x: F.struct(F.lit(length).alias("length"), x.alias("k")))

    places = F.concat(*map(around, lengths)) if lengths else F.array().cast("array<struct<length:int,k:int>>")
    # Rows without places go with explode; a filter on a computed column would be pushed down and compute it twice.
    df = df.withColumn("__place", F.explode(places)).withColumns({"length": F.col("__place.length"), "__k": F.col("__place.k")})
    windows = df.select("doc_id", "__hash", "length", (F.col("__k") * F.col("length")).alias("__from"), F.slice(
        "__shingles", F.col("__k") * F.col("length") + 1, F.greatest(2 * F.col("length") - SHINGLE + 1, F.lit(1))
    ).alias("__window"))
    keyed = windows.select("*", F.posexplode(_band_keys(F.col("__window"))).alias("band", "key"))
    # A window meets a template in many bands, and is compared with it once.
    met = keyed.join(F.broadcast(bands), ["length", "band", "key"]).groupBy("doc_id", "__hash", "length", "__from", "license").agg(
        F.first("__window").alias("__window")
    ).join(F.broadcast(wanted), "license")
    share = F.size(F.array_intersect("wanted", "__window")) / F.size("wanted")
    at = F.filter(F.transform("__window", lambda h, i: F.when(F.array_contains(F.col("wanted"), h), i)), lambda i: i.isNotNull())
    met = met.withColumn("containment", share).where(F.col("containment") >= containment).withColumn("__hits", at)
    met = met.select("doc_id", "__hash", "license", "containment", (F.col("__from") + F.array_min("__hits")).alias("word_start"),
                     (F.col("__from") + F.array_max("__hits") + SHINGLE).alias("word_end")).distinct()
    # Overlapping windows see one occurrence twice.
    key = W.partitionBy("doc_id", "__hash", "license").orderBy("word_start", "word_end")
    met = met.withColumn("__reach", F.max("word_end").over(key.rowsBetween(W.unboundedPreceding, -1)))
    met = met.withColumn("__run", F.sum(F.when(F.col("word_start") < F.col("__reach"), 0).otherwise(1)).over(key.rowsBetween(W.unboundedPreceding, 0)))
    return met.groupBy("doc_id", "__hash", "license", "__run").agg(
        F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end"), F.max("containment").alias("containment")
    ).select(*out)
