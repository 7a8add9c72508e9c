"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

Units of comparison are header lines (lines of the whole text that hold a licence cue) and,
for files with a licence file's name, also the whole text. Units and templates are sparse
TF-IDF vectors over words; inverse document frequencies are those of the templates, and a
word that no template has weighs as much as the rarest. A file's own licence is that of
the most similar template at ``THRESHOLD`` or above. A directory gets the licence of its
licence file; a file without one of its own inherits from the nearest directory above
it that has one.

Everything is DataFrame operations. Text is read once, and only header lines and licence
files leave the scan. Directories are resolved once each, not once for each file; their
table is joined to the files by directory, where Spark may split a directory that holds
many files.

Nulls and odd input: a null or empty text has no units; a null path is a file of the root
directory without a name; ties between templates go to the smaller licence name, between
licence files of one directory to the more similar, then the smaller licence; repeated
rows are judged one by one; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.llm.common import Scratch

THRESHOLD = 0.5

# Licence names, the wording of their usual headers, cues and file names.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)
CUE = "licen[sc]e|copyright|rights reserved|public domain|creative commons|redistribut|hereby granted|free software"
LICENCE_FILE = "^(licen[sc]e|copying|notice)([.].*)?$"
NOT_A_WORD = "[^0-9a-z\u0080-\U0010ffff]+"


def _vectors() -> list[tuple[int, str, str, float]]:
    """(template, licence, word, weight) with vectors of length 1."""
    texts = [Counter(w for w in re.split(NOT_A_WORD, text.lower()) if w) for _, text in TEMPLATES]
    frequency = Counter(w for t in texts for w in t)
    out = []
    for i, words in enumerate(texts):
        weights = {w: n * idf(frequency[w]) for w, n in words.items()}
        length = math.sqrt(sum(x * x for x in weights.values()))
        out += [(i, TEMPLATES[i][0], w, x / length) for w, x in sorted(weights.items())]
    return out


def idf(frequency: int) -> float:
    return math.log((1 + len(TEMPLATES)) / (1 + frequency)) + 1


def _literal_table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def template_table(spark: SparkSession) -> DataFrame:
    """(template, licence, word, weight): some 250 rows."""
    return _literal_table(spark, _vectors(), ("template", "licence", "word", "weight"))


def idf_table(spark: SparkSession) -> DataFrame:
    """(word, idf) of the words of the templates."""
    frequency = Counter(w for _, _, w, _ in _vectors())
    return _literal_table(spark, [(w, idf(n)) for w, n in sorted(frequency.items())], ("word", "idf"))


def _words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, NOT_A_WORD), lambda w: w != "")


def directory_of(path: Column) -> Column:
    """The path up to the last slash; empty for the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def similarities(units: DataFrame) -> DataFrame:
    """(row, licence, cosine): the best template of each row of ``units`` (row, unit, text), if it reaches the threshold."""
    spark = units.sparkSession
    words = units.select("row", "unit", F.explode(_words(F.col("text"))).alias("word")).groupBy("row", "unit", "word").agg(F.count(F.lit(1)).alias("n"))
    # Both tables are constants of this module.
    weighted = words.join(F.broadcast(idf_table(spark)), "word", "left").select(
        "row", "unit", "word", (F.col("n") * F.coalesce("idf", F.lit(idf(0)))).alias("w"), F.col("idf").isNotNull().alias("shared")
    )
    lengths = weighted.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = (
        weighted.where("shared")
        .join(F.broadcast(template_table(spark)), "word")
        .groupBy("row", "unit", "template", "licence")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    )
    cosines = dots.join(lengths, ["row", "unit"]).select("row", "licence", F.round(F.col("dot") / F.col("length"), 6).alias("cosine"))
    best = F.min(F.struct((-F.col("cosine")).alias("least"), "licence"))
    return cosines.where(F.col("cosine") >= THRESHOLD).groupBy("row").agg(best.alias("b")).select(
        "row", F.col("b.licence").alias("licence"), (-F.col("b.least")).alias("cosine")
    )


def nearest_licensed(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(directory, licence, inherited_from): the nearest of the directory and those above it that is licensed."""
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    steps = directories.select("directory", F.posexplode(F.array_distinct(above)).alias("depth", "above"))
    found = steps.join(licensed, steps["above"] == licensed["at"])
    return found.groupBy("directory").agg(F.max_by(F.struct("licence", "at"), "depth").alias("b")).select(
        "directory", F.col("b.licence").alias("inherited"), F.col("b.at").alias("inherited_from")
    )


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(``key``, ``path``, own_licence, own_cosine, licence, inherited_from) for every row of ``files``."""
    scratch = Scratch(files.sparkSession, "licences")
    whole, where = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(path), F.lit(""))
    name = F.lower(F.substring_index(where, "/", -1))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike("(?i)" + CUE))
    rows = scratch.put(
        files.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(path).alias("path"),
            directory_of(where).alias("directory"), name.rlike(LICENCE_FILE).alias("is_licence"), lines.alias("lines"),
            F.when(name.rlike(LICENCE_FILE), whole).alias("whole"),
        ),
        "files",
    )
    compared = F.when(F.col("whole").isNull(), F.col("lines")).otherwise(F.concat("lines", F.array("whole")))
    units = rows.where((F.size("lines") > 0) | F.col("is_licence")).select("row", F.posexplode(compared).alias("unit", "text"))
    own = scratch.put(similarities(units), "own")
    narrow = rows.select("row", "key", "path", "directory", "is_licence").join(own, "row", "left")
    licensed = (
        narrow.where(F.col("is_licence") & F.col("licence").isNotNull())
        .groupBy("directory")
        .agg(F.min(F.struct((-F.col("cosine")).alias("least"), "licence")).alias("b"))
        .select(F.col("directory").alias("at"), F.col("b.licence").alias("licence"))
    )
    directories = rows.select("directory").distinct()
    resolved = scratch.put(nearest_licensed(directories, licensed), "directories")
    return narrow.join(resolved, "directory", "left").select(
        F.col("key").alias(key),
        F.col("path").alias(path),
        F.col("licence").alias("own_licence"),
        F.col("cosine").alias("own_cosine"),
        F.coalesce("licence", "inherited").alias("licence"),
        F.when(F.col("licence").isNull(), F.col("inherited_from")).alias("inherited_from"),
    )
