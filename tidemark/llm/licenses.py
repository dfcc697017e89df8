"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor
directory. DataFrame functions only.

A file's units are its paragraphs, lines and sentences that hold a cue (licence, copyright, redistribute ...), over the whole text, and
the whole of a file that is named like a licence file. Units are hashed and each distinct one is scored once, however many files repeat
it: its terms, weighted (1 + ln tf) idf, are joined with those of the templates, a table of fixed size, and summed up to cosines. The
best template from ``LEAST`` on is the unit's licence; the best unit's is the file's. A file named like a licence file, or all of whose text
is one matching unit, licenses its directory. A file without a licence of its own takes that of its nearest licensed directory upwards:
directories, not files, are joined with their ancestors' paths, so a directory with a third of all files is one row there. What a directory gives goes to all
tasks if directories are few, and else to each of the ``SALTS`` parts that a directory's files are dealt into; so does a unit's licence. Texts are read once.

Defined cases: a null text has no units; a null path is the file's own empty path; ties between templates go to the smaller name, between files of a directory to the higher
cosine, then the smaller name; repeated rows of a path are one file and reported once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

LEAST = 0.6
#: Parts that the files of a directory are dealt into.
SALTS = 16
# Short notices of well-known licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
CUE = "(?i)licen[cs]|copyright|permission|redistribut|public domain|all rights reserved|creative commons|\\bcc[ -](?:by|0)"
LICENCE_FILE = "(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.-][^/]*)?$"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*+"  # possessive: long chains need no stack


def template_terms(templates: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, weight / norm) rows, idf by term, and the idf of terms that no template has."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    n = len(templates)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(templates, counts)):
        weights = {t: (1 + math.log(x)) * idf[t] for t, x in c.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(k, name, t, w / norm) for t, w in sorted(weights.items())]
    return rows, idf, math.log(1 + n) + 1


def _units(path: Column, text: Column) -> Column:
    paragraphs = F.split(text, "\\n[\\x20\\t\\r]*\\n")
    lines = F.split(text, "\\n")
    sentences = F.split(F.regexp_replace(text, "([.!?])[\\x20\\t\\r]+", "$1\n"), "\\n")
    some = F.filter(F.concat(paragraphs, lines, sentences), lambda x: x.rlike(CUE))
    return F.array_distinct(F.transform(F.concat(some, F.when(path.rlike(LICENCE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))), F.trim))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, few: int = storage.FEW) -> DataFrame:
    """path, license, basis (own, inherited or null), similarity and directory of each file of files (path, text)."""
    spark = files.sparkSession
    files = files.select(F.coalesce("path", F.lit("")).alias("path"), "text")
    rows, idf, unseen = template_terms(templates)
    terms = spark.createDataFrame(rows, "template int, license string, term string, weight double")
    weights = spark.createDataFrame(sorted(idf.items()), "term string, idf double")

    cued = files.where(F.col("text").isNotNull() & (F.col("text").rlike(CUE) | F.col("path").rlike(LICENCE_FILE)))
    parts = cued.withColumn("unit", F.explode(_units(F.col("path"), F.col("text"))))
    whole = (F.col("unit") == F.trim("text")) | F.col("path").rlike(LICENCE_FILE)
    parts = storage.keep(parts.select("path", F.sha2("unit", 256).alias("unit_id"), "unit", whole.alias("whole")), "units")
    # Each distinct unit once: only its hash is kept beside the path.
    units = parts.groupBy("unit_id").agg(F.first("unit").alias("unit"))
    words = units.select("unit_id", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(0))).alias("term"))
    counted = words.groupBy("unit_id", "term").agg(F.count("*").alias("tf"))
    weighted = counted.join(F.broadcast(weights), "term", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(unseen)))
    norms = weighted.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(terms), "term").groupBy("unit_id", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    scored = dots.join(norms, "unit_id").select("unit_id", "license", cosine.alias("similarity")).where(F.col("similarity") >= least)
    first = F.struct((-F.col("similarity")).alias("s"), "license")
    best = storage.keep(scored.groupBy("unit_id").agg(F.min(first).alias("best")), "best")

    own = _dealt_join(parts.select("path", "unit_id", "whole"), best, "unit_id", "inner", few)
    own = storage.keep(own.groupBy("path").agg(F.min("best").alias("best"), F.min(F.when(F.col("whole"), F.col("best"))).alias("whole")), "own")
    licensed = own.where("whole is not null").groupBy(_parent(F.col("path")).alias("ancestor")).agg(F.min("whole").alias("given"))

    folders = files.select(_parent(F.col("path")).alias("folder")).distinct()
    ancestors = folders.select("folder", F.posexplode(_ancestors(F.col("folder"))).alias("steps", "ancestor"))
    nearest = ancestors.join(licensed, "ancestor").groupBy("folder").agg(F.min(F.struct("steps", "ancestor", "given")).alias("near"))
    nearest = storage.keep(nearest, "nearest")
    out = files.select("path", _parent(F.col("path")).alias("folder")).join(own.drop("whole"), "path", "left")
    out = _dealt_join(out, nearest, "folder", "left", few)
    has = F.col("best").isNotNull()
    return out.select(
        "path",
        F.when(has, F.col("best.license")).otherwise(F.col("near.given.license")).alias("license"),
        F.when(has, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).alias("basis"),
        (-F.when(has, F.col("best.s")).otherwise(F.col("near.given.s"))).alias("similarity"),
        F.when(~has, F.col("near.ancestor")).alias("directory"),
    )


def _dealt_join(files: DataFrame, one: DataFrame, key: str, how: str, few: int) -> DataFrame:
    """files with the one row of their key; one, which storage.keep has written, goes to all tasks or to each part of a key's files."""
    if one.count() <= few:
        return files.join(F.broadcast(one), key, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = files.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return dealt.join(one.withColumn("salt", salts), [key, "salt"], how).drop("salt")


def _parent(path: Column) -> Column:
    """The directory of a path, an empty string at the top."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def _ancestors(folder: Column) -> Column:
    """A directory and those above it, nearest first."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    steps = F.sequence(F.lit(0), F.size(parts))
    return F.transform(steps, lambda k: F.when(k == 0, folder).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - k), "/")))


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path and text: documents as files of their source's and language's directory."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")


def query(docs: DataFrame) -> DataFrame:
    """doc_id and the result of scan for every document."""
    named = document_paths(docs)
    found = scan(named.select("path", "text"))
    return found.select(F.element_at(F.split("path", "/"), -1).try_cast("long").alias("doc_id"), "*")
