"""Licence notices in texts, by the Dice coefficient of word bigrams, without Python.

A unit is a line, a paragraph of several lines, or the whole text.  Units and templates are
normalised alike: A-Z lower-cased, everything but letters and digits to blanks.  With A and B
their bags of word bigrams (a single word is one of its own), the score is
``2 |A and B| / (|A| + |B|)``, and a unit matches from ``LEAST`` up.

Sizes bound the score: a unit can only match templates with ``LEAST / (2 - LEAST)`` to
``(2 - LEAST) / LEAST`` times its bigrams, and their number is known from its words before any
bigram is built.  Units that share too few bigrams with all templates together go next; the
rest meets the templates of its sizes in a join on the number of bigrams.

Null and empty texts have no unit.  Equal scores go to the template named first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm import flow
from edgetide.llm.flow import Tables

LEAST = 0.8

# Notices as their licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the "
     "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
     "or implied. See the License for the specific language governing permissions and limitations under the "
     "License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the "
     "LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
     "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
     "License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
     "neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
     "or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
     "copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
     "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def normalised(text: Column) -> Column:
    """Words of a unit: letters and digits, A-Z lower-cased."""
    words = F.split(text, r"[^\p{L}\p{M}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def folded(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def bigrams(words: str) -> Column:
    """All bigrams of a unit in order; one word is a bigram of its own."""
    w, n = F.transform(words, folded), F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) == 1, w).otherwise(pairs)


def counted(items: Column) -> Column:
    """Each entry with the number of equal ones before it, so that sets of these are bags."""
    return F.transform(items, lambda x, i: F.struct(
        x.alias("b"), F.size(F.filter(F.slice(items, F.lit(1), i), lambda y: y == x)).alias("k")))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, licence, t, t_size, extra): bigrams, their number, how many of them repeat."""
    rows = [(k, name, text) for k, (name, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, licence string, body string").select(
        "template", "licence", normalised(F.col("body")).alias("w")).filter(F.size("w") > 0)
    return t.select("template", "licence", bigrams("w").alias("t")).select(
        "*", F.size("t").alias("t_size"), (F.size("t") - F.size(F.array_distinct("t"))).alias("extra"))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, key, unit, body): lines, paragraphs of several lines, the text if it has several."""
    text = F.coalesce(F.col("text"), F.lit(""))
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    kinds = (("line", F.split(text, "\n")), ("paragraph", paragraphs),
             ("text", F.when(F.contains(text, F.lit("\n")), F.array(text)).otherwise(F.array().cast("array<string>"))))
    bodies = F.flatten(F.array(*[F.transform(a, lambda b, k=k: F.struct(F.lit(k).alias("unit"), b.alias("body")))
                                 for k, a in kinds]))
    return docs.select("doc_id", "key", F.explode(bodies).alias("u")).select("doc_id", "key", "u.*")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, key, unit, licence, template, dice) of every match of a unit and a template.

    No shuffle; the templates are the only broadcast.
    """
    table = template_table(docs.sparkSession, templates)
    limits = table.agg(F.min("t_size").alias("lo"), F.max("t_size").alias("hi"), F.max("extra").alias("extra"),
                       F.array_distinct(F.flatten(F.collect_list("t"))).alias("all")).first()
    if limits.lo is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, key long, unit string, licence string, template int, dice double")
    low, high = LEAST / (2 - LEAST), (2 - LEAST) / LEAST
    docs = docs.select(F.col("doc_id").cast("long"), "text", flow.text_key().alias("key"))
    sized = units(docs).select("doc_id", "key", "unit", normalised(F.col("body")).alias("w")) \
        .withColumn("size", F.greatest(F.size("w") - 1, F.lit(1))) \
        .filter((F.size("w") > 0) & F.col("size").between(low * limits.lo, high * limits.hi))
    known = F.array(*map(F.lit, limits["all"]))
    # a match shares at least low * size bigrams with its template, so with all templates
    close = sized.withColumn("a", bigrams("w")).filter(
        F.size(F.array_intersect("a", known)) + limits.extra >= low * F.col("size"))
    allowed = table.withColumn("size", F.explode(F.sequence(
        F.ceil(low * F.col("t_size")).cast("int"), F.floor(high * F.col("t_size")).cast("int"))))
    total = F.col("size") + F.col("t_size")
    pairs = close.join(F.broadcast(allowed), "size").filter(
        2 * (F.size(F.array_intersect("a", "t")) + F.col("extra")) >= LEAST * total)
    dice = 2 * F.size(F.array_intersect(counted(F.col("a")), counted(F.col("t")))) / total
    scored = pairs.withColumn("dice", dice).filter(F.col("dice") >= LEAST)
    return scored.select("doc_id", "key", "unit", "licence", "template", "dice")


def licences(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, key, licences, best_licence, best_dice) for every row of ``docs``."""
    tables = Tables(docs.sparkSession)
    found = scan(docs, templates)
    rank = F.struct((-F.col("dice")).alias("minus"), "template")
    found = tables.stage(found.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set("licence")).alias("licences"), F.min_by("licence", rank).alias("best_licence"),
        F.max("dice").alias("best_dice")).withColumnsRenamed({"doc_id": "hit_id", "key": "hit_key"}), "found")
    rows = docs.select(F.col("doc_id").cast("long"), flow.text_key().alias("key"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")),
                     "left").select(
        "doc_id", "key", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        "best_licence", F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"))
