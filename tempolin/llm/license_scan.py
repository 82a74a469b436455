"""License scan: MinHash bands over overlapping windows, then exact containment.

Every text is cut into overlapping windows of ``WINDOW`` words, one each ``STRIDE``
words.  A window's band values are the least of its shingle hashes under each of
``BANDS`` fixed permutations (XOR with a constant).  A template has the values of each
of its shingles alone, as it can stand anywhere in a window.  Any equal value retrieves
the template for the document, and only retrieved pairs have their shingles compared as
text: a template matches if the document holds at least 80 % of its shingles.

A notice can be as short as three words, one shingle, and must be the least of its
window under some band.  A window of four words has two shingles, and which is the least
is settled by the highest bit where their hashes differ: the notice is missed only if all
constants agree in that bit, against it.  They agree in no bit, so a hash is never missed.

All of it is DataFrame functions, a projection without a shuffle.  Templates are a
parameter; ``MAX_VALUES`` band values of them are compared in one pass, more take more
passes.

Defined results: null, empty or too short texts match nothing; a template without
shingles matches nothing; repeated documents each get their rows; templates that share
an id are separate; an empty table gives an empty result; other columns are not
carried.  Words are runs of letters, digits and characters from U+0080, lower-cased.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, WINDOW, STRIDE, BANDS = 3, 4, 2, 12
CONTAINMENT_PERCENT = 80
MAX_VALUES = 10_000

#: Short license notices, and the grants or headers of license texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("All-rights-reserved", "All rights reserved."),
    (
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "BSD-conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "GPL-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
)
_BETWEEN = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def _shingles(words: Column) -> Column:
    """Different shingles as text; empty if there are too few words."""

    def made(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)])))

    return _let(words, lambda w: F.when(F.size(w) >= SHINGLE, made(w)).otherwise(F.array().cast("array<string>")))


def _constants() -> list[int]:
    """One 64-bit constant a band, from a linear congruence."""
    out, x = [], 0x2545F4914F6CDD1D
    for _ in range(BANDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


def _band_values(words: Column, alone: bool = False) -> Column:
    """The band values of all windows of a text, or of its shingles ``alone``: one array, each value with its band mixed in."""
    span, stride = (1, 1) if alone else (WINDOW - SHINGLE + 1, STRIDE)

    def windows(h: Column) -> Column:
        # each window's shingles; the last window ends with the text
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - span + stride, F.lit(1)), F.lit(stride)), lambda at: F.slice(h, at, span))

    def values(v: Column) -> Column:
        least = lambda c: lambda w: F.array_min(F.transform(w, lambda x: x.bitwiseXOR(F.lit(c))))
        return F.concat(*[F.transform(v, least(c)) for c in _constants()])

    def made(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return _let(hashes, lambda h: _let(windows(h), values))

    return _let(words, lambda w: F.when(F.size(w) >= SHINGLE, made(w)).otherwise(F.array().cast("array<bigint>")))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template_id, n_found and n_shingles for every template that a row matches."""
    spark = docs.sparkSession
    given = spark.createDataFrame([tuple(t) for t in templates], "template_id string, template string").where("template is not null")
    known = given.select("template_id", _shingles(_words(F.col("template"))).alias("shingles"), F.array_distinct(_band_values(_words(F.col("template")), alone=True)).alias("values")).collect()
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    passes: list[list] = [[]]
    for template in known:
        if passes[-1] and sum(len(t["values"]) for t in passes[-1]) + len(template["values"]) > MAX_VALUES:
            passes.append([])
        passes[-1].append(template)
    return reduce(DataFrame.unionByName, (_one_pass(body, p) for p in passes))


def _one_pass(body: DataFrame, templates: list) -> DataFrame:
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    known = F.array(
        *[F.struct(F.lit(t["template_id"]).alias("template_id"), F.array(*map(F.lit, t["shingles"])).cast("array<string>").alias("shingles"), longs(t["values"]).alias("values")) for t in templates]
    )
    if not any(t["values"] for t in templates):
        return body.where("false").select("doc_id", F.lit("").alias("template_id"), F.lit(0).cast("long").alias("n_found"), F.lit(0).cast("long").alias("n_shingles"))
    every = sorted({v for t in templates for v in t["values"]})
    retrieved = body.select("doc_id", "body", F.filter(_band_values(_words(F.col("body"))), lambda x: x.isin(*every)).alias("hits")).where(F.size("hits") > 0)
    candidates = retrieved.select("doc_id", _shingles(_words(F.col("body"))).alias("shingles"), F.explode(F.filter(known, lambda t: F.arrays_overlap(t["values"], F.col("hits")))).alias("t"))
    counted = candidates.select("doc_id", F.col("t.template_id"), F.size(F.array_intersect("t.shingles", "shingles")).cast("long").alias("n_found"), F.size("t.shingles").cast("long").alias("n_shingles"))
    return counted.where(100 * F.col("n_found") >= CONTAINMENT_PERCENT * F.col("n_shingles"))
