"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Units are the lines of a text (headers) and the text as a whole (licence files).  Idfs are counted over all documents for the templates'
terms; any other term counts as if no document had it.  A unit whose cosine to a template reaches SIMILARITY must contain one of the
template's anchors (its heaviest terms, without which the rest can't reach it), so only units with an anchor are taken apart.  A file's own licence is
its best unit's; a file that is a licence as a whole, or is named like one, speaks for its directory; a file without a licence inherits
from the nearest directory above it that has one.  DataFrame functions only; the driver sees the templates' terms, nothing else.

Defined results: null and empty texts have no licence of their own; a null path is a file at the top; ties between templates fall to the
first name; repeated rows repeat their results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import checkpointed, row_id, table

SIMILARITY = 0.6
#: A text as similar as this as a whole is a licence file, and speaks for its directory.
WHOLE = 0.9
# The notices that licences ask for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 2-Clause License",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse products. BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike",
    "CC0-1.0": "CC0 1.0 Universal Public Domain Dedication",
    "GPL-2.0": "This program is free software under the terms of the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Released under the ISC License",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
_TERM = "[^a-z0-9]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _TERM), lambda t: t != "")


def template_weights(docs: DataFrame, templates: dict[str, str], similarity: float) -> tuple[dict, float, dict, list[str]]:
    """(idf per template term, idf of any other, {template: {term: weight}} of length 1, all anchors)."""
    counts = {name: Counter(t for t in re.split(_TERM, text.lower()) if t) for name, text in templates.items()}
    vocabulary = sorted({t for c in counts.values() for t in c})
    words = F.array(*[F.lit(t) for t in vocabulary])
    present = docs.select(F.explode(F.array_intersect(F.split(F.lower("text"), _TERM), words)).alias("term"))
    found = {r.term: r.n for r in present.groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = docs.count()
    idf = {t: math.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in vocabulary}
    weights, anchors = {}, set()
    for name, count in counts.items():
        raw = {t: k * idf[t] for t, k in count.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        weights[name] = {t: w / length for t, w in raw.items()}
        rest = 1.0
        for t, w in sorted(weights[name].items(), key=lambda x: (-x[1], x[0])):
            # What is left reaches at most the length of the rest of the template.
            if math.sqrt(max(rest, 0)) < similarity:
                break
            anchors.add(t)
            rest -= w * w
    return idf, math.log(1 + n) + 1, weights, sorted(anchors)


def matched_units(docs: DataFrame, templates: dict[str, str] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """(id, unit, license, score): the best template of every unit that reaches the similarity; unit 0 is the whole text, the others its lines."""
    spark = docs.sparkSession
    idf, other, weights, anchors = template_weights(docs, templates, similarity)
    anchor = rf"\b(?:{'|'.join(anchors)})\b"
    lower = docs.select(row_id().alias("id"), F.lower("text").alias("text")).where(F.col("text").rlike(anchor))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("unit"), line.alias("line")))
    units = F.concat(F.array(F.struct(F.lit(0).alias("unit"), F.col("text").alias("line"))), F.filter(lines, lambda u: u["line"].rlike(anchor)))
    # Repeated rows meet in one unit; that doubles its counts, which no cosine depends on.
    words = lower.select("id", F.explode(units).alias("u")).select("id", "u.unit", F.explode(terms(F.col("u.line"))).alias("term"))
    counted = words.groupBy("id", "unit", "term").agg(F.count("*").alias("tf"))
    rows = [(t, idf[t], name, w[t]) for name, w in weights.items() for t in w]
    known = F.broadcast(spark.createDataFrame(rows, "term string, idf double, license string, weight double"))
    idfs = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    length = counted.join(idfs, "term", "left").groupBy("id", "unit").agg(
        F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(other)), 2))).alias("length"))
    dots = counted.join(known, "term").groupBy("id", "unit", "license").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    cosine = dots.join(length, ["id", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("score") >= similarity)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best")
    return cosine.groupBy("id", "unit").agg(best).select("id", "unit", "best.license", (-F.col("best.minus")).alias("score"))


def folder(path: Column) -> Column:
    """The directory of a path; the empty string is the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def inherited(files: DataFrame, speaking: DataFrame) -> DataFrame:
    """(dir, license, score, distance): for every directory of the files the licence of the nearest one above it (or of itself) that has one.

    Distinct directories, and for each its path upwards: rows grow with directories and their depth, not with files.
    """
    speaks = speaking.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best")).select(
        F.col("dir").alias("above"), F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        k.alias("distance"), F.array_join(F.slice(parts, 1, F.size(parts) - k), "/").alias("above")))
    ways = files.select("dir").distinct().select("dir", F.explode(up).alias("way")).select("dir", "way.distance", "way.above")
    near = ways.join(speaks, "above").groupBy("dir").agg(F.min(F.struct("distance", "license", "score")).alias("near"))
    return near.select("dir", "near.license", "near.score", "near.distance")


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, path, license, score, origin, distance) for every row of (doc_id, path, text); origin is own, inherited or none."""
    units = checkpointed(matched_units(docs, templates, similarity))
    own = units.groupBy("id").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"), F.max((F.col("unit") == 0) & (F.col("score") >= WHOLE)).alias("whole")).select(
        "id", F.col("best.license").alias("own_license"), (-F.col("best.minus")).alias("own_score"), "whole")
    clean = F.regexp_replace(F.coalesce(F.col("path"), F.lit("")), "/+", "/")
    files = docs.select("doc_id", row_id().alias("id"), "path", F.regexp_replace(clean, "^/", "").alias("place")).withColumn("dir", folder(F.col("place")))
    judged = files.join(own, "id", "left")
    speaking = judged.where(F.col("own_license").isNotNull() & (F.col("whole") | F.col("place").rlike(LICENCE_NAME))).select(
        "dir", F.col("own_license").alias("license"), F.col("own_score").alias("score"))
    near = inherited(files, speaking)
    rows = judged.join(near, "dir", "left")
    has = F.col("own_license").isNotNull()
    return rows.select(
        "doc_id", "path", F.coalesce("own_license", "license").alias("license"), F.when(has, F.col("own_score")).otherwise(F.col("score")).alias("score"),
        F.when(has, "own").when(F.col("license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, 0).otherwise(F.col("distance")).alias("distance"))


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: the source is the top directory, the language the next."""
    docs = table(spark, folder, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scanned(docs)
