"""Licence scan: Dice coefficient over word bigrams against notice templates, with size bounds and a prefix filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.sources.shared import materialize

# Public licence notices, by identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words so common in prose that a bigram of two of them is a poor key.
COMMON = {"a", "and", "any", "at", "by", "for", "in", "is", "it", "not", "of", "on", "or", "the", "this", "to", "with", "you"}


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _bigrams(normal: Column) -> Column:
    """Distinct bigrams of words; a text of under two words has none."""
    return F.transform(
        F.array(F.split(normal, " ")),
        lambda w: F.when(F.size(w) > 1, F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))).otherwise(F.array().cast("array<string>")),
    )[0]


def template_rows(templates=TEMPLATES, least: float = 0.8) -> list[tuple[int, str, list[str], list[str]]]:
    """(number, licence, bigrams, keys). A text with Dice >= least shares at least least/(2-least) of the template's
    bigrams, so it shares one of any ``keys`` that leave out fewer than that; the rarest-looking ones are taken."""
    rows = []
    for i, (name, text) in enumerate(templates):
        words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
        grams = list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))
        must = math.ceil(round(least / (2 - least) * len(grams), 9))
        rank = sorted(grams, key=lambda g: (sum(w in COMMON for w in g.split()), -len(g)))
        rows.append((i, name, grams, rank[: len(grams) - must + 1]))
    return rows


def anchors(templates=TEMPLATES, least: float = 0.8) -> list[tuple[str, int, int, int]]:
    """(key, template, place of the key's first word in the template, words of the template)."""
    out = []
    for (_, text), (i, _, _, keys) in zip(templates, template_rows(templates, least)):
        words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
        pairs = [" ".join(p) for p in zip(words, words[1:])]
        out += [(k, i, pairs.index(k), len(words)) for k in keys]
    return out


def _joined(words: Column) -> Column:
    """Bigrams of words in order, repeats included."""
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda x, y: F.concat_ws(" ", x, y))


def keyed_texts(docs: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, text, w, own_keys): rows of ``docs`` that hold a key bigram of a template, with their words and keys, stored.

    A part of a text is parted from the rest by a character that is no part of a word, so bigrams of a line or paragraph are
    bigrams of the whole text: no other row has a unit or a window that could match.
    """
    keys = F.lit(sorted({k for r in template_rows(templates, least) for k in r[3]}))
    texts = docs.select("doc_id", "text", F.split(_normal(F.col("text")), " ").alias("w")).where(F.size("w") > 1)
    return materialize(texts.withColumn("own_keys", F.array_intersect(_joined(F.col("w")), keys)).where(F.size("own_keys") > 0))


def scan_windows(texts: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, license, n_windows, dice): notices anywhere in ``keyed_texts``, also within a line or across lines.

    Every key bigram of a template in the whole text puts a window of the template's length where the template would lie.
    Windows with Dice >= ``least`` that overlap are one place, and the best of them (then the first licence by name) names
    it.
    """
    spark = texts.sparkSession
    rows = template_rows(templates, least)
    index = spark.createDataFrame(anchors(templates, least), "key string, template int, place int, words int")
    index = index.join(spark.createDataFrame([r[:3] for r in rows], "template int, license string, grams array<string>"), "template")
    hits = F.filter(F.transform(_joined(F.col("w")), lambda g, i: F.struct(g.alias("key"), i.alias("at"))), lambda h: F.array_contains("own_keys", h["key"]))
    hits = texts.select("doc_id", "w", F.explode(hits).alias("h")).join(F.broadcast(index), F.col("h.key") == F.col("key"))
    lo = F.greatest(F.col("h.at") - F.col("place"), F.lit(0))
    hi = F.least(F.col("h.at") - F.col("place") + F.col("words"), F.size("w"))
    windows = hits.select("doc_id", "license", "grams", lo.alias("lo"), hi.alias("hi"), F.slice("w", lo + 1, hi - lo).alias("part"))
    windows = windows.withColumn("own", F.array_distinct(_joined(F.col("part"))))
    dice = 2.0 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.size("grams"))
    good = windows.select("doc_id", "license", "lo", "hi", F.round(dice, 6).alias("dice")).where(F.col("dice") >= least).distinct()
    by = Window.partitionBy("doc_id").orderBy("lo", "hi", "license", "dice")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    place = F.sum(F.coalesce((F.col("lo") >= F.col("reach")).cast("int"), F.lit(1))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    placed = good.withColumn("reach", reach).withColumn("number", place)
    best = placed.groupBy("doc_id", "number").agg(F.min(F.struct((-F.col("dice")).alias("less"), F.col("license"))).alias("b"))
    return best.groupBy("doc_id", F.col("b.license").alias("license")).agg(F.count("*").alias("n_windows"), F.max(-F.col("b.less")).alias("window_dice"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, license, n_units, n_windows, dice): licence notices in ``docs``, by lines and multi-line paragraphs (n_units),
    and anywhere in the text (n_windows, see scan_windows); ``dice`` is the best of both.

    A unit counts for its best template only (ties: the first licence by name), ``n_units`` counts them. The templates are a fixed small table, broadcast; candidates need a template within the size bounds
    that Dice allows and one of its key bigrams. Null or empty texts, and units of under two words, match nothing.
    Repeated rows of one doc_id count once for each place in the text. Whole texts are normalised once; only those with a
    key bigram are cut into units and windows.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs, templates, least)
    rows = template_rows(templates, least)
    table = spark.createDataFrame(rows, "template int, license string, grams array<string>, keys array<string>")
    index = table.select(F.explode("keys").alias("key"), "license", "grams", F.size("grams").alias("n_grams"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("unit")))
    blocks = F.transform(F.split("text", r"\n[\x20\x09-\x0D]*\n"), lambda x, i: F.struct((-1 - i).alias("at"), x.alias("unit")))
    units = texts.select("doc_id", F.explode(F.concat(lines, F.filter(blocks, lambda b: F.contains(b["unit"], F.lit("\n"))))).alias("u"))
    most = max(len(r[2]) for r in rows) * (2 - least) / least + 1
    # each bigram takes at least three characters with its spaces, or the unit repeats itself
    grams = units.select("doc_id", F.col("u.at").alias("at"), _normal(F.col("u.unit")).alias("normal")).select("doc_id", "at", _bigrams(F.col("normal")).alias("own"))
    grams = grams.where((F.size("own") > 0) & (F.size("own") <= most))
    keys = sorted({k for r in rows for k in r[3]})
    found = grams.select("doc_id", "at", "own", F.explode(F.array_intersect("own", F.lit(keys))).alias("key"))
    low, high = least / (2 - least), (2 - least) / least
    pairs = found.join(F.broadcast(index), "key").where((F.size("own") >= F.col("n_grams") * low - 1e-9) & (F.size("own") <= F.col("n_grams") * high + 1e-9))
    dice = 2.0 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.col("n_grams"))
    scored = pairs.select("doc_id", "at", "license", F.round(dice, 6).alias("dice")).where(F.col("dice") >= least)
    best = scored.groupBy("doc_id", "at").agg(F.min(F.struct((-F.col("dice")).alias("less"), F.col("license"))).alias("b"))
    by_unit = best.groupBy("doc_id", F.col("b.license").alias("license")).agg(F.count("*").alias("n_units"), F.max(-F.col("b.less")).alias("dice"))
    by_window = scan_windows(texts, templates, least)
    rows = by_unit.withColumns({"n_windows": F.lit(0).cast("long")}).unionByName(by_window.select("doc_id", "license", F.lit(0).cast("long").alias("n_units"), F.col("window_dice").alias("dice"), "n_windows"))
    return rows.groupBy("doc_id", "license").agg(F.sum("n_units").alias("n_units"), F.sum("n_windows").alias("n_windows"), F.max("dice").alias("dice"))


def op9_dice_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op9_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in TEMPLATES)
    keys = ", ".join(f"({quoted(k)}, {t}, {place}, {words})" for k, t, place, words in anchors())
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t(license, text) AS (VALUES {values}),
tw AS (SELECT license, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM t),
tg AS (SELECT license, {grams} AS g FROM tw),
l AS (SELECT doc_id, string_split(text, chr(10)) AS parts, 0 AS kind FROM documents UNION ALL
  SELECT doc_id, string_split_regex(text, '\n[\x20\x09-\x0D]*\n'), 1 FROM documents),
u AS (SELECT doc_id, kind, unnest(range(len(parts))) AS pos, unnest(parts) AS unit FROM l),
uw AS (SELECT doc_id, kind, pos, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u
  WHERE kind = 0 OR contains(unit, chr(10))),
ug AS (SELECT doc_id, kind, pos, {grams} AS own FROM uw WHERE len(w) > 1),
d AS (SELECT doc_id, kind, pos, license, round(2.0 * len(list_intersect(own, g)) / (len(own) + len(g)), 6)::DOUBLE AS dice FROM ug, tg
  WHERE len(own) BETWEEN len(g) * 0.6 AND len(g) * 1.6),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, pos ORDER BY dice DESC, license) AS k FROM d WHERE dice >= 0.8),
k(key, t, place, words) AS (VALUES {keys}),
kt AS (SELECT key, place, words, t.license, tg.g FROM k JOIN (SELECT *, row_number() OVER () - 1 AS n FROM t) t ON t.n = k.t JOIN (SELECT *, row_number() OVER () - 1 AS n FROM tg) tg ON tg.n = k.t),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS pos FROM w WHERE len(w) > 1),
h AS (SELECT doc_id, license, g, greatest(pos - 1 - place, 0) AS lo, least(pos - 1 - place + words, len(w)) AS hi, w FROM p JOIN kt ON key = w[pos] || ' ' || w[pos + 1]),
hw AS (SELECT doc_id, license, g, lo, hi, w[lo + 1:hi] AS w FROM h),
hg AS (SELECT doc_id, license, g, lo, hi, {grams} AS own FROM hw),
hd AS (SELECT DISTINCT doc_id, license, lo, hi, round(2.0 * len(list_intersect(own, g)) / (len(own) + len(g)), 6)::DOUBLE AS dice FROM hg),
hr AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi, license, dice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hd WHERE dice >= 0.8),
hn AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lo, hi, license, dice ROWS UNBOUNDED PRECEDING) AS n FROM hr),
hb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY dice DESC, license) AS k FROM hn),
r AS (SELECT doc_id, license, 1 AS u, 0 AS v, dice FROM b WHERE k = 1 UNION ALL SELECT doc_id, license, 0, 1, dice FROM hb WHERE k = 1)
SELECT doc_id, license, sum(u)::BIGINT AS n_units, sum(v)::BIGINT AS n_windows, max(dice) AS dice FROM r GROUP BY ALL"""
