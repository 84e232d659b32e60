"""Licence scans: Dice coefficient over word bigrams against licence notices.

A unit of text is a line, or a run of several non-blank lines. It matches a
template when 2 * shared / (bigrams of both) reaches the limit, counted over
distinct word bigrams. Two things keep templates and units apart before any
counting, and neither loses a match: sizes must lie within the bounds that the
limit implies, and a matching unit must contain one of the template's anchors,
which cover more bigrams than a match may miss.

A licence that no unit declares is sought in passages too: runs of words
anywhere in the text, over lines and comment marks, of no more bigrams than a
match may have. A best passage begins and ends with a bigram of the template,
so only these are tried; of passages that overlap the better one counts, since
a part of one notice is often like another licence's.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

LIMIT = 0.8

#: Short notices by which public licences are commonly declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: Beginnings of words that are rare outside notices; anchors are sought among them first.
CUES = ("licen", "software", "copyright", "warrant", "redistribut", "permission", "creative", "gnu", "sublicense", "merchantab", "apache", "mozilla")


def bigrams(text: str) -> set[str]:
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def anchors(templates=TEMPLATES, limit: float = LIMIT) -> list[str]:
    """Strings of which every matching unit holds one, in normalised text with a blank before each word.

    A match with ``a`` template bigrams shares at least a * limit / (2 - limit)
    of them, so anchors that cover more than the rest cannot all be missed.
    """
    out: set[str] = set()
    for _, text in templates:
        own = bigrams(text)
        may_miss = len(own) - math.ceil(round(len(own) * limit / (2 - limit), 9))
        covered: set[str] = set()
        for cue in CUES:
            hit = {b for b in own if f" {cue}" in f" {b}"}
            if hit - covered and len(covered) <= may_miss:
                out.add(f" {cue}")
                covered |= hit
        for b in sorted(own - covered, key=lambda b: (-len(b), b)):
            if len(covered) <= may_miss:
                out.add(f" {b} ")
                covered.add(b)
    return sorted(out)


def scan_licences(docs: DataFrame, templates=TEMPLATES, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences declared in every document, one row per input row.

    Returns ``id_col, licences`` (sorted, comma-joined, '' for none),
    ``n_matches`` (units of text that match, each counted once for every
    licence, and one for each licence that only passages declare) and
    ``best_ppm`` (the best coefficient of these in millionths, 0 for none). Null and empty texts match nothing; texts of any length are
    searched whole; repeated rows give repeated results; other columns are
    left out, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_x9_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_x9_text"))
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower("_x9_text"), "[^a-z0-9]+", " "), F.lit(" "))
    any_of = None
    for a in anchors(templates, limit):
        any_of = F.contains(F.col("_x9_plain"), F.lit(a)) if any_of is None else any_of | F.contains(F.col("_x9_plain"), F.lit(a))
    plain_units = F.transform(_units(F.col("_x9_text")), lambda x: F.struct(x.alias("unit"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("ppm")))
    passages = F.transform(_passages(F.col("_x9_plain"), templates, limit), lambda x: F.struct(F.lit(None).cast("string").alias("unit"), x["name"].alias("name"), x["ppm"].alias("ppm")))
    marked = rows.withColumn("_x9_plain", plain).withColumn("_x9_units", F.when(any_of, F.concat(plain_units, passages)).otherwise(F.array().cast("array<struct<unit:string,name:string,ppm:bigint>>")))
    marked = marked.select("_x9_id", F.monotonically_increasing_id().alias("_x9_row"), "_x9_units")

    known = spark.createDataFrame([(n, name, len(own), b) for n, (name, text) in enumerate(templates) for own in [bigrams(text)] for b in sorted(own)], "_x9_t int, _x9_name string, _x9_a int, _x9_gram string")
    words = F.array_remove(F.split("_x9_unit", "[^a-z0-9]+"), "")
    pairs = F.greatest(F.size("_x9_words") - 1, F.lit(0))
    units = marked.select("_x9_id", "_x9_row", F.posexplode_outer("_x9_units").alias("_x9_u", "_x9_x")).select("_x9_id", "_x9_row", "_x9_u", F.col("_x9_x.unit").alias("_x9_unit"), F.col("_x9_x.name").alias("_x9_only"), F.col("_x9_x.ppm").alias("_x9_only_ppm")).withColumn("_x9_words", F.coalesce(words, F.array().cast("array<string>")))
    grams = units.select("_x9_id", "_x9_row", "_x9_u", "_x9_only", "_x9_only_ppm", F.array_distinct(F.zip_with(F.slice("_x9_words", F.lit(1), pairs), F.slice("_x9_words", F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b))).alias("_x9_grams"))
    grams = grams.select("_x9_id", "_x9_row", "_x9_u", "_x9_only", "_x9_only_ppm", F.size("_x9_grams").alias("_x9_b"), F.explode_outer("_x9_grams").alias("_x9_gram"))
    bound = 2 * F.least("_x9_a", "_x9_b") >= F.lit(limit) * (F.col("_x9_a") + F.col("_x9_b"))
    shared = grams.join(F.broadcast(known), (grams["_x9_gram"] == known["_x9_gram"]) & bound, "left").groupBy("_x9_row", "_x9_id", "_x9_u", "_x9_only", "_x9_only_ppm", "_x9_t", "_x9_name", "_x9_a", "_x9_b").agg(F.count(F.lit(1)).alias("_x9_c"))
    dice = F.when(F.col("_x9_t").isNotNull(), F.floor(F.lit(2_000_000) * F.col("_x9_c") / (F.col("_x9_a") + F.col("_x9_b"))))
    hit = F.col("_x9_ppm") >= math.ceil(limit * 1_000_000)
    by_unit = shared.withColumn("_x9_ppm", dice).withColumn("_x9_ppm", F.when(hit, F.col("_x9_ppm")))
    by_name = by_unit.groupBy("_x9_row", "_x9_id", "_x9_u", "_x9_only", "_x9_only_ppm", F.when(hit, F.col("_x9_name")).alias("_x9_name")).agg(F.max("_x9_ppm").alias("_x9_ppm"))
    by_row = by_name.groupBy("_x9_row", "_x9_id").agg(
        F.collect_set("_x9_name").alias("_x9_names"), F.count("_x9_name").alias("_x9_n"), F.coalesce(F.max("_x9_ppm"), F.lit(0)).cast("long").alias("_x9_best"),
        F.collect_set(F.when(F.col("_x9_only").isNotNull(), F.struct(F.col("_x9_only").alias("name"), F.col("_x9_only_ppm").alias("ppm")))).alias("_x9_passages"),
    ).withColumn("_x9_passages", F.filter("_x9_passages", lambda x: ~F.array_contains("_x9_names", x["name"])))
    return by_row.select(
        F.col("_x9_id").alias(id_col), F.array_join(F.array_sort(F.array_union("_x9_names", F.col("_x9_passages")["name"])), ",").alias("licences"),
        (F.col("_x9_n") + F.size("_x9_passages")).alias("n_matches"), F.greatest("_x9_best", F.array_max(F.col("_x9_passages")["ppm"])).alias("best_ppm"),
    )


def _passages(plain: Column, templates, limit: float) -> Column:
    """The licences of passages of normalised text, as structs of name and ppm, one for each name."""
    words = F.array_remove(F.split(plain, " "), "")
    pairs = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    grams = let(words, lambda w: F.zip_with(F.slice(w, F.lit(1), pairs(w)), F.slice(w, F.lit(2), pairs(w)), lambda a, b: F.concat_ws(" ", a, b)))
    own = [(name, bigrams(text)) for name, text in templates]
    where = {b: [n for n, (_, x) in enumerate(own) if b in x] for b in sorted(set().union(*(x for _, x in own)))}
    holders = F.create_map(*[c for b, ns in where.items() for c in (F.lit(b), F.array(*map(F.lit, ns)))])
    known = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(name).alias("name"), F.lit(len(x)).alias("a"), F.lit(math.ceil(round(len(x) * limit / (2 - limit), 9))).alias("least"), F.lit(math.floor(round(len(x) * (2 - limit) / limit, 9))).alias("most"))
        for n, (name, x) in enumerate(own)
    ])

    kind = "array<struct<loss:bigint,p:int,e:int,name:string>>"

    def passing(g: Column, hits: Column, t: Column) -> Column:
        """The matching passages from one hit to another: first and last bigram, and the coefficient below 0 to sort by."""

        def ending(start: Column, w: Column) -> Column:
            shared = lambda m: F.size(F.array_distinct(F.slice(w["g"], F.lit(1), m)))
            size = lambda m: F.size(F.array_distinct(F.slice(g, start["p"] + 1, w[m - 1]["p"] - start["p"] + 1)))
            row = lambda m: F.struct((-F.floor(F.lit(2_000_000) * shared(m) / (t["a"] + size(m)))).alias("loss"), start["p"].alias("p"), w[m - 1]["p"].alias("e"), t["name"].alias("name"))
            rows = F.filter(F.transform(F.sequence(t["least"], F.size(w)), row), lambda x: x["loss"] <= -math.ceil(limit * 1_000_000))
            return F.when(F.size(F.array_distinct(w["g"])) >= t["least"], rows).otherwise(F.array().cast(kind))

        of = F.filter(hits, lambda h: F.array_contains(h["t"], t["n"]))
        near = lambda o, h, k: F.filter(F.slice(o, k + 1, t["most"]), lambda e: e["p"] < h["p"] + t["most"])
        return let(of, lambda o: F.flatten(F.transform(o, lambda h, k: let(near(o, h, k), lambda w: ending(h, w)))))

    def found(g: Column) -> Column:
        hits = F.filter(F.transform(g, lambda x, p: F.struct(p.alias("p"), x.alias("g"), F.try_element_at(holders, x).alias("t"))), lambda h: h["t"].isNotNull())
        every = let(hits, lambda h: F.flatten(F.transform(known, lambda t: passing(g, h, t))))
        beaten = lambda kept, x: F.exists(kept, lambda k: (k["loss"] < x["loss"]) & (k["p"] <= x["e"]) & (k["e"] >= x["p"]))
        known_already = lambda kept, x: F.exists(kept, lambda k: (k["name"] == x["name"]) & (k["p"] == x["p"]) & (k["e"] == x["e"]))
        return F.aggregate(F.array_sort(every), F.array().cast(kind), lambda kept, x: F.when(beaten(kept, x) | known_already(kept, x), kept).otherwise(F.concat(kept, F.array(x))))

    top = lambda x: F.transform(F.array_distinct(x["name"]), lambda n: F.struct(n.alias("name"), (-F.array_min(F.filter(x, lambda y: y["name"] == n)["loss"])).alias("ppm")))
    return let(let(grams, found), top)


def _units(text: Column) -> Column:
    """Lower-cased lines, then blocks of several lines between blank ones."""
    low = F.lower(text)
    return F.concat(F.split(low, "\n"), F.filter(F.split(low, "\n[\\x20\\x09-\\x0D]*\n"), lambda x: F.contains(x, F.lit("\n"))))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql(limit: float = LIMIT) -> str:
    values = ", ".join(f"({n}, '{name}', {len(own)}, '{b}')" for n, (name, text) in enumerate(TEMPLATES) for own in [bigrams(text)] for b in sorted(own))
    return f"""
WITH known(t, name, a, gram) AS (VALUES {values}),
units AS (SELECT doc_id, row_number() OVER () AS u, unnest(list_concat(string_split(lower(text), chr(10)),
          list_filter(regexp_split_to_array(lower(text), '\\n[\\x20\\x09-\\x0D]*\\n'), lambda x: contains(x, chr(10))))) AS unit FROM documents),
w AS (SELECT doc_id, row_number() OVER () AS u, list_filter(regexp_split_to_array(unit, '[^a-z0-9]+'), lambda x: x <> '') AS w FROM units),
g AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
e AS (SELECT doc_id, u, len(g) AS b, unnest(g) AS gram FROM g),
d AS (SELECT doc_id, u, t, name, a, b, count(*) AS c FROM e JOIN known USING (gram) GROUP BY ALL),
m AS (SELECT doc_id, u, name, max(CAST(floor(2000000 * c / (a + b)) AS BIGINT)) AS ppm FROM d WHERE floor(2000000 * c / (a + b)) >= {math.ceil(limit * 1_000_000)} GROUP BY ALL)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list(name))), ','), '') AS licences, count(name) AS n_matches, coalesce(max(ppm), 0) AS best_ppm
FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id
"""


OP9_SQL = _sql()
