"""License scan by diagonal voting, in SQL functions only.

All rolling word k-grams of a text meet the k-grams of known license texts in one hash join.  A hit at word p of the
text and word t of a template votes for the diagonal p - t: an unbroken quotation votes for one diagonal, words put
in or left out shift it a little.  Votes are counted per text, template and diagonal, neighbouring diagonals merge
into a span, and a span stands when its verified words cover enough of the template.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.words import row_key

GRAM = 3
# Diagonals this close, with at most GAP words between their hits, belong to one span.
BAND, GAP = 4, 40
COVER = 0.5

# Phrases that name a license, with its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license notices, word for word.
TEXTS = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software."
    ),
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License."
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "gpl-statement": "licensed under the GNU General Public License, version",
    "mit-statement": "released under the MIT License",
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met: Redistributions of source code must retain the above copyright"
        " notice, this list of conditions and the following disclaimer. Redistributions in binary form must"
        " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution."
    ),
}

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A text to look for; ``whole`` ones must match word for word."""

    label: str
    text: str
    whole: bool = False


TEMPLATES = [Template(label, text, True) for text, label in PHRASES.items()] + [
    Template(label, text) for label, text in TEXTS.items()
]


def words(text: Column) -> Column:
    """The words of a text (null: none).

    The Kelvin sign is the one non-ASCII letter whose lower case is ASCII; it is set aside before lower-casing.
    """
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")))
    return F.array_remove(F.split(lowered, _BREAKS), "")


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """One row per template position: template, at, gram, size (words of the gram), length (words of the template).

    A few hundred rows: as many as the templates have words.
    """
    texts = spark.createDataFrame([(i, t.text) for i, t in enumerate(templates)], "template int, text string")
    listed = texts.select("template", words(F.col("text")).alias("w")).withColumn("length", F.size("w"))
    listed = listed.withColumn("size", F.least(F.lit(GRAM), F.col("length")))
    at = listed.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))).alias("at"))
    return at.select(
        "template", "at", "length", "size", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("gram")
    )


def hits(df: DataFrame, templates: list[Template], id_column: str, text: str) -> DataFrame:
    """Verified k-gram hits: key, p (word of the text), and the template's position."""
    spark = df.sparkSession
    table = template_grams(spark, templates).collect()
    sizes = sorted({r["size"] for r in table})
    if min(sizes) < 2:
        raise ValueError("a template needs two words at least")
    listed = df.select(row_key(df[id_column], df[text]).alias("key"), words(df[text]).alias("w"))
    rows = listed.select("key", "w", F.posexplode_outer("w").alias("p", "word"))
    at = lambda j: F.get("w", F.col("p") + j)
    # All rolling pairs are hashed; only those that open some template gram go on to the join.
    openings = {r["gram"].split(" ")[0] + " " + r["gram"].split(" ")[1] for r in table}
    heads = spark.createDataFrame([(x.split(" ")[0], x.split(" ")[1]) for x in sorted(openings)], "a string, b string")
    codes = [r[0] for r in heads.select(F.xxhash64("a", "b")).collect()]
    rows = rows.where(F.xxhash64("word", at(1)).isin(codes))
    grams = [
        F.struct(
            F.lit(size).alias("size"),
            F.when(F.col("p") + size <= F.size("w"), F.array_join(F.slice("w", F.col("p") + 1, size), " ")).alias("gram"),
        )
        for size in sizes
    ]
    rows = rows.select("key", "p", F.explode(F.array(*grams)).alias("g")).select("key", "p", "g.*")
    rows = rows.withColumn("code", F.xxhash64("size", "gram"))
    known = template_grams(spark, templates).withColumn("code", F.xxhash64("size", "gram"))
    known = known.select("template", "at", "length", "code", "size", F.col("gram").alias("wanted"))
    # Equal hashes are checked word for word.
    return rows.join(F.broadcast(known), ["code", "size"]).where(F.col("gram") == F.col("wanted"))


def spans(found: DataFrame, templates: list[Template], cover: float = COVER) -> DataFrame:
    """Verified spans: key, label, whole, start, end (words, end exclusive), coverage of the template."""
    votes = (
        found.dropDuplicates(["key", "template", "p", "at"])
        .groupBy("key", "template", (F.col("p") - F.col("at")).alias("diagonal"))
        .agg(
            F.min("p").alias("start"),
            F.max(F.col("p") + F.col("size")).alias("end"),
            F.collect_set("at").alias("at"),  # at most the template's length
            F.first("length").alias("length"),
            F.first("size").alias("size"),
        )
    )
    whole = F.lit(False)
    for i, t in enumerate(templates):
        if t.whole:
            whole = whole | (F.col("template") == i)
    votes = votes.withColumn("whole", whole)
    # First by closeness of diagonals, so that a stray vote cannot part the diagonals around it; then by word gaps.
    across = Window.partitionBy("key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(across) > BAND, F.lit(True)) | F.col("whole")
    votes = votes.withColumn("far", far).withColumn("near", F.sum(F.when(F.col("far"), 1).otherwise(0)).over(across))
    along = Window.partitionBy("key", "template", "near").orderBy("start", "diagonal")
    gap = F.col("start") - F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)) > GAP
    votes = votes.withColumn("gap", F.coalesce(gap, F.lit(True)))
    votes = votes.withColumn("run", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(along))
    merged = votes.groupBy("key", "template", "near", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
        F.first("length").alias("length"),
        F.first("size").alias("size"),
        F.first("whole").alias("whole"),
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("size") - 1))))
    )
    merged = merged.withColumn("coverage", covered / F.col("length"))
    kept = merged.where(F.col("coverage") >= F.when(F.col("whole"), 1.0).otherwise(cover))
    names = F.create_map(*[F.lit(x) for i, t in enumerate(templates) for x in (i, t.label)])
    return kept.select("key", names[F.col("template")].alias("label"), "whole", "start", "end", "coverage")


def scan(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", templates: list[Template] = TEMPLATES, cover: float = COVER
) -> DataFrame:
    """Every row's id with its license findings.

    Adds ``n_words``, ``n_spans``, ``spans`` (label, start, end, coverage by start), ``labels`` (distinct, sorted) and
    ``score`` (the best coverage, 0 without findings).  Null and empty texts have no words and no findings; repeated
    rows each get their findings.  Only the id is kept of the input's columns.
    """
    found = spans(hits(df, templates, id_column, text), templates, cover)
    per_text = found.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "coverage", "whole"))).alias("spans")
    )
    rows = df.select(
        df[id_column].alias("__id"), row_key(df[id_column], df[text]).alias("key"), F.size(words(df[text])).alias("n_words")
    )
    out = rows.join(per_text, "key", "left")
    none = F.array().cast("array<struct<start:int,end:int,label:string,coverage:double,whole:boolean>>")
    out = out.withColumn("spans", F.coalesce("spans", none))
    return out.select(
        F.col("__id").alias(id_column),
        "n_words",
        F.size("spans").alias("n_spans"),
        "spans",
        F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
