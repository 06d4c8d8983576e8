"""License scans by diagonal voting, in DataFrame functions only.

Words are the runs of letters and digits of the lower-cased text. All rolling word k-grams
of a text are hashed and joined with the positions of the same hashes in the templates. A
hit votes for the diagonal (place in the text minus place in the template); neighbouring
diagonals of a long template merge, which bridges inserted or deleted words. A template
shorter than k words votes with k-grams of its own length, so its diagonal is one exact
place. Hits are verified word by word, and a span counts if it covers enough of its template.

Defined results: a null text is empty; repeated rows are scanned once each; a text without
words yields zeros, nulls and empty strings; overlapping places all count. The templates
are a small fixed table, so their side of the join is broadcast. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from shelfmark.llm.common import ascii_lower

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 5
DRIFT = 3
LEAST_COVER = 0.6
#: The number of the mark that every text has.
MARK = -1
#: The mark's hash, a place that no gram takes.
NOTHING = 0

# Phrases whose places all count, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Wordings of licence notices, with their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is dedicated to the public domain": "public-domain",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}


def _grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str], k: int) -> DataFrame:
    """Rows ``hash, gram, template, label, base, at, size, grams`` of all templates' k-grams, and the mark."""
    rows = [(MARK, "", False, 0, 0, 1, "")]
    for number, (text, label) in enumerate([*phrases.items(), *templates.items()]):
        words = text.split()
        size = min(k, len(words))
        rows += [(number, label, number < len(phrases), at, size, len(words) - size + 1, " ".join(words[at : at + size])) for at in range(len(words) - size + 1)]
    names = ("template", "label", "base", "at", "size", "grams", "gram")
    held = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])))
    parts = F.split("gram", " ")
    hashed = F.lit(NOTHING).cast("bigint")
    for n in sizes(phrases, templates, k):
        hashed = F.when(F.col("size") == n, F.xxhash64(*[F.get(parts, F.lit(j)) for j in range(n)])).otherwise(hashed)
    return held.withColumn("hash", hashed)


def sizes(phrases: dict[str, str], templates: dict[str, str], k: int) -> list[int]:
    return sorted({min(k, len(t.split())) for t in [*phrases, *templates]})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, k: int = K, drift: int = DRIFT, least: float = LEAST_COVER) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words`` and ``spans``.

    A span is ``(start, end, template, label, base, cover)``: word places, the end
    exclusive, and the share of the template's k-grams found.
    """
    spark = docs.sparkSession
    lengths = sizes(phrases, templates, k)
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.array_remove(F.split(ascii_lower(F.coalesce(text_col, F.lit(""))), WORD_BREAK), "").alias("words"),
    )

    def rolling(n: int):
        return F.when(
            F.size("words") >= n,
            F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(n)])),
        ).otherwise(F.array().cast("array<bigint>"))

    # outer forms of explode: the others infer a filter on the array's size, which would split the text once more for each word
    # every text also has one mark, found in no template, so that texts without a hit stay
    mark = F.array(F.lit(NOTHING).cast("bigint"))
    rolls = F.array(mark, *[rolling(n) for n in lengths])
    grams = words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.explode_outer(rolls).alias("roll"))
    placed = grams.select("row", "doc_id", "n_words", "words", F.posexplode_outer("roll").alias("place", "hash"))
    hits = placed.join(F.broadcast(_grams(spark, phrases, templates, k)), "hash")
    same = F.lit(False)
    for n in lengths:
        gram = F.concat_ws(" ", *[F.get("words", F.col("place") + j) for j in range(n)])
        same = F.when(F.col("size") == n, gram == F.col("gram")).otherwise(same)
    verified = hits.where((F.col("size") == 0) | same).select("row", "doc_id", "n_words", "template", "label", "base", "grams", "size", "at", F.col("place").cast("long").alias("place"))
    votes = verified.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "size", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("votes")
    )
    order = W.partitionBy("row", "template").orderBy("diagonal")
    # a short template's diagonals are places of their own and never merge
    step = F.when((F.col("grams") > 1) & (F.col("diagonal") - F.lag("diagonal").over(order) <= drift), 0).otherwise(1)
    merged = votes.withColumn("step", step).withColumn("band", F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)))
    bands = merged.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "size", "band").agg(
        F.min("first").alias("start"), F.max("last").alias("last"), F.sum("votes").alias("votes")
    )
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    span = F.struct("start", (F.col("last") + F.col("size")).alias("end"), "template", "label", "base", cover.alias("cover"))
    good = bands.withColumn("span", F.when((F.col("template") != MARK) & (cover >= least), span))
    return good.groupBy("row", "doc_id", "n_words").agg(F.sort_array(F.collect_list("span")).alias("spans")).drop("row")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and score from the spans."""
    base = F.filter("spans", lambda s: s["base"])
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
