"""License statements by diagonal voting, in Spark expressions.

Templates are word sequences: the phrases that name a license, and sentences of well-known
notices.  All rolling word k-grams of all documents are joined by hash with the places of
the templates' k-grams (k = ``GRAM``, or a template's length where that is less) and
compared word by word, so a hit is a place in a document and one in a template.  Hits are
counted by diagonal, the difference of both places; diagonals of one document and template
that lie within ``slack`` of each other are merged, which bridges inserted and omitted
words.  A merged diagonal is a span if it stands up to verification: its hits cover at least
``SHARE`` of the template's words (all of a phrase's, on one diagonal), on a stretch of at
most ``STRETCH`` times the template's length.

Templates are a fixed table, so their side of the join is broadcast.  A document gives one
row for itself and one for each hit; those rows are written once and all that follows reads
them, keyed by row, so no phrase or document shared by many makes a hot key.

Null texts are empty; rows are told apart by their place in the table, so repeated rows and
null ids count on their own; an empty table gives no row; columns other than the id and the
text are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

GRAM = 3
SHARE, STRETCH = 0.6, 1.5

# fixed values: phrases and their labels
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# fixed values: sentences of public license notices and their labels
NOTICES = [
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
]

#: Characters of a word before A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _gram(words_: Column, at: Column, length: int) -> Column:
    """The words from place ``at`` with single spaces between, fewer at the end of a text."""
    return F.concat_ws(" ", *[F.get(words_, at + i) for i in range(length)])


_PLACE = ("template", "label", "base", "size", "slack", "length", "place")


def template_grams(spark: SparkSession, length: int) -> DataFrame:
    """(key, gram, places): every gram of ``length`` words, and where it stands in the templates."""
    rows = [(i, text, label, i < len(PHRASES)) for i, (text, label) in enumerate([*PHRASES, *NOTICES])]
    cut = spark.createDataFrame(rows, "template int, text string, label string, base boolean")
    cut = cut.withColumn("words", words(F.lower("text"))).withColumn("size", F.size("words"))
    cut = cut.where(F.least(F.lit(GRAM), F.col("size")) == length)
    slack = F.when(F.col("base"), 0).otherwise(F.least(F.lit(8), F.floor(F.col("size") / 4)))
    grams = cut.select(
        "template", "label", "base", "size", slack.cast("int").alias("slack"), F.lit(length).alias("length"), "words",
        F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("place"),
    ).withColumn("gram", _gram(F.col("words"), F.col("place"), length))
    places = F.collect_list(F.struct(*_PLACE))
    return grams.groupBy("gram").agg(places.alias("places")).select(F.xxhash64("gram").alias("key"), "gram", "places")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every document (``template`` is NULL, ``n_words`` is set) and one for each hit.

    A hit tells the template's ``place``, and the place ``at`` in the document.
    """
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    n = F.size("words")
    rolled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _gram(F.col("words"), i, GRAM))
    grams = F.when(n > 0, rolled).otherwise(F.array().cast("array<string>"))
    # the document's own row comes first, without a gram
    found = cut.select(
        "row", "doc_id", n.cast("long").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), grams)).alias("at", "gram"),
    )
    lengths = sorted({min(GRAM, len(phrase.split())) for phrase, _ in [*PHRASES, *NOTICES]})
    for k in lengths:
        known = template_grams(docs.sparkSession, k).select(F.col("key").alias(f"key{k}"), F.col("gram").alias(f"gram{k}"), F.col("places").alias(f"places{k}"))
        found = found.withColumn(f"raw{k}", F.substring_index("gram", " ", k)).withColumn(f"low{k}", F.lower(f"raw{k}"))
        # lower-casing turns some letters beyond ASCII into ASCII ones, which are shorter
        same = (F.col(f"low{k}") == F.col(f"gram{k}")) & (F.octet_length(f"raw{k}") == F.octet_length(f"gram{k}"))
        found = found.join(F.broadcast(known), (F.xxhash64(f"low{k}") == F.col(f"key{k}")) & same, "left")
    none = F.array().cast(found.schema[f"places{lengths[0]}"].dataType)
    places = F.concat(*[F.coalesce(F.col(f"places{k}"), none) for k in lengths])
    own = F.col("gram").isNull()
    hits = found.where(own | (F.size(places) > 0)).select(
        "row", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n_words")).alias("n_words"),
        (F.col("at") - 1).alias("at"), F.explode_outer(places).alias("p"),
    )
    return hits.select("row", "doc_id", "n_words", "at", *[F.col(f"p.{c}").alias(c) for c in _PLACE])


def spans(hits: DataFrame) -> DataFrame:
    """(row, template, label, base, start, end, votes, share): merged diagonals that stand verification."""
    diagonal = F.col("at") - F.col("place")
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal", "at")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > F.col("slack")
    merged = hits.where(F.col("template").isNotNull()).withColumn("diagonal", diagonal)
    merged = merged.withColumn("apart", F.when(apart, 1).otherwise(0)).withColumn("band", F.sum("apart").over(by_diagonal))
    covered = merged.withColumn("word", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("length") - 1)))
    shares = covered.groupBy("row", "template", "band").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"),
        F.min("at").alias("start"), F.max(F.col("at") + F.col("length")).alias("end"),
        F.count_distinct("word").alias("n"), F.count_distinct("at", "place").alias("votes"),
    ).withColumn("share", F.col("n") / F.col("size"))
    length = F.col("end") - F.col("start")
    verified = F.when(F.col("base"), F.col("n") == F.col("size")).otherwise((F.col("share") >= SHARE) & (length <= STRETCH * F.col("size")))
    return shares.where(verified).select("row", "template", "label", "base", "start", "end", "votes", "share")


def report(hits: DataFrame) -> DataFrame:
    """One row per document: words, places of phrases, labels and the best share.

    (row, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); the
    score is 0 without a span.
    """
    hits = materialize(hits, "license-hits")
    own = hits.where("template is null").select("row", "doc_id", "n_words")
    both = own.unionByName(spans(hits), allowMissingColumns=True)
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
