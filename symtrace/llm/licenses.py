"""License scans by diagonal voting.

Hashes of all rolling word k-grams of a text are joined with the positions of the templates' k-grams:
pairs of words for short phrases, ``GRAM`` words for notices. A hit votes for the diagonal that is its
place in the text less its place in the template; votes are summed by diagonal, diagonals that lie
within ``DRIFT`` of each other are merged, so that some words may be put in or left out, and a merged
span is verified: each vote compares the words themselves, and the span must cover ``COVER`` of the
template's k-grams (all of them, on one diagonal, for a phrase).

The templates are a fixed list, so their positions are broadcast. Only a row for each text and one for
each hit leave the scan.

Defined cases: null and empty texts have no words and no labels ('' for either list); a null doc_id
keeps its row; repeated rows are told apart by their place in the table; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symtrace.llm.common import Scratch
from symtrace.llm.decontaminate import words

GRAM, DRIFT, COVER = 4, 3, 0.6

#: Phrases with their labels, and the wording of common notices, in words.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOTICES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit-release", "released under the mit license"),
)


def _templates(spark: SparkSession) -> DataFrame:
    """(gram, mark, spots): for each k-gram of a template its hash and the templates and places it stands at."""
    rows = [(i, label, k, len(w) - k + 1, p, w[p : p + k]) for i, (label, text, k, w) in enumerate([*((b, a, 2, a.split()) for a, b in PHRASES), *((a, b, GRAM, b.split()) for a, b in NOTICES)]) for p in range(len(w) - k + 1)]
    t = spark.createDataFrame(rows, "template int, label string, k int, grams int, spot int, words array<string>")
    t = t.withColumn("mark", F.when(F.col("k") == 2, F.expr("xxhash64(xxhash64(words[0]), xxhash64(words[1]))")).otherwise(F.expr(f"xxhash64({', '.join(f'xxhash64(get(words, {i}))' for i in range(GRAM))})")))
    return t.groupBy("k", "mark").agg(F.collect_list(F.struct("template", "label", "grams", "spot", F.array_join("words", " ").alias("key"))).alias("spots"))


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, spans): every place of a phrase, and the merged spans of notices that hold.

    ``places`` has (start, label) and ``spans`` (start, end, label, cover), in words from 0.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "licenses")
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w")).withColumn("wh", F.expr("transform(w, x -> xxhash64(x))"))
    at = rows.select("place", "doc_id", "w", "wh", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("wh") - 2, F.lit(-1)))).alias("at"))
    pair = F.expr("case when at >= 0 then xxhash64(get(wh, at), get(wh, at + 1)) end")
    run = F.expr(f"case when at >= 0 and at + {GRAM} <= size(wh) then xxhash64({', '.join(f'get(wh, at + {i})' for i in range(GRAM))}) end")
    t = work.keep(_templates(spark), "templates")
    two = F.broadcast(t.where("k = 2").select(F.col("mark").alias("m2"), F.col("spots").alias("s2")))
    many = F.broadcast(t.where(f"k = {GRAM}").select(F.col("mark").alias("m4"), F.col("spots").alias("s4")))
    met = at.withColumn("m2", pair).withColumn("m4", run).join(two, "m2", "left").join(many, "m4", "left").where("at = -1 or s2 is not null or s4 is not null")
    hits = work.keep(met.select("place", "doc_id", F.size("wh").cast("long").alias("n_words"), "at", "s2", "s4", F.expr("case when at >= 0 then array_join(slice(w, at + 1, 2), ' ') end").alias("k2"), F.expr(f"case when s4 is not null then array_join(slice(w, at + 1, {GRAM}), ' ') end").alias("k4")), "hits")

    votes = None
    for spots, key, k in (("s2", "k2", 2), ("s4", "k4", GRAM)):
        one = hits.where(F.col(spots).isNotNull()).select("place", "at", F.col(key).alias("key"), F.explode(spots).alias("s"))
        one = one.where("key = s.key").select("place", "at", F.lit(k).alias("k"), "s.template", "s.label", "s.grams", "s.spot")
        votes = one if votes is None else votes.union(one)
    diagonal = votes.groupBy("place", "k", "template", "label", "grams", (F.col("at") - F.col("spot")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("spot").alias("spots"))
    diagonal = work.keep(diagonal, "diagonals")
    phrases = diagonal.where("k = 2 and votes = grams").groupBy("place").agg(F.array_sort(F.collect_list(F.struct(F.col("first").cast("long").alias("start"), "label"))).alias("places"))
    order = Window.partitionBy("place", "template").orderBy("diagonal")
    merged = diagonal.where(f"k = {GRAM}").withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int")).withColumn("band", F.sum(F.coalesce("new", F.lit(0))).over(order))
    bands = merged.groupBy("place", "template", "label", "grams", "band").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("met"))
    bands = bands.withColumn("cover", F.col("met") / F.col("grams")).where(F.col("cover") >= COVER)
    notices = bands.groupBy("place").agg(F.array_sort(F.collect_list(F.struct(F.col("first").cast("long").alias("start"), (F.col("last") + GRAM).cast("long").alias("end"), "label", "cover"))).alias("spans"))
    each = hits.where("at = -1").select("place", "doc_id", "n_words").dropDuplicates(["place"])
    out = each.join(phrases, "place", "left").join(notices, "place", "left")
    return out.select("doc_id", "n_words", F.coalesce("places", F.expr("cast(array() as array<struct<start:bigint,label:string>>)")).alias("places"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint,label:string,cover:double>>)")).alias("spans"))
