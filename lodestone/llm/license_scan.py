"""License scans by diagonal voting, DataFrame operations only.

Every rolling k-gram of a document's words is hashed; hashes that a template has are joined to the template's positions,
and each match whose words equal the template's votes for the diagonal (document position less template position).
Diagonals at most `drift` apart merge, which allows for words added or left out; a merged span holds the share of the
template's k-grams that it has at least once, however often they repeat, and stays from `share` on. Of spans that
overlap, each word belongs to the one that matches most; a span that keeps half of its words or fewer is part of a
better one and goes. Short phrases are templates of their own with k = 2 that need every k-gram on one diagonal: their
exact places.

Defined results: null and empty texts have no words and no labels; rows are answered each for themselves, also when doc_id
is null or repeats (rows of one doc_id and text are told apart by nothing and share their answer); of a very long text
only the k-grams that a template has leave the row; an empty table gives no rows; columns other than doc_id and text,
whatever their names, are ignored; of overlapping spans that match alike the larger share wins, then the later label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that name a licence, and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Characteristic sentences of public licence texts and customary notices, and the label of each.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "under the terms of the gnu general public license version 2"),
    ("gpl-2.0", "as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    *((f"cc-{kind.replace(' ', '-')}", f"licensed under cc {kind} 4 0") for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")),
]


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, GAP), lambda w: w != "")


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.array_join(F.slice(words, i + 1, k), " ")


def _grams(words: Column, k: int, known: list[int]) -> Column:
    """(pos, h, gram) of the k-grams whose hash a template has."""
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(words, i + j) for j in range(k)]).alias("h")))
    return F.transform(F.filter(hashed, lambda g: g["h"].isin(known)), lambda g: F.struct(g["pos"].alias("pos"), g["h"].alias("h"), _gram(words, g["pos"], k).alias("gram")))


def template_grams(spark, texts: list[tuple[str, str]], k: int) -> DataFrame:
    """(template, label, need, h, gram, tpos): the k-grams of texts (label, words), need of them each. As many rows as the constants have words."""
    rows = [(i, label, len(words) - k + 1, words) for i, (label, text) in enumerate(texts) if len(words := text.split()) >= k]
    df = spark.createDataFrame(rows, "template int, label string, need int, words array<string>")
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.struct(F.xxhash64(*[F.get("words", i + j) for j in range(k)]).alias("h"), _gram(F.col("words"), i, k).alias("gram"))))
    return df.select("template", "label", "need", each.alias("tpos", "g")).select("template", "label", "need", "tpos", "g.h", "g.gram")


def diagonal_spans(hits: DataFrame, grams: DataFrame, k: int, drift: int) -> DataFrame:
    """(row, template, label, first, last, held, share): merged spans of matches. hits: (row, pos, h, gram); held: distinct places of the template."""
    votes = hits.join(F.broadcast(grams), ["h", "gram"])  # grams: of the constants
    diagonals = votes.groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.first("label").alias("label"), F.first("need").alias("need"), F.collect_set("tpos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > drift) | F.lag("diagonal").over(order).isNull()
    merged = diagonals.withColumn("span", F.sum(apart.cast("int")).over(order)).withColumn("place", F.explode("places"))
    spans = merged.groupBy("row", "template", "span").agg(F.first("label").alias("label"), F.first("need").alias("need"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"), F.countDistinct("place").alias("held"))
    return spans.select("row", "template", "label", "first", "last", "held", (F.col("held") / F.col("need")).alias("share"))


def best_spans(spans: DataFrame) -> DataFrame:
    """Of spans (row, template, label, first, last, held, share), those that are the best at more than half of their words."""
    rank = F.struct("held", "share", "label", "template", "first")
    words = spans.withColumn("rank", rank).select("row", "template", "label", "first", "last", "share", "rank", F.explode(F.sequence("first", "last")).alias("word"))
    best = words.groupBy("row", "word").agg(F.max_by(F.struct("template", "label", "first", "last", "share"), "rank").alias("s"))
    kept = best.groupBy("row", "s").agg(F.count("*").alias("n"))
    return kept.where("n * 2 > s.last - s.first + 1").select("row", "s.*")


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, k: int = 3, drift: int = 3, share: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    short, long = materialize(template_grams(spark, [(label, p) for p, label in phrases.items()], 2)), materialize(template_grams(spark, templates, k))
    hashes = [[r[0] for r in g.select("h").distinct().collect()] for g in (short, long)]  # of the constants above
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    found = words.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), _grams(F.col("words"), 2, hashes[0]).alias("short"), _grams(F.col("words"), k, hashes[1]).alias("long"))
    found = materialize(found)
    row = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text_hash").alias("row")
    one = found.where("size(short) > 0 OR size(long) > 0").select(row, "short", "long").dropDuplicates(["row"])
    hits = [one.select("row", F.explode(c).alias("g")).select("row", "g.pos", "g.h", "g.gram") for c in ("short", "long")]
    base = diagonal_spans(hits[0], short, 2, 0).where("share >= 1")
    spans = best_spans(diagonal_spans(hits[1], long, k, drift).where(F.col("share") >= share))
    by_row = base.groupBy("row").agg(F.count("*").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("first").cast("long").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base"))
    spans_by_row = spans.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("score"), F.array_sort(F.collect_list(F.struct("first", "last", "label", "share"))).alias("spans"))
    out = found.select("doc_id", "n_words", row).join(by_row, "row", "left").join(spans_by_row, "row", "left")
    none = F.array().cast("array<string>")
    base_set, more = F.coalesce("base", none), F.coalesce("more", none)
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.size(base_set) > 0, 0.5).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(base_set, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_set, more)), ",").alias("labels"), score.alias("score"), "spans",
    )
