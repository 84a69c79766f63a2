"""License scans: votes of word k-grams on the diagonals of license templates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import column, map_batches, read, utf8, words

#: Phrases of the base and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of public licences: label and wording (fixed values).
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("gpl", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("mpl", "Mozilla Public License Version 2.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Creative Commons notices: the terms that follow `by` and their names, and the versions and
#: ports of the licences (fixed values).
CC_TERMS = {"": "", "-sa": "-ShareAlike", "-nc": "-NonCommercial", "-nd": "-NoDerivatives", "-nc-sa": "-NonCommercial-ShareAlike", "-nc-nd": "-NonCommercial-NoDerivatives"}
CC_VERSIONS = ["4.0 International", "3.0 Unported", "2.5 Generic", "2.0 Generic"]
for _terms, _named in CC_TERMS.items():
    for _version in CC_VERSIONS:
        TEMPLATES.append((f"cc-by{_terms}", f"Licensed under CC BY{_terms.upper()} {_version.split()[0]}."))
        TEMPLATES.append((f"cc-by{_terms}", f"This work is licensed under a Creative Commons Attribution{_named} {_version} License."))
#: Words of a k-gram; how far neighbouring diagonals may stand apart; least share of a
#: template's words that a verified span must hold.
K, SLACK, LEAST = 3, 2, 0.8
_PHRASES = sorted(BASE)
_BASE_PATTERN = {p: re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"\x00".join(re.escape(w.encode()) for w in p.split()) + rb"(?![0-9a-z\x80-\xff])") for p in _PHRASES}


def grams(tokens: list[bytes], k: int) -> list[bytes]:
    return [b" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1)]


def templates(spark: SparkSession, k: int = K) -> DataFrame:
    """hash, gram, template, t_pos: every k-gram of the templates; a few hundred fixed rows."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        tokens = words(text.encode())
        rows += [(bytearray(g), t, i, label, len(tokens)) for i, g in enumerate(grams(tokens, k))]
    made = spark.createDataFrame(rows, "t_gram binary, template int, t_pos int, label string, t_words int")
    return made.withColumn("hash", F.xxhash64("t_gram"))


def _base(tokens: list[bytes]) -> tuple[int, int | None, int | None, str]:
    """Places of the base phrases: how many, the smallest and largest start, the labels."""
    joined = b"\x00".join(tokens)
    count, starts, labels = 0, [], set()
    ends = None  # where words end, once for all hits
    for phrase, pattern in _BASE_PATTERN.items():
        if phrase.split()[0].encode() not in joined:
            continue
        for m in pattern.finditer(joined):
            if ends is None:
                ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0)
            count += 1
            starts.append(int(np.searchsorted(ends, m.start())))
            labels.add(BASE[phrase])
    return count, min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def _places(tokens: list[bytes], known: frozenset, k: int) -> list[int]:
    """Where k-grams of known words alone start."""
    if len(tokens) < k:
        return []
    inside = np.fromiter((w in known for w in tokens), bool, len(tokens))
    full = inside[: len(tokens) - k + 1].copy()
    for i in range(1, k):
        full &= inside[i : len(tokens) - k + 1 + i]
    return np.flatnonzero(full).tolist()


def spans(docs: DataFrame, k: int = K, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """doc_id, h, label, share, first, last: verified license spans (words from first to last).

    docs: doc_id, h and text (bytes). The rolling k-grams of a text are joined to the
    templates' (a fixed table, broadcast); a k-gram with a word that is in no template can't
    join and isn't sent. Each hit votes for its document's diagonal (place less template
    place); neighbouring diagonals of up to `slack` apart merge, so that a few words more or
    fewer don't break a span; a span is verified on the words that its k-grams cover in order
    and kept from `least` of the template's words or its own, whichever are more. Of spans
    that start at one word only the best stay: a licence with further terms holds the words
    of the one without them.
    """
    spark = docs.sparkSession
    known = frozenset(w for _, text in TEMPLATES for w in words(text.encode()))

    def make():
        def step(batch: pa.RecordBatch) -> dict | None:
            owners, at, found = [], [], []
            for row, text in enumerate(column(batch, "text")):
                tokens = words(text)
                own = _places(tokens, known, k)
                owners += [row] * len(own)
                at += own
                found += [b" ".join(tokens[i : i + k]) for i in own]
            if not at:
                return None
            rows = pa.array(owners, pa.int64())
            return {"doc_id": batch.column(0).take(rows), "h": batch.column(1).take(rows), "pos": at, "gram": found}

        return step

    rolling = map_batches(docs.select("doc_id", "h", "text"), "doc_id long, h long, pos int, gram binary", make)
    hits = rolling.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(templates(spark, k)), "hash").where("gram = t_gram")
    row = ["doc_id", "h", "template", "label", "t_words"]
    votes = hits.groupBy(*row, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set(F.struct("t_pos", "pos")).alias("hits"))
    by = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > slack).cast("int"), F.lit(0))
    bands = votes.withColumn("apart", apart).withColumn("band", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = bands.groupBy(*row, "band").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["t_pos"], x["t_pos"] + k - 1)))))
    # In order: a template's later k-grams stand later in the text.
    ordered = F.filter(F.transform("hits", lambda x, i: (i == 0) | (x["pos"] >= F.get("hits", i - 1)["pos"])), lambda x: x)
    length = F.array_max("hits.pos") + k - F.array_min("hits.pos")
    share = F.when(F.size(ordered) >= F.size("hits") * least, F.least(F.lit(1.0), covered / F.greatest("t_words", length))).otherwise(0.0)
    made = merged.select("doc_id", "h", "label", share.alias("share"), (covered / F.col("t_words")).alias("cover"), F.array_min("hits.pos").alias("first"), (F.array_max("hits.pos") + k - 1).alias("last"))
    made = made.where(F.col("share") >= least)
    good = F.struct("share", "cover")
    made = made.withColumn("best", F.max(good).over(Window.partitionBy("doc_id", "h", "first")))
    return made.where(good == F.col("best")).select("doc_id", "h", "label", "share", "first", "last")


def scan(docs: DataFrame, k: int = K, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """Base places and license labels of every whole text; null texts have no words.

    One row a document, repeated rows too. score: 1 for a base phrase, else the largest share
    of a template that a span covers, else 0.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    own = own.withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [(len(tokens), *_base(tokens)) for tokens in map(words, column(batch, "text"))]
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
            return {"doc_id": batch.column(0), "h": batch.column(1)} | dict(zip(names, map(list, zip(*found, strict=True)), strict=True))

        return step

    base = map_batches(own, "doc_id long, h long, n_words long, n_base long, first_word long, last_word long, base_labels string", make)
    more = spans(own, k, slack, least).groupBy("doc_id", "h").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    more = more.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "x")
    found = base.join(more, base.doc_id.eqNullSafe(more.d) & (base.h == more.x), "left")
    known = F.filter(F.split("base_labels", ","), lambda x: x != "")
    none = F.array().cast("array<string>")
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union(known, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
