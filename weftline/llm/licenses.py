"""Licence scans by diagonal voting over rolling word k-gram hashes.

Every k-gram hash of every text is joined, in Spark, to the positions of that k-gram in
the licence templates. A hit at text word p and template word q votes for the diagonal
p - q; votes are aggregated by text, template and diagonal, and neighbouring diagonals (a few
words inserted or left out) are merged into chains. A chain is aligned: its spans are runs of
hits that go forward in text and template alike, so each position of the template counts once
and repeats of a phrase are spans of their own. A span is verified by the share of the
template's own positions that it covers. Base phrases are templates that must be covered
wholly on one diagonal.

The join side is the templates: it is broadcast up to ``BROADCAST`` positions, beyond that
joined by a shuffle on the hashes. Rows after the join
are one for each text plus its hits, so no text or phrase, however common, grows faster
than its occurrences. A hash has 64 bits.

Defined results: null and empty texts have no words, no labels and score 0; ids may be
null or repeated, each row gets its own result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lists, mapped, table
from .textkit import ALNUM_SEP, LOWER, chunks, find_words, gram_hashes, signed, starts_of, word_hashes

K = 2
#: Phrases of the contract, each with its label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Well-known notices by label (public texts, as their licences give them).
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "gpl": [
        "licensed under the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License"],
    "agpl": ["GNU Affero General Public License"],
    "0bsd": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License", "Mozilla Public License Version 2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International License"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "cc0": ["CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "wtfpl": ["Do What The Fuck You Want To Public License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: K-grams of nothing but these words cast no votes for long templates: they stand everywhere.
FUNCTION_WORDS = set("a an and any as at be by for in is it of on or that the this to with".split())
#: Diagonals this near each other belong to one span; a template's span must cover this share of its votes.
NEAR = 3
COVERAGE = 0.85
#: Positions of templates (some 100 bytes each) that are broadcast.
BROADCAST = 1 << 18


def hashes_of(texts: list[str]) -> list[np.ndarray]:
    """K-gram hashes of texts, by their own words."""
    out = []
    for c in chunks(pa.array(texts, pa.string())):
        data = LOWER[c.data]
        words = find_words(c, data, ALNUM_SEP)
        grams = gram_hashes(word_hashes(data, words), K)
        out += [grams[a : max(a, b - K + 1)] for a, b in zip(words.row_from, words.row_to, strict=True)]
    return out


def _words(text: str) -> list[str]:
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    keep = np.where(ALNUM_SEP[raw], 0x20, raw).astype(np.uint8)
    return keep.tobytes().decode().split(" ")


def template_positions(base: dict, templates: dict) -> list[tuple]:
    """(hash, template, label, is_base, position, votes): votes, how many positions the template has."""
    out = []
    for is_base, items in ((True, [(p, label) for p, label in base.items()]), (False, [(t, label) for label, ts in templates.items() for t in ts])):
        for text, label in items:
            words = [w for w in _words(text) if w]
            rare = [is_base or not {*words[q : q + K]} <= FUNCTION_WORDS for q in range(len(words) - K + 1)]
            grams = signed(hashes_of([text])[0])
            out += [(int(grams[q]), text, label, is_base, q, sum(rare)) for q in range(len(rare)) if rare[q]]
    return out


def rolling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, n_words, grams: all K-gram hashes in order, and a 0 at the end."""

    def find(batch):
        for c in chunks(batch.column(2)):
            data = LOWER[c.data]
            words = find_words(c, data, ALNUM_SEP)
            grams = gram_hashes(word_hashes(data, words), K)
            ok = starts_of(words, K, len(grams))
            counts = np.maximum(words.count - K + 1, 0)
            to = np.cumsum(counts + 1)
            out = np.zeros(to[-1], np.uint64)
            place = np.ones(len(out), bool)
            place[to - 1] = False
            out[place] = np.maximum(grams[ok], 1)
            yield {"rid": batch.column(0).slice(c.first, c.rows), "doc_id": batch.column(1).slice(c.first, c.rows), "n_words": words.count, "grams": lists(signed(out), counts + 1, pa.int64())}

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, find, "rid long, doc_id long, n_words long, grams array<long>")


def align(hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(hits, first p, last p) of the spans of a chain, largest first; hits: (p, q).

    A span's hits go forward in p and q, by diagonals at most NEAR apart; spans do not overlap.
    """
    if not hits:
        return []
    hits = sorted(hits)
    reach = max(q for _, q in hits) - min(q for _, q in hits) + NEAR
    size, back, low = [], [], 0
    for i, (p, q) in enumerate(hits):
        while hits[low][0] < p - reach:
            low += 1
        most, came = 0, -1
        for j in range(i - 1, low - 1, -1):  # the nearest of equals
            at, place = hits[j]
            if size[j] > most and at < p and place < q and abs(p - q - at + place) <= NEAR:
                most, came = size[j], j
        size.append(most + 1)
        back.append(came)
    out: list[tuple[int, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []
    for i in sorted(range(len(hits)), key=lambda i: (-size[i], i)):
        first, last = i, hits[i][0]
        while back[first] >= 0:
            first = back[first]
        start = hits[first][0]
        k = bisect(starts, last)  # spans taken before this place begin at or before its end
        if k and ends[k - 1] >= start:
            continue
        starts.insert(k, start)
        ends.insert(k, last)
        out.append((size[i], start, last))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("n", "start", "last")])))
def _spans(diagonals: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("n", "start", "last"), s, strict=True)) for s in align([(int(d) + int(q), int(q)) for d, qs in zip(ds, each, strict=True) for q in qs])] for ds, each in zip(diagonals, places, strict=True)], dtype=object)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict = BASE, templates: dict = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of verified templates."""
    spark = docs.sparkSession
    places = template_positions(base, templates)
    known = spark.createDataFrame(places, "h long, template string, label string, is_base boolean, q long, votes long")
    each = rolling(docs, id_col, text_col).select("rid", "doc_id", "n_words", F.posexplode("grams").alias("p", "h"))
    hits = each.join(F.broadcast(known) if len(places) <= BROADCAST else known, "h", "left").where("h = 0 OR template IS NOT NULL")
    owner = ["rid", "doc_id", "n_words"]
    kind = ["template", "label", "is_base", "votes"]
    diagonals = hits.groupBy(*owner, *kind, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.count("*").alias("n"), F.min("q").alias("low"), F.max("q").alias("high"), F.collect_set("q").alias("places"))
    by_place = Window.partitionBy(*owner, *kind).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_place) > F.when(F.col("is_base"), 0).otherwise(NEAR), F.lit(True))
    one = F.array(F.struct("n", (F.col("diagonal") + F.col("low")).alias("start"), (F.col("diagonal") + F.col("high")).alias("last")))
    chains = (
        diagonals.withColumn("chain", F.sum(apart.cast("int")).over(by_place))
        .groupBy(*owner, *kind, "chain")
        .agg(F.sort_array(F.collect_list(F.struct("diagonal", "places"))).alias("parts"), F.first(one).alias("one"))
    )
    single = F.size("parts") < 2
    parts = F.when(single, F.array().cast(diagonals.select(F.array(F.struct("diagonal", "places"))).schema[0].dataType)).otherwise(F.col("parts"))
    ready = chains.withColumn("aligned", _spans(F.transform(parts, lambda x: x["diagonal"]), F.transform(parts, lambda x: x["places"])))
    spans = (
        ready.select(*owner, *kind, F.explode(F.when(single, F.col("one")).otherwise(F.col("aligned"))).alias("s"))
        .select(*owner, *kind, "s.*")
        .withColumn("covered", F.col("n") / F.col("votes"))
        .withColumn("found", F.col("template").isNotNull() & F.when(F.col("is_base"), F.col("covered") == 1).otherwise(F.col("covered") >= COVERAGE))
    )
    at = F.when(F.col("found") & F.col("is_base"), F.col("start"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy(*owner).agg(
        F.count(at).alias("n_base"),
        F.min(at).alias("first_word"),
        F.max(at).alias("last_word"),
        joined(F.when(F.col("found") & F.col("is_base"), F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("found"), F.col("label"))).alias("labels"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("start", (F.col("last") + K).alias("end"), "label", "covered")))).alias("spans"),
    )


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def licence_places(spark, sf_dir: str) -> DataFrame:
    """The columns of op7_licenses that SQL can express."""
    return op7_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


PLACES_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT r, unnest(range(len(words))) AS i, unnest(words) AS a, unnest(list_concat(words[2:], [''])) AS b, unnest(list_concat(words[3:], ['', ''])[:len(words)]) AS c FROM w),
f AS (SELECT r, i, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label FROM i),
g AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f WHERE label IS NOT NULL GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (r)
"""
