"""License scans: an exact set-similarity join of blocks of text with templates.

A text is read in blocks of words that overlap by half, so that whatever is no longer than a template lies whole in one of them. A block
holds a template if it has ``PERCENT`` of the template's different words. Words are ordered by how often they occur in the whole
corpus, rarest first. A template that needs ``need`` of its words shares one of its ``size - need + 1`` rarest (its prefix) with each
block that holds it: blocks without any such word never leave their task, and the others meet templates by an equi-join on it. The length
filter (a block has ``need`` words of templates at least) and the positional filter (enough words are left in both behind the common
one) are conditions of the join; what passes is counted exactly.

A template may be *exact*: its blocks count at the places where its words stand consecutively, each place in one block only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package, small_batches, stage_table

#: Different words of a template that a block must have, of 100.
PERCENT = 80
#: A block is two strides long; a stride is at least so many words, and as long as the longest template.
STRIDE = 32
#: Words of all templates at most: their ranks go to every task.
MOST_WORDS = 1_000_000


class Template(NamedTuple):
    label: str
    text: str
    exact: bool = False


# Phrases that name a license, and opening words of the notices of public licenses.
TEMPLATES = [
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
]

#: Bytes of words: ASCII digits and letters, in lower case, and all that isn't ASCII; the others part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCKS = "array<struct<start:long,words:array<int>>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def stride_of(templates: list[Template]) -> int:
    return max(STRIDE, *(len(words_of(t.text.encode())) for t in templates))


def needed(size: int, percent: int = PERCENT) -> int:
    """How many of ``size`` words a block must have."""
    return max(1, -(-percent * size // 100))


def word_ranks(texts: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """The words of templates by their number in all texts, rarest first, equal ones by their bytes. The driver gets a row for each word at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in small_batches(batches, 0):
            for text in batch.column(0):
                total.update(filter(words.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    seen = dict(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect())
    seen = {bytes(w): n for w, n in seen.items()}
    return {w: k for k, w in enumerate(sorted(words, key=lambda w: (seen.get(w, 0), w)))}


def _candidates(docs: DataFrame, ranks: dict[bytes, int], prefixes: set[bytes], stride: int) -> DataFrame:
    """Each row's ``id, n_words`` and its blocks with a word of some template's prefix: ``start`` and the ranks of its words, -1 for those of no template."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, blocks = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                sizes.append(len(words))
                if prefixes.isdisjoint(words):
                    blocks.append([])
                    continue
                at = {i // stride for i, w in enumerate(words) if w in prefixes}
                at |= {k - 1 for k in at if k}
                blocks.append([{"start": k * stride, "words": [ranks.get(w, -1) for w in words[k * stride : (k + 2) * stride]]} for k in sorted(at)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(blocks, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.list_(pa.int32()))])))], ["id", "n_words", "blocks"])

    return docs.mapInArrow(find, f"id long, n_words long, blocks {_BLOCKS}")


def _prefix_index(docs: DataFrame, templates: list[Template], ranks: dict[bytes, int], percent: int) -> DataFrame:
    """A row for each word of each template's prefix: ``rank, place`` and the template."""
    rows = []
    for k, t in enumerate(templates):
        words = [ranks[w] for w in words_of(t.text.encode())]
        own = sorted({*words})
        need = needed(len(own), 100 if t.exact else percent)
        rows += [(r, i, k, t.label, t.exact, own, need, words) for i, r in enumerate(own[: len(own) - need + 1])]
    return docs.sparkSession.createDataFrame(rows, "rank int, place int, template int, label string, exact boolean, own array<int>, need int, phrase array<int>")


def _matches(blocks: DataFrame, index: DataFrame, stride: int) -> DataFrame:
    """``row, template, label, exact, start, containment, places`` of blocks (``row, start, words``) that hold a template."""
    own = blocks.select("row", "start", "words", F.array_sort(F.array_distinct(F.filter("words", lambda x: x >= 0))).alias("known"))
    size, left = F.size("known"), F.size("known") - F.col("j") - 1
    pairs = own.select("*", F.posexplode("known").alias("j", "rank")).join(index, "rank")
    pairs = pairs.where((size >= F.col("need")) & (1 + F.least(F.size("own") - F.col("place") - 1, left) >= F.col("need")))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("known", "own"))).where("common >= need")
    pairs = pairs.withColumn("places", F.expr(f"CASE WHEN exact AND size(words) >= size(phrase) THEN transform(filter(sequence(0, least({stride - 1}, size(words) - size(phrase))), p -> slice(words, p + 1, size(phrase)) = phrase), p -> start + p) ELSE array() END"))
    pairs = pairs.where("NOT exact OR size(places) > 0")
    return pairs.groupBy("row", "start", "template").agg(*[F.first(c).alias(c) for c in ("label", "exact", "places")], F.first(F.col("common") / F.size("own")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches``.

    ``n_base`` counts the places of exact templates, ``first_word`` and ``last_word`` are the first and last of them (null without any), and ``base_labels``
    their labels; ``labels`` has those of the other templates too. ``score`` is 1 where there is such a place, else the largest share of a
    template in a block of those that hold one, else 0. ``matches`` has every block that holds a template: label, whether exact, its first
    word, share, and places.
    A null text is empty and has no words; rows of null or repeated identifiers are scanned each; an empty table gives an empty table; other
    columns are ignored. Templates without words, or of more than ``MOST_WORDS`` words, are an error.
    """
    templates = TEMPLATES if templates is None else templates
    sizes = [len(words_of(t.text.encode())) for t in templates]
    if not templates or not all(sizes) or sum(sizes) > MOST_WORDS:
        raise ValueError(f"templates need words, {MOST_WORDS} at most")
    ship_package(docs.sparkSession)
    stride = stride_of(templates)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("body"))
    ranks = word_ranks(rows.select("body"), {w for t in templates for w in words_of(t.text.encode())})
    index = _prefix_index(docs, templates, ranks, percent)
    rare = {r.rank for r in index.select("rank").collect()}
    found = _candidates(rows, ranks, {w for w, r in ranks.items() if r in rare}, stride).withColumn("row", F.when(F.size("blocks") > 0, F.expr("uuid()")))
    found = stage_table(found, "blocks")

    matches = _matches(found.where("row IS NOT NULL").select("row", F.inline("blocks")), index, stride)
    places = F.flatten(F.collect_list("places"))
    by_row = matches.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "label", "exact", "containment", "places"))).alias("matches"), places.alias("places"), F.max("containment").alias("share"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base"), F.array_sort(F.collect_set("label")).alias("every"))
    kind = "array<struct<start:long,label:string,exact:boolean,containment:double,places:array<long>>>"

    def result(n: Column, places: Column, base: Column, every: Column, share: Column, matches: Column) -> list[Column]:
        score = F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))
        return ["id", "n_words", n.alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), F.coalesce(matches, F.array().cast(kind)).alias("matches")]

    n = F.greatest(F.coalesce(F.size("places"), F.lit(0)), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    some = found.where("row IS NOT NULL").join(by_row, "row", "left").select(*result(n, F.col("places"), F.coalesce("base", none), F.coalesce("every", none), F.col("share"), F.col("matches").cast(kind)))
    return found.where("row IS NULL").select(*result(F.lit(0).cast("long"), F.lit(None).cast("array<long>"), none, none, F.lit(0.0), F.lit(None).cast(kind))).unionByName(some)
