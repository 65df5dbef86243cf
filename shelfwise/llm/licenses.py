"""Licence scan: phrases in place, and licence passages found by an exact set-similarity join.

Words are runs of characters other than ASCII ones that are neither letters nor digits, A-Z in lower case. Base: places where a phrase's words
stand one after the other; its label is given to the text.

The method adds labels: a text's blocks are its windows of ``window`` words, one at every half window (the last one shorter), so that
any stretch of up to half a window stands whole in one, on one line or wrapped. A block meets a template if it holds at least
``threshold`` of the template's different words, and ``least`` of them (all, if it has fewer). All such pairs are found by a join:

- Words of templates are ordered by how many blocks of the corpus hold them, rarest first; others cannot count and are left out.
- Prefix: of a template with n words, m of them needed, a block holds one of the first n - m + 1; of a block's words in
  order, it is among the first of as many less m, plus one.
- Length: a block has at least m words of templates.
- Position: the first word that both share, at i and j, leaves room for m in all: 1 + min(n - i - 1, size - j - 1) >= m.
- Pairs left are verified by their common words.

Texts are read twice: to count words of templates in blocks, and for places and blocks that hold a word of a prefix. Both are
sums or rows in proportion to the text; templates are broadcast, at most :data:`MOST_TEMPLATE_WORDS` words in all.

Null or empty texts have no words and no labels. Repeated rows are rows of their own. Ties: of overlapping hits with one label all are kept, by
place. An empty table gives an empty result. The input's columns stay in the struct ``row``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import saved, small_batches, strings, table_saved

MOST_TEMPLATE_WORDS = 20_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences by which licences are told, as they publish them.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "This work is licensed under a Creative Commons License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("eclipse", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


@dataclass(frozen=True)
class Scan:
    threshold: float = 0.8
    least: int = 5
    window: int = 64

    def needed(self, words: int) -> int:
        """Words of a template that a block must hold."""
        return max(math.ceil(self.threshold * words - 1e-9), min(words, self.least))


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def windows(n: int, window: int) -> list[tuple[int, int]]:
    """(first word, word behind the last) of the blocks of n words."""
    half = window // 2
    return [(at, min(at + window, n)) for at in range(0, max(n - half, 1), half)] if n else []


def places(words: list[bytes], phrases: dict[bytes, list[bytes]]) -> list[tuple[int, bytes]]:
    """(word number, phrase) of every place where the words of a phrase stand one after the other."""
    line, out = b" %s " % b" ".join(words), []
    for joined in phrases:
        at = line.find(joined)
        while at >= 0:
            out.append((line.count(b" ", 0, at + 1) - 1, joined))
            at = line.find(joined, at + 1)
    return sorted(out)


def _templates(templates: list[tuple[str, str]], how: Scan) -> list[tuple[int, str, list[bytes], int]]:
    """(number, label, different words, words needed) of each template."""
    out = []
    for i, (label, text) in enumerate(templates):
        words = words_of(text.encode())
        if not words or len(words) > how.window // 2:
            raise ValueError(f"a template has 1 to {how.window // 2} words: {text!r}")
        out.append((i, label, sorted(set(words)), how.needed(len(set(words)))))
    if sum(len(t[2]) for t in out) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have {MOST_TEMPLATE_WORDS} words at most")
    return out


def word_order(docs: DataFrame, templates: list[tuple[str, str]], how: Scan = Scan(), text: str = "text") -> list[bytes]:
    """The words of templates by the number of blocks in all documents that hold them, rarest first, ties by the word."""
    vocabulary = {w for t in _templates(templates, how) for w in t[2]}
    window, half = how.window, how.window // 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in small_batches(batches):
            for t in strings(batch.column(0)):
                words = words_of(t)
                if len(words) <= window:
                    total.update(vocabulary.intersection(words))
                    continue
                halves = [vocabulary.intersection(words[i : i + half]) for i in range(0, len(words), half)]
                for a, b in windows(len(words), window):
                    total.update(set().union(*halves[a // half : -(-b // half)]))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    known = {bytes(r["word"]): r["n"] for r in counts.collect()}  # words of templates only
    return sorted(vocabulary, key=lambda w: (known.get(w, 0), w))


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
    how: Scan = Scan(), text: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the columns of the input, or those to ``keep``: it is saved) with n_words, ``found``: (start, label) of every phrase in place, in order, and ``hits``: (start, end, label, score) of every block and
    template that meet, the score being the share of the template's words."""
    made = _templates(templates, how)
    order = {w: i for i, w in enumerate(word_order(docs, templates, how, text))}
    ranked = [(i, label, sorted(order[w] for w in words), m) for i, label, words, m in made]
    firsts = {r for _, _, ranks, m in ranked for r in ranks[: len(ranks) - m + 1]}
    least = min((m for *_, m in made), default=1)
    first_words = {w for w, i in order.items() if i in firsts}
    labels = {b" %s " % b" ".join(words_of(p.encode())): label for p, label in phrases.items()}
    joined = {p: p.split() for p in labels}
    window = how.window

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, found, blocks = [], [], []
            for t in strings(batch.column(1)):
                words = words_of(t)
                sizes.append(len(words))
                found.append([{"start": i, "label": labels[p]} for i, p in places(words, joined)])
                own = []
                if not first_words.isdisjoint(words):
                    for a, b in windows(len(words), window):
                        ranks = {order[w] for w in words[a:b] if w in order}
                        if len(ranks) >= least and not firsts.isdisjoint(ranks):
                            own.append({"start": a, "end": b, "ranks": sorted(ranks)})
                blocks.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, _FOUND), pa.array(blocks, _BLOCKS)], names=["row", "n_words", "found", "blocks"],
            )

    names = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    rows = docs.select(F.struct(*names).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = rows.select(
        "row", F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast("array<struct<start: bigint, label: string>>").alias("found"),
        F.lit(None).cast("array<struct<start: bigint, end: bigint, ranks: array<int>>>").alias("blocks"),
    ).schema
    kept = table_saved(rows.mapInArrow(read, schema).withColumn("id", F.monotonically_increasing_id()))
    hits = containing(kept.select("id", F.explode("blocks").alias("b")).select("id", "b.start", "b.end", "b.ranks"), ranked, how)
    hits = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).alias("hits"))
    empty = F.array().cast("array<struct<start: bigint, end: bigint, label: string, score: double>>")
    return kept.join(saved(hits), "id", "left").select("row", "n_words", "found", F.coalesce("hits", empty).alias("hits"))


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
_BLOCKS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ranks", pa.list_(pa.int32()))]))


def containing(blocks: DataFrame, ranked: list[tuple[int, str, list[int], int]], how: Scan = Scan()) -> DataFrame:
    """(id, start, end, label, score) of every block that holds enough words of a template.

    ``blocks``: id, start, end, ranks (different, in order); ``ranked``: number, label, ranks in order, words needed.
    """
    spark = blocks.sparkSession
    index = spark.createDataFrame(
        [(i, label, ranks, m, at, r) for i, label, ranks, m in ranked for at, r in enumerate(ranks[: len(ranks) - m + 1])],
        "template int, label string, words array<int>, needed int, at int, rank int",
    )
    least = min((m for *_, m in ranked), default=1)
    prefix = F.slice("ranks", F.lit(1), F.size("ranks") - least + 1)
    met = blocks.filter(F.size("ranks") >= least).select("id", "start", "end", "ranks", F.posexplode(prefix).alias("place", "rank"))
    met = met.join(F.broadcast(index), "rank")
    room = F.lit(1) + F.least(F.size("words") - F.col("at") - 1, F.size("ranks") - F.col("place") - 1)
    met = met.filter((F.size("ranks") >= F.col("needed")) & (room >= F.col("needed")))
    common = F.array_intersect("words", "ranks")
    # a pair is met once for each word that both prefixes hold: the first of them in order stands for it
    met = met.withColumn("common", common).filter((F.size("common") >= F.col("needed")) & (F.array_min("common") == F.col("rank")))
    return met.select("id", "start", "end", "label", (F.size("common") / F.size("words")).alias("score"))
