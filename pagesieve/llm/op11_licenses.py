"""License scans: blocks of text that contain most words of a license notice, as an exact set-similarity join.

Texts are cut into overlapping blocks of words and each block is a set of words. A notice
of at most w words lies whole in one block of 2w words that starts at a multiple of w, so
nothing is missed by cutting. Words are ordered by their frequency in all texts, rarest
first. With n = ceil(threshold * size of the notice) words to be shared:

* length filter: the block has n words of notices at least;
* prefix filter: block and notice share a word among the block's first ``|block| - n + 1``
  and the notice's first ``|notice| - n + 1``;
* positional filter: at the first shared word enough words are left in both.

What passes is counted on full sets. Words of no notice can't be shared, so blocks keep
only the others; that changes no filter's outcome.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .registry import query, slices, stored, table

THRESHOLD = 0.8
# Phrases whose words, side by side, name a license by themselves (fixed values).
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
# Usual wordings of license notices (fixed values).
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
# Word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: every other byte becomes a space.
BREAKS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
TO_SPACE = bytes.maketrans(BREAKS, b" " * len(BREAKS))

SCAN = "n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<step:int,block:int,words:array<int>>>, seen array<long>"


def words_of(text: bytes | str) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).lower().translate(TO_SPACE).split()


def needed(size: int, threshold: float) -> int:
    """Words a block shares with a notice of ``size`` distinct words at least."""
    return max(1, math.ceil(threshold * size - 1e-9))


class Notices:
    """Notices as word sets over one vocabulary, by the step (words, a power of two) their blocks start at."""

    def __init__(self, notices: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], threshold: float):
        split = [(label, words_of(text)) for label, text in notices]
        self.labels = [label for label, ws in split if ws]
        lists = [ws for _, ws in split if ws]
        self.phrases = [(label, words_of(text)) for label, text in phrases]
        self.vocabulary = sorted({w for ws in lists + [p for _, p in self.phrases] for w in ws})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.sets = [sorted({number[w] for w in ws}) for ws in lists]
        self.steps = [1 << max(0, (len(ws) - 1).bit_length()) for ws in lists]
        self.need = [needed(len(s), threshold) for s in self.sets]
        self.phrases = [(label, [number[w] for w in p]) for label, p in self.phrases if p]

    def classes(self) -> Iterator[tuple[int, np.ndarray, int]]:
        """(step, which vocabulary words its notices use, the least number of words needed)."""
        for step in sorted(set(self.steps)):
            mine = [i for i, s in enumerate(self.steps) if s == step]
            used = np.zeros(len(self.vocabulary) + 1, dtype=bool)
            for i in mine:
                used[self.sets[i]] = True
            yield step, used, min(self.need[i] for i in mine)


def _scan(known: Notices):
    """Tasks' side: words, phrases, and blocks that hold enough words of notices."""
    get = {w: i for i, w in enumerate(known.vocabulary)}.get
    none = len(known.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raws in slices((t.as_py() for t in batch.column("text")), 4 << 20):
                yield one(batch.column("kept").slice(start, len(raws)), raws)

    def one(kept: pa.Array, raws: Sequence[bytes]) -> pa.RecordBatch:
        lists = [words_of(t) for t in raws]
        n = np.array([len(ws) for ws in lists], dtype=np.int64)
        begin = np.cumsum(n) - n
        at = np.fromiter((get(w, none) for ws in lists for w in ws), dtype=np.int32, count=int(n.sum()))
        owner = np.repeat(np.arange(len(raws)), n)
        count, first, last = np.zeros(len(raws), dtype=np.int64), np.full(len(raws), 1 << 60), np.full(len(raws), -1)
        base = [set() for _ in raws]
        for label, phrase in known.phrases:
            k = len(phrase)
            hit = np.flatnonzero(at[: max(0, len(at) - k + 1)] == phrase[0])
            for j in range(1, k):
                hit = hit[at[hit + j] == phrase[j]]
            hit = hit[owner[hit] == owner[hit + k - 1]]
            of = owner[hit]
            np.add.at(count, of, 1)
            np.minimum.at(first, of, hit - begin[of])
            np.maximum.at(last, of, hit - begin[of])
            for d in np.unique(of):
                base[d].add(label)
        blocks = [[] for _ in raws]
        for step, used, least in known.classes():
            place = np.flatnonzero(used[at])
            if not len(place):
                continue
            of, word = owner[place], at[place].astype(np.int64)
            block = (place - begin[of]) // step
            # A word lies in the block that starts at or before it and in the one before that.
            key = np.concatenate([(of * (1 << 32) + block), (of * (1 << 32) + block - 1)[block > 0]])
            word = np.concatenate([word, word[block > 0]])
            order = np.lexsort((word, key))
            key, word = key[order], word[order]
            new = np.append(True, (key[1:] != key[:-1]) | (word[1:] != word[:-1]))
            key, word = key[new], word[new]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(heads, len(key)))
            for h, s in zip(heads[sizes >= least], sizes[sizes >= least]):
                blocks[key[h] >> 32].append((step, int(key[h] & (1 << 32) - 1), word[h : h + s].tolist()))
        seen = np.bincount(at, minlength=none + 1)[:none]
        some = count > 0
        return pa.RecordBatch.from_arrays([
            kept, pa.array(n), pa.array(count), pa.array(np.where(some, first, 0), mask=~some), pa.array(np.where(some, last, 0), mask=~some),
            pa.array([sorted(b) for b in base], pa.list_(pa.string())),
            pa.array([[{"step": a, "block": b, "words": c} for a, b, c in x] for x in blocks], pa.list_(pa.struct([("step", pa.int32()), ("block", pa.int32()), ("words", pa.list_(pa.int32()))]))),
            pa.array([seen.tolist()] + [None] * (len(raws) - 1), pa.list_(pa.int64())),
        ], ["kept", "n_words", "n_base", "first_word", "last_word", "base", "blocks", "seen"])

    return run


def scan(docs: DataFrame, text: str = "text", notices: Sequence[tuple[str, str]] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, out: str = "licenses") -> DataFrame:
    """The columns of ``docs`` but for the text, and a struct ``out``: words, phrases, and notices contained at ``threshold`` or more.

    Fields: n_words, n_base (places of phrases), first_word, last_word (their smallest and
    largest start; NULL without one), base (labels of phrases, sorted), labels (those and the
    labels of contained notices, sorted), score (1 where a phrase stands, else the greatest
    share of a notice's words found in one block, 0 below the threshold), and blocks: every
    (label, notice, from_word, words, containment) of a block that reaches the threshold,
    NULL if there is none.

    One pass over the texts. Broadcast are the notices alone, a parameter that does not grow
    with the data; all else that moves is a row per matching block. NULL texts are empty
    texts; a text of any length is cut into blocks of bounded size; repeated rows and rows
    with NULL or equal ids each get their own result; an empty table gives an empty one. An
    existing column named ``out`` is replaced, other columns stay as they are, whatever
    their names.
    """
    known = Notices(notices, phrases, threshold)
    others = [c for c in docs.columns if c not in (text, out)]
    kept = F.struct(*[docs[c] for c in others]) if others else F.struct(F.lit(0).alias("none"))
    seen = docs.select(kept.alias("kept"), docs[text].alias("text"))
    # Row numbers are written down with the rows, so a task that runs again finds the same ones.
    found = stored(seen.mapInArrow(_scan(known), StructType([seen.schema["kept"], *StructType.fromDDL(SCAN)])).withColumn("row", F.monotonically_increasing_id()), "blocks")
    best = _join(found, known).groupBy("row").agg(
        F.max("containment").alias("top"), F.collect_set("label").alias("more"), F.array_sort(F.collect_list(F.struct("label", "notice", "from_word", "words", "containment"))).alias("blocks"))
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("top", F.lit(0.0)))
    both = found.drop("blocks", "seen").join(best, "row", "left")
    return both.select(*[F.col("kept")[c].alias(c) for c in others], F.struct("n_words", "n_base", "first_word", "last_word", "base", labels.alias("labels"), score.alias("score"), "blocks").alias(out))


def _join(found: DataFrame, known: Notices) -> DataFrame:
    """(row, label, notice, from_word, words, containment) of the blocks that reach a notice's number of words."""
    spark = found.sparkSession
    # One count a vocabulary word, whatever the size of the texts.
    counts = dict(found.where("seen IS NOT NULL").select(F.posexplode("seen").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).collect())
    ranked = sorted(range(len(known.vocabulary)), key=lambda w: (counts.get(w, 0), w))
    rank = {w: r for r, w in enumerate(ranked)}
    sets = [sorted(rank[w] for w in s) for s in known.sets]
    index, whole = [], []
    for i, s in enumerate(sets):
        n = known.need[i]
        whole.append((i, known.labels[i], s))
        index += [(known.steps[i], r, i, j, len(s), n) for j, r in enumerate(s[: len(s) - n + 1])]
    index = F.broadcast(spark.createDataFrame(index, "step int, word int, notice int, j int, size int, need int"))
    whole = F.broadcast(spark.createDataFrame(whole, "notice int, label string, words array<int>"))
    least = F.create_map(*[F.lit(x) for step, _, n in known.classes() for x in (step, n)]) if sets else F.create_map().cast("map<int,int>")
    ranks = F.lit([rank[w] for w in range(len(rank))]) if rank else F.array().cast("array<int>")

    def ordered(words: Column) -> Column:
        return F.array_sort(F.transform(words, lambda w: F.element_at(ranks, w + 1)))

    blocks = found.select("row", F.inline("blocks")).select("row", "step", "block", ordered(F.col("words")).alias("words"))
    prefix = F.slice("words", F.lit(1), F.size("words") - F.element_at(least, F.col("step")) + 1)
    tokens = blocks.select("*", F.posexplode(prefix).alias("i", "word"))
    room = 1 + F.least(F.size("words") - F.col("i") - 1, F.col("size") - F.col("j") - 1)
    pairs = tokens.join(index, ["step", "word"]).where((F.size("words") >= F.col("need")) & (room >= F.col("need")))
    # A block meets a notice at one word or more of their prefixes; all of them are in one row's explosion.
    pairs = pairs.select("row", "step", "block", "words", "notice", "size", "need").distinct()
    both = pairs.withColumnRenamed("words", "have").join(whole, "notice").withColumn("shared", F.size(F.array_intersect("have", "words")))
    return both.where("shared >= need").select(
        "row", "label", "notice", (F.col("block") * F.col("step")).cast("long").alias("from_word"), (2 * F.col("step")).alias("words"),
        (F.col("shared") / F.col("size")).alias("containment"))


def _sql() -> str:
    known = Notices(NOTICES, PHRASES, THRESHOLD)
    value = lambda s: "'" + s.replace("'", "''") + "'"
    notices = ", ".join(f"({i}, {value(label)}, {known.steps[i]}, {len(known.sets[i])}, {known.need[i]}, [{', '.join(value(known.vocabulary[w].decode()) for w in known.sets[i])}])" for i, label in enumerate(known.labels))
    phrases = ", ".join(f"({value(label)}, [{', '.join(value(known.vocabulary[w].decode()) for w in p)}])" for label, p in known.phrases)
    return rf"""
WITH n(notice, label, step, size, need, words) AS (VALUES {notices}),
ph(label, words) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT rid, ph.label, p - 1 AS spot FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d) x, ph WHERE w[p] = ph.words[1] AND w[p : p + len(ph.words) - 1] = ph.words),
bs AS (SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY rid),
k AS (SELECT rid, step, unnest(range(0, len(w) // step + 1)) AS block, w FROM d, (SELECT DISTINCT step FROM n)),
s AS (SELECT rid, step, list_distinct(w[block * step + 1 : (block + 2) * step]) AS words FROM k),
m AS (SELECT rid, n.label, len(list_intersect(s.words, n.words)) AS shared, n.size, n.need FROM s JOIN n ON s.step = n.step AND len(s.words) >= n.need),
ms AS (SELECT rid, list(DISTINCT label) AS labels, max(shared / size) AS top FROM m WHERE shared >= need GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(bs.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(bs.labels, []) || coalesce(ms.labels, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(top, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN ms USING (rid)
"""


@query("op11_license_scan", _sql())
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "licenses.n_words", "licenses.n_base", "licenses.first_word", "licenses.last_word", F.array_join("licenses.base", ",").alias("base_labels"),
                             F.array_join("licenses.labels", ",").alias("labels"), "licenses.score")
