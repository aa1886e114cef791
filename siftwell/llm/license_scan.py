"""License scans: phrase places and an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A text block is any run of consecutive words as long as the template, wherever lines end; a shorter document is one block. Template tokens are ranked by how many
documents hold them, rarest first. A block can contain a share t of a template only if one of the template's first |T| - ceil(t|T|) + 1 tokens stands in it
(prefix filter), the document has at least ceil(t|T|) words (length filter), and from that token on enough of the ranked tokens stand
around it (positional filter). The blocks around the places that are left are verified by their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, sized_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
INDEX_BROADCAST = 100_000  # prefix tokens of all templates, each with its template's tokens

# Phrases that count as base places.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Template sentences of common public licenses.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def lowered(text: str) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def words(text: str) -> Column:
    return F.array_remove(F.split(lowered(text), DELIMITERS), "")


def _places(ws: str, text: Column, phrase: str) -> Column:
    """Word positions at which the phrase's words stand consecutively."""
    tokens = phrase.split()
    present = text.contains(tokens[0])
    for t in tokens[1:]:
        present = present & text.contains(t)
    w = F.col(ws)

    def here(i: Column) -> Column:
        hit = F.get(w, i) == tokens[0]
        for k, t in enumerate(tokens[1:], 1):
            hit = hit & (F.get(w, i + k) == t)
        return hit

    last = F.size(w) - len(tokens)
    return F.when(present & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def token_order(docs: DataFrame, tokens: Sequence[str], text: str = "text") -> list[str]:
    """The template tokens, those in the fewest documents first (ties by name). Counted over all documents; the result is as long as the template vocabulary."""
    vocabulary = F.array(*map(F.lit, sorted(tokens)))
    held = docs.select(F.explode(F.array_intersect(vocabulary, words(text))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def blocks(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """(digest, template, label, start, length, share): every block of each different text that holds the threshold of a template.

    digest is the MD5 of the text, start the block's first word and length its words. Windows of the template's length that overlap are one block, told by the one that holds most, the first of
    equal ones; the next block begins behind it. Null and empty texts hold nothing.
    """
    bags = [(k, set(t.split()), len(t.split()), label) for k, (t, label) in enumerate(templates)]
    order = token_order(docs, sorted(set().union(*(b for _, b, _, _ in bags))), text)
    rank = {t: i for i, t in enumerate(order)}
    entries = []
    for k, bag, length, label in bags:
        need, tokens = math.ceil(threshold * len(bag) - 1e-9), sorted(bag, key=rank.__getitem__)
        entries += [(t, k, need, length, tokens, label) for t in tokens[: len(bag) - need + 1]]
    index = docs.sparkSession.createDataFrame(entries, "token string, template int, need int, length int, t_tokens array<string>, label string")
    rare = F.array(*map(F.lit, sorted({e[0] for e in entries})))

    texts = docs.select(_digest(text).alias("digest"), words(text).alias("w")).where(F.arrays_overlap("w", rare))
    places = texts.select("digest", "w", F.posexplode("w").alias("p", "token")).join(sized_broadcast(index, len(entries), INDEX_BROADCAST), "token").where(F.size("w") >= F.col("need"))
    first = F.greatest(F.lit(0), F.col("p") - F.col("length") + 1)
    last = F.greatest(first, F.least(F.col("p"), F.size("w") - F.col("length")))
    around = places.select("digest", "template", "label", "token", "need", "length", "t_tokens", first.alias("first"), last.alias("last"), F.slice("w", first + 1, last - first + F.col("length")).alias("around"))
    shared = F.array_intersect("t_tokens", "around")  # in the order of the ranks
    near = around.where(F.size(shared) - F.array_position(shared, F.col("token")) + 1 >= F.col("need"))
    held = F.transform(
        F.sequence("first", "last"),
        lambda s: F.struct(s.cast("int").alias("start"), F.size(F.array_intersect(F.col("t_tokens"), F.slice("around", s - F.col("first") + 1, F.col("length")))).alias("held")),
    )
    enough = near.select("digest", "template", "label", "length", F.size("t_tokens").alias("size"), F.explode(F.filter(held, lambda h: h["held"] >= F.col("need"))).alias("h"))
    windows = enough.groupBy("digest", "template", "label", "length", "size").agg(F.array_sort(F.collect_set("h")).alias("windows"))

    def picked(kept: Column, h: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = last.isNull() | (h["start"] >= last["start"] + F.col("length"))
        return F.when(apart, F.concat(kept, F.array(h))).when(h["held"] > last["held"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(h))).otherwise(kept)

    apart = F.aggregate("windows", F.array().cast("array<struct<start: int, held: int>>"), picked)
    return windows.select("digest", "template", "label", "length", "size", F.inline(apart)).select("digest", "template", "label", "start", "length", (F.col("held") / F.col("size")).alias("share"))


def scan(docs: DataFrame, text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """docs without its text, with n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (columns of these names are replaced, whatever their case).

    blocks holds (label, start, length, share) of every block of every template; score is their largest share, or 1 where a base phrase stands. Null and empty texts
    have no words and no labels. What is found depends on the text alone and is joined back by its digest, so repeated rows, equal ids and null ids are
    safe; any other column may have any name. Very long texts are split into words whole, one at a time. An empty table gives an empty result.
    """
    mine = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    kept = [c for c in docs.columns if c.lower() not in mine and c != text]
    bare = docs.select(F.struct(*[docs[c] for c in kept]).alias("row") if kept else F.lit(None).alias("row"), docs[text].alias("text"))
    split = bare.select("row", _digest("text").alias("digest"), lowered("text").alias("low"), words("text").alias("w"))
    at = split.select("row", "digest", "w", F.array(*[F.struct(F.lit(label).alias("label"), _places("w", F.col("low"), p).alias("places")) for p, label in phrases]).alias("at"))
    places = F.flatten(F.transform("at", lambda a: a["places"]))
    rows = at.select(
        "row",
        "digest",
        F.size("w").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(F.filter("at", lambda a: F.size(a["places"]) > 0), lambda a: a["label"]))).alias("base"),
    )
    found = blocks(docs.select(docs[text].alias("text")), "text", templates, threshold).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("label", "start", "length", "share"))).alias("blocks"))
    joined = rows.join(found, "digest", "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce(F.col("blocks.label"), none)))
    return joined.select(
        *[F.col("row")[c].alias(c) for c in kept], "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("blocks.share")), F.lit(0.0))).alias("score"), "blocks",
    )
