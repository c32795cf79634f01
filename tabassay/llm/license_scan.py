"""License statements as an exact set-similarity join of text blocks with templates.

A block is a sentence or line, or a seam: the words around the end of a sentence or
line, where statements stand that are wrapped or hold an abbreviation. For a template of
n words a seam has the last n - 1 words of its sentence or line and the n - 1 words
after it, so n words in a row lie in one block wherever they are cut. A block's set and a
template's are their distinct words. A pair meets the threshold when the block holds at
least that share of the template's words. Words are put in order of their frequency over
all documents, rarest first.
Then a block can only meet a template if it holds one of the template's few rarest
words (prefix filter), has enough words (length filter), and enough words are left
from the first common one on both sides (positional filter). What passes is verified
whole. Words outside all templates never count, so blocks are cut down to the rest.

Also counted are the places where given phrases stand word by word.

Everything is DataFrame expressions. Defined results: a null text is an empty one;
rows with equal ids are judged each for itself, and rows equal in id and text have one
result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels, and templates of license statements.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files",
    ),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("gpl", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl", "this program is free software you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met"),
    ("mpl-2", "this Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_END = r"[\r\n]+|(?<=[.!?])\s+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def _lower(text: Column | str) -> Column:
    return F.lower(text)


def _spaced(text: Column) -> Column:
    """Words of the text with one blank before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), _lower(text), F.lit(" ")), NOT_WORD, " ")


def word_frequencies(docs: DataFrame, words: Sequence[str], text_col: str = "text") -> DataFrame:
    """How often each of these words stands in all texts."""
    every = docs.select(F.explode(F.split(_spaced(F.col(text_col)), " ")).alias("word"))
    return every.filter(F.col("word").isin(*words)).groupBy("word").count()


def _seams(texts: DataFrame, id_col: str, reach: int) -> DataFrame:
    """A row for each block and the ``reach`` words on either side of its end, nearest first."""
    lines = F.transform(
        F.split("text", BLOCK_END),
        lambda line, k: F.struct(
            k.alias("block"),
            F.filter(F.split(_lower(line), NOT_WORD), lambda w: w != "").alias("words"),
        ),
    )
    ends = F.transform(
        F.filter(lines, lambda x: F.size(x["words"]) > 0),
        lambda x: F.struct(
            x["block"].alias("block"),
            F.slice(F.reverse(x["words"]), 1, reach).alias("last"),
            F.slice(x["words"], 1, reach).alias("first"),
        ),
    )
    # Every block left has a word, so the next ``reach`` blocks hold enough.
    texts = texts.select(id_col, "text_key", ends.alias("ends"))

    def following(k: Column) -> Column:
        return F.aggregate(
            F.slice("ends", k + 2, reach),
            F.array().cast("array<string>"),
            lambda words, x: F.when(F.size(words) >= reach, words).otherwise(
                F.concat(words, x["first"])
            ),
        )

    around = F.transform(
        F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0))),
        lambda x, k: F.struct(
            x["block"].alias("block"), x["last"].alias("before"),
            F.slice(following(k), 1, reach).alias("after"),
        ),
    )
    return texts.select(id_col, "text_key", F.explode(around).alias("seam")).select(
        id_col, "text_key", "seam.block", "seam.before", "seam.after"
    )


def _index(
    docs: DataFrame, templates: Sequence[tuple[str, str]], threshold: float, text_col: str
) -> tuple[list[str], list[tuple]]:
    """Template words from rare to frequent; a row for each template and prefix word."""
    sets = [(label, set(_words(text))) for label, text in templates]
    vocabulary = sorted(set().union(*(words for _, words in sets)))
    counts = {r["word"]: r["count"] for r in word_frequencies(docs, vocabulary, text_col).collect()}
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {word: k for k, word in enumerate(ordered)}
    rows = []
    for number, (label, words) in enumerate(sets):
        own = sorted(place[w] for w in words)
        need = ceil(threshold * len(own) - 1e-9)
        reach = len(_words(templates[number][1])) - 1
        for k in range(len(own) - need + 1):
            rows.append((own[k], number, label, k, need, own, reach))
    return ordered, rows


def matching_blocks(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every block and template that meet the threshold.

    Columns: the id, ``text_key`` (hash and length of the text), ``block`` (number in
    the text of the sentence or line, or of the one that a seam follows), ``template``
    (number), ``label`` and ``containment`` (the greatest of the block and its seam).
    """
    ordered, rows = _index(docs, templates, threshold, text_col)
    index = docs.sparkSession.createDataFrame(
        rows,
        "word int, template int, label string, place int, need int, wanted array<int>, reach int",
    )
    least, reach = min(r[4] for r in rows), max(r[6] for r in rows)
    known = F.array(*[F.lit(w) for w in ordered])
    numbers = F.create_map(*[F.lit(x) for k, w in enumerate(ordered) for x in (w, k)])
    # A text or seam without any prefix word has no matching block.
    prefix = sorted({ordered[r[0]] for r in rows})
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    texts = texts.filter(_spaced(F.col("text")).rlike(f" (?:{'|'.join(prefix)}) "))
    texts = texts.select(id_col, text_key(F.col("text")).alias("text_key"), "text")
    blocks = texts.select(
        id_col, "text_key", F.posexplode(F.split("text", BLOCK_END)).alias("block", "line")
    )
    none = F.array().cast("array<int>")
    sets = blocks.select(
        id_col, "text_key", "block",
        F.array_intersect(F.split(_lower("line"), NOT_WORD), known).alias("words"),
    ).filter(F.size("words") >= least)
    sets = sets.select(
        id_col, "text_key", "block",
        F.transform("words", lambda w: F.element_at(numbers, w)).alias("words"),
        none.alias("before"), none.alias("after"),
    )
    seams = _seams(texts, id_col, reach)
    both = F.concat("before", "after")
    seams = seams.filter(
        F.arrays_overlap(both, F.array(*[F.lit(w) for w in prefix]))
        & (F.size(F.array_intersect(both, known)) >= least)
    )

    def placed(words: str) -> Column:
        # try_element_at gives null for a word of no template, which keeps its place.
        return F.transform(words, lambda w: F.try_element_at(numbers, w))

    seams = seams.select(
        id_col, "text_key", "block", placed("before").alias("before"), placed("after").alias("after")
    )
    seams = seams.select(
        id_col, "text_key", "block",
        F.array_compact(F.array_distinct(F.concat("before", "after"))).alias("words"),
        "before", "after",
    )
    found = sets.union(seams).withColumn("words", F.array_sort("words"))
    probes = found.select(
        id_col, "text_key", "block", "words", "before", "after",
        F.posexplode("words").alias("at", "word"),
    )
    left = F.size("words") - F.col("at")
    right = F.size("wanted") - F.col("place")
    pairs = probes.join(F.broadcast(index), "word").filter(
        (F.size("words") >= F.col("need")) & (F.least(left, right) >= F.col("need"))
    )
    near = F.concat(*[F.slice(side, F.lit(1), F.col("reach")) for side in ("before", "after")])
    own = F.when(F.size("before") > 0, near).otherwise(F.col("words"))
    common = F.array_intersect("wanted", own)
    return (
        pairs.withColumn("common", common)
        .filter((F.size("common") >= F.col("need")) & (F.array_min("common") == F.col("word")))
        .groupBy(id_col, "text_key", "block", "template", "label")
        .agg(F.max(F.size("common") / F.size("wanted")).alias("containment"))
    )


def text_key(text: Column) -> Column:
    """What tells texts of one id apart: two hashes and the length."""
    return F.concat_ws(":", F.xxhash64(text), F.crc32(text), F.length(text))


def _starts(words: Column, phrase: list[str], label: str) -> Column:
    """(label, start) of each place in ``words`` where the phrase stands."""

    def stands(at: Column) -> Column:
        same = F.lit(True)
        for k, word in enumerate(phrase):
            same &= F.get(words, at + k) == word
        return same

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), stands)
    return F.transform(starts, lambda s: F.struct(F.lit(label).alias("label"), s.alias("start")))


def phrase_places(
    docs: DataFrame, phrases: Mapping[str, str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id, ``text_key``, ``n_words`` and ``places`` of every row.

    ``places`` lists (label, start word) of each place where a phrase's words stand
    one after the other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, text_key(text).alias("text_key"), _spaced(text).alias("spaced"))
    # Each blank but the last begins a word.
    blanks = F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit("")))
    has = {p: F.col("spaced").contains(f" {' '.join(_words(p))} ") for p in phrases}
    some = F.array_contains(F.array(*has.values()), True)
    # Words are cut apart once, and only in the texts that hold a phrase.
    rows = rows.withColumn("words", F.when(some, F.split(F.trim("spaced"), " ")))
    none = F.array().cast("array<struct<label:string,start:int>>")
    places = F.concat(
        *[
            F.when(has[p], _starts(F.col("words"), _words(p), label)).otherwise(none)
            for p, label in phrases.items()
        ]
    )
    return rows.select(
        id_col, "text_key", (blanks - 1).cast("long").alias("n_words"), places.alias("places"),
    )


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Phrases and template matches of every row.

    Columns: the id, ``n_words``, ``places``, ``labels`` (of phrases and templates,
    sorted) and ``score`` (the greatest containment, 1 where a phrase stands).
    """
    found = (
        matching_blocks(docs, templates, threshold, id_col, text_col)
        .groupBy(F.col(id_col).alias("match_id"), F.col("text_key").alias("match_key"))
        .agg(F.collect_set("label").alias("of_templates"), F.max("containment").alias("most"))
    )
    rows = phrase_places(docs, phrases, id_col, text_col)
    same = rows[id_col].eqNullSafe(found["match_id"]) & (rows["text_key"] == found["match_key"])
    none = F.array().cast("array<string>")
    labels = F.array_union(
        F.transform("places", lambda p: p["label"]), F.coalesce("of_templates", none)
    )
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return rows.join(found, same, "left").select(
        id_col, "n_words", "places", F.array_sort(F.array_distinct(labels)).alias("labels"),
        score.alias("score"),
    )
