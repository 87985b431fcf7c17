"""Licence scans: each file's rarest licence words are looked up in a positional index of the wordings; key phrases are checked word by word."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.common import UPPER, ascii_lower, let, words_of

#: What parts words: all ASCII characters but digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence's wording. key: the phrase in it that must stand whole, word by word."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


def _phrase(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    return Template(label, text, key or text, base)


#: How many of a file's own rarest words of a template are looked up, besides the rarest of its key phrase.
LOOKED_UP = 3
#: Wordings of public licences, in lower case.
TEMPLATES = (
    _phrase("mit", "under the mit license", base=True),
    _phrase("apache-2", "apache license version 2", base=True),
    _phrase("cc-by-nc", "cc by nc", base=True),
    _phrase(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "hereby granted free of charge",
    ),
    _phrase("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions"),
    _phrase(
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "as is without warranty of any kind express or implied",
    ),
    _phrase("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    _phrase("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    _phrase(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you can redistribute it and or modify it",
    ),
    _phrase("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    _phrase("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    _phrase(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    _phrase(
        "bsd",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "may be used to endorse or promote products derived from this software",
    ),
    _phrase("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _phrase("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    _phrase("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _phrase("cc0", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    _phrase("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    _phrase("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def word_counts(docs: DataFrame, words: list[str], *, text_col: str = "text") -> dict[str, int]:
    """In how many documents each of the given words stands; "" counts all documents. One row a word reaches the driver."""
    known = F.array(*[F.lit(w) for w in words])
    found = F.array_intersect(words_of(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP), known)
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in ["", *words]} | {r["w"]: r["count"] for r in rows}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, and matches: array of (template, label, base, start, score, votes).

    A first pass counts, over all documents, how rare each licence word is. In
    the second, the words that a file shares with the templates are put in order
    of IDF. Of each template whose key words it has, the LOOKED_UP rarest that
    the file has are looked up, whichever these are, and the rarest of the key
    phrase. The postings of all of them give where the template would start;
    there its key phrase is checked word by word. start: the template's first
    word, from 0 (below 0 where the text begins inside it); votes: how many of
    the words looked up stand in their place from that start; score: the part of
    the template's words that do, so a reworded licence with a whole key phrase
    keeps its label and scores below 1.

    Every place of a key phrase is found, since its rarest word stands there and
    is looked up. Ties: of equally rare words, the one that sorts first is
    looked up, which changes votes alone. No shuffle of texts. Null and empty text:
    no words, no matches. Null ids and repeated rows pass through. Further
    columns of docs are not read. Very long texts: time in proportion to their
    words. Empty table: no rows.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    counts = word_counts(docs, vocabulary, text_col=text_col)
    by_idf = F.array(*[F.lit(w) for w in sorted(vocabulary, key=lambda w: (counts[w], w))])
    keys = [F.split(F.lit(t.key), " ") for t in templates]
    fewest = min((len(set(t.key_words)) for t in templates), default=0)
    kind = "array<struct<template:int,label:string,base:boolean,start:int,score:double,votes:int>>"
    nothing = F.array().cast(kind)

    def rarest(mine: Column) -> Column:
        """Of each template, the words to look up: none where a key word is missing."""

        def of(t: Template, key: Column) -> Column:
            own = F.slice(F.array_intersect(mine, F.split(F.lit(t.text), " ")), 1, LOOKED_UP)
            return let(F.array_intersect(mine, key), lambda c: F.when(F.size(c) == len(set(t.key_words)), F.array_union(F.slice(c, 1, 1), own)).otherwise(F.array().cast("array<string>")))

        return F.array(*[of(t, key) for t, key in zip(templates, keys, strict=True)])

    def matches(w: Column, chosen: Column) -> Column:
        def of(k: int, t: Template, key: Column, hits: Column) -> Column:
            text = F.split(F.lit(t.text), " ")

            def starts(word: Column) -> Column:
                """A start for each of the word's places in the file and each in the template."""
                here = F.filter(F.transform(text, lambda x, j: F.when(x == word, j)), lambda j: j.isNotNull())
                return F.flatten(F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: F.transform(here, lambda j: h["i"] - j)))

            voted = F.array_distinct(F.flatten(F.transform(chosen[k], starts)))
            whole = F.filter(voted, lambda s: (s + t.key_at >= 0) & (F.slice(w, F.greatest(s + t.key_at, F.lit(0)) + 1, len(t.key_words)) == key))

            def told(s: Column) -> Column:
                same = F.filter(text, lambda x, j: F.get(w, s + j).eqNullSafe(x))
                votes = F.size(F.array_intersect(chosen[k], same))
                return F.struct(F.lit(k).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.alias("start"), (F.size(same) / F.lit(float(len(t.words)))).alias("score"), votes.alias("votes"))

            return F.when(F.size(chosen[k]) == 0, nothing).otherwise(F.transform(F.array_sort(whole), told))

        def looked_up(words: Column) -> Column:
            hits = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(words, x), F.struct(x.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
            return let(hits, lambda h: F.concat(*[of(k, t, key, h) for k, (t, key) in enumerate(zip(templates, keys, strict=True))]))

        return let(F.array_distinct(F.flatten(chosen)), lambda words: F.when(F.size(words) == 0, nothing).otherwise(looked_up(words)))

    def scanned(w: Column) -> Column:
        some = let(F.array_intersect(by_idf, w), lambda mine: F.when(F.size(mine) < fewest, nothing).otherwise(let(rarest(mine), lambda chosen: matches(w, chosen))))
        return F.struct(F.size(w).cast("long").alias("n_words"), some.alias("matches"))

    words = words_of(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP)
    return docs.select(F.col(id_col), let(words, scanned).alias("_s")).select(id_col, "_s.*")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_licenses() over all documents."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"].cast("long"))
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


_ROWS = ", ".join(
    f"({k}, '{t.label}', {str(t.base).lower()}, {j}, '{w}', {str(t.key_at <= j < t.key_at + len(t.key_words)).lower()}, {len(t.key_words)}, {len(t.words)})" for k, t in enumerate(TEMPLATES) for j, w in enumerate(t.words)
)
ORACLE_SQL = rf"""
WITH template(t, label, base, j, x, in_key, key_n, n) AS (VALUES {_ROWS}),
d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{GAP}'), lambda x: x <> '') AS w FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d
), found AS (
  SELECT doc_id, t, label, base, i - j AS s, count(*) / any_value(n)::DOUBLE AS score
  FROM word JOIN template USING (x) GROUP BY doc_id, t, label, base, i - j HAVING count(*) FILTER (WHERE in_key) = any_value(key_n)
), told AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN told USING (doc_id)
"""
