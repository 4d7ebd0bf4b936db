"""License scans (operator 7): an exact containment join of text blocks with notice templates.

A template is a notice of n words, as a set. Its blocks in a text are all stretches of SPREAD * n words in
a row (the whole text if that is shorter), wherever its lines break. A block meets a template if it holds
at least threshold of the template's distinct words. The join is exact and filtered:

- order: the words of the templates are ordered by their number of texts in the whole corpus, rarest first;
- prefix: a block that meets a template holds one of the template's first size - ceil(threshold * size) + 1
  words in that order. An inverted index leads from these words to the templates, so a text is tried
  against those alone, and only around the places where such a word stands;
- length: a block has at least ceil(threshold * size) distinct words;
- position: the template's words are looked up in order, and as soon as more are missing than threshold
  allows, the words that remain cannot make up for it and the block is left.

The templates are a fixed, small table, so they travel with the tasks; texts never leave theirs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, UPPER, text_of, with_text

#: Phrases whose places are counted, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices that are looked for by containment, with their labels; whole ones first, then the short forms.
TEMPLATES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "unlicense",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "This library is licensed under the GNU Lesser General Public License.": "lgpl",
    "Subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "All rights reserved.": "reserved",
}

#: Share of a template's words that a block must hold.
THRESHOLD = 0.9
#: Words in a row that a block has for each word of its template.
SPREAD = 1.25

#: Words over the UTF-8 bytes of a text whose A-Z are lower-cased: ASCII letters and digits, all else that is not ASCII.
FIND_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words_of(text: str) -> list[bytes]:
    return FIND_WORDS(text.encode().lower())


def span_of(template: str) -> int:
    """Words in a block of the template."""
    return math.ceil(SPREAD * len(words_of(template)) - 1e-9)


def need_of(size: int, threshold: float) -> int:
    """Distinct words of a template of that size that a block holds at least."""
    return max(1, math.ceil(threshold * size - 1e-9))


class Template:
    """A notice's distinct words in global order, with what the filters need."""

    def __init__(self, text: str, label: str, threshold: float, frequency: dict[bytes, int]):
        self.label, self.span = label, span_of(text)
        self.words = frozenset(words_of(text))
        self.ordered = sorted(self.words, key=lambda word: (frequency.get(word, 0), word))
        self.need = need_of(len(self.ordered), threshold)
        self.spare = len(self.ordered) - self.need
        self.prefix = self.ordered[: self.spare + 1]

    def may_meet(self, have: set[bytes]) -> bool:
        """The length and position filters: whether have can hold need of the words."""
        if len(have) < self.need:
            return False
        missing = 0
        for word in self.ordered:
            missing += word not in have
            if missing > self.spare:
                return False
        return True

    def best(self, words: list[bytes], around: list[int]) -> tuple[int, int]:
        """The most distinct words of the template in one of its blocks, and where the first such block starts.

        around are the places of prefix words; each block that can meet the template holds one of them. A block
        is taken to start at one of the template's words: one that starts elsewhere holds no more.
        """
        found = (0, 0)
        done = 0  # blocks that start before have been tried
        for place in around:
            start = max(done, place - self.span + 1)
            done = place + 1
            if not self.may_meet(set(words[start : place + self.span])):
                continue
            inside: Counter[bytes] = Counter()
            end = start
            for first in range(start, place + 1):
                while end < min(first + self.span, len(words)):
                    if words[end] in self.words:
                        inside[words[end]] += 1
                    end += 1
                if words[first] in self.words:
                    if len(inside) > found[0]:
                        found = (len(inside), first)
                    inside[words[first]] -= 1
                    if not inside[words[first]]:
                        del inside[words[first]]
        return found


class Scanner:
    """The templates behind an inverted index of their prefix words, and the phrases."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], threshold: float, frequency: dict[bytes, int]):
        self.phrases = [(words_of(phrase), label) for phrase, label in phrases.items()]
        self.templates = [Template(text, label, threshold, frequency) for text, label in templates.items()]
        self.index: dict[bytes, list[int]] = {}
        for k, template in enumerate(self.templates):
            for word in template.prefix:
                self.index.setdefault(word, []).append(k)
        self.starts = {phrase[0] for phrase, _ in self.phrases}

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """Each place where a phrase stands: its start, counted in words, and its label."""
        if self.starts.isdisjoint(words):
            return []
        found = []
        for phrase, label in self.phrases:
            at = -1
            for _ in range(words.count(phrase[0])):
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    found.append((at, label))
        return sorted(found)

    def matches(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """Each template that a block meets: where its best block starts, label, share of the template's words."""
        have = set(words)
        places: dict[int, list[int]] = {}
        if not self.index.keys().isdisjoint(have):
            for place, word in enumerate(words):
                for k in self.index.get(word, ()):
                    places.setdefault(k, []).append(place)
        found = []
        for k, around in places.items():
            template = self.templates[k]
            if template.may_meet(have):
                overlap, start = template.best(words, around)
                if overlap >= template.need:
                    found.append((start, template.label, overlap / len(template.ordered)))
        return sorted(found)


def _text_counts(vocabulary: frozenset[bytes]):
    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return run


def text_frequency(df: DataFrame, templates: dict[str, str], text_col: str = "text") -> dict[bytes, int]:
    """How many texts of the corpus hold each word of the templates (one number for each such word).

    This is one more reading of the corpus; it makes the prefixes out of the words that are rarest in this
    corpus, so that few texts are tried further.
    """
    vocabulary = frozenset(chain.from_iterable(map(words_of, templates)))
    counts = df.select(text_of(text_col).alias("text")).mapInArrow(_text_counts(vocabulary), "word string, n bigint")
    return {row.word.encode(): row.n for row in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


RESULT = "n_words bigint, places array<struct<start: bigint, label: string>>, matches array<struct<start: bigint, label: string, share: double>>"


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, places and matches of each row's whole text.

    places lists where a phrase's words stand consecutively (also across lines), matches the templates
    that a block meets, with the first word of the best block (the first of equals) and its share. Null and empty texts have no words, places or matches. Rows are scanned one
    by one: repeated rows and ids stay, nulls in other columns do not matter, an empty table stays empty.
    """
    with_text(df, text_col)
    frequency = text_frequency(df, templates, text_col)
    rows = df.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    match = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))

    def run(batches):
        own = Scanner(templates, phrases, threshold, frequency)
        for batch in batches:
            sizes, places, matches = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                places.append([{"start": a, "label": b} for a, b in own.places(words)])
                matches.append([{"start": a, "label": b, "share": c} for a, b, c in own.matches(words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(matches, match)], names=[id_col, "n_words", "places", "matches"])

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {RESULT}")


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of plain columns for each row of scan()."""
    labels = lambda c: F.col(f"{c}.label")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        join(labels("places")).alias("base_labels"),
        join(F.concat(labels("places"), labels("matches"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.share"), F.lit(0.0))).alias("score"),
    )


def scan_sql() -> str:
    """summary(scan(documents)) in DuckDB SQL."""
    pattern = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    places = [f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + {len(p) - 1}] = {quoted(p)}), lambda i: {{'s': i - 1, 'l': '{label}'}})" for p, label in ((words_of(x), y) for x, y in PHRASES.items())]
    found = []
    for text, label in TEMPLATES.items():
        have = sorted(set(words_of(text)))
        starts = f"list_filter(range(1, len(ws) + 1), lambda i: list_contains({quoted(have)}, ws[i]))"
        best = f"list_max(list_transform({starts}, lambda i: len(list_intersect(ws[i:i + {span_of(text) - 1}], {quoted(have)}))))"
        found.append(f"{{'l': '{label}', 'c': CASE WHEN len(list_intersect(vs, {quoted(have)})) >= {need_of(len(have), THRESHOLD)} THEN {best} ELSE 0 END / {len(have)}::DOUBLE}}")
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {pattern}) AS ws FROM documents),
v AS (SELECT *, list_distinct(ws) AS vs FROM w),
p AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             list_concat({places[0]}, list_concat({places[1]}, {places[2]})) AS ps,
             list_filter([{", ".join(found)}], lambda x: x.c >= {THRESHOLD} - 1e-9) AS ms FROM v)
SELECT doc_id, n_words, len(ps)::BIGINT AS n_base,
       list_min(list_transform(ps, lambda x: x.s))::BIGINT AS first_word, list_max(list_transform(ps, lambda x: x.s))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(ps, lambda x: x.l))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(ps, lambda x: x.l), list_transform(ms, lambda x: x.l)))), ',') AS labels,
       CASE WHEN len(ps) > 0 THEN 1.0::DOUBLE ELSE coalesce(list_max(list_transform(ms, lambda x: x.c)), 0.0) END AS score
FROM p"""
