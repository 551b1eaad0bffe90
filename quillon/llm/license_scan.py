"""License scans by an exact set-similarity join of texts' blocks with templates.

For a template of L words, a text's blocks are the 2L words from each multiple of L on, so any stretch of L words lies
within one. A block meets a template if it contains a share of the template's distinct words or more. Words are ordered by
how often they occur in the whole corpus, rare ones first; a block can only meet a template with n words, of which it
needs m, if it has one of the template's first n - m + 1 words (prefix filter), has m known words at all (length filter),
and if, in a walk of both in that order, what is still to come on either side can bring the shared words up to m
(positional filter). So only blocks about a rare word of a template are looked at, and none that meets it is missed.

Templates are a fixed short list, so they travel to every task; documents are read in place, twice: to count and to scan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .terms import terms

#: Phrases whose words stand consecutively, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Customary notices of public licenses, and their labels.
TEMPLATES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org", "apache-2"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
]
#: Share of a template's distinct words, in hundredths, that a block needs.
PERCENT = 90

SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, begin: long, end: long, containment: double>>"


class Templates:
    """Templates and their words in the order of their numbers, rare ones first."""

    def __init__(self, templates: list[tuple[str, str]], percent: int, counts: dict[bytes, int]) -> None:
        own = [(terms(text), label) for text, label in templates]
        words = sorted({w for found, _ in own for w in found}, key=lambda w: (counts.get(w, 0), w))
        self.number = {w: k for k, w in enumerate(words)}
        self.labels = [label for _, label in own]
        self.lengths = [len(found) for found, _ in own]
        self.words = [sorted({self.number[w] for w in found}) for found, _ in own]
        self.needs = [-(-percent * len(w) // 100) for w in self.words]
        #: Templates by the words of their prefixes.
        self.prefix: dict[int, list[int]] = {}
        for t, (words_of, need) in enumerate(zip(self.words, self.needs, strict=True)):
            for w in words_of[: len(words_of) - need + 1]:
                self.prefix.setdefault(w, []).append(t)

    def shared(self, template: int, block: list[int]) -> int:
        """How many words of a template are in a block (its distinct numbers in order); 0 if fewer than it needs."""
        own, need = self.words[template], self.needs[template]
        if len(block) < need:
            return 0
        i = j = n = 0
        while i < len(own) and j < len(block):
            if n + min(len(own) - i, len(block) - j) < need:
                return 0
            if own[i] == block[j]:
                i, j, n = i + 1, j + 1, n + 1
            elif own[i] < block[j]:
                i += 1
            else:
                j += 1
        return n if n >= need else 0

    def matches(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, block, shared words) of all blocks of a text that meet a template, in order."""
        at = list(map(self.number.get, text))
        places = [i for i, w in enumerate(at) if w is not None]
        blocks = {(t, b) for i in places for t in self.prefix.get(at[i], ()) for b in (i // self.lengths[t], i // self.lengths[t] - 1) if b >= 0}
        out = []
        for t, b in sorted(blocks):
            begin = b * self.lengths[t]
            block = sorted({w for w in at[begin : begin + 2 * self.lengths[t]] if w is not None})
            if n := self.shared(t, block):
                out.append((t, b, n))
        return out


def places_of(phrase: bytes, joined: bytes) -> list[int]:
    """The words of a text, from 0, at which a phrase begins; both as words with a space before and after each."""
    out, at, words, done = [], joined.find(phrase), 0, 0
    while at >= 0:
        words, done = words + joined.count(b" ", done, at), at
        out.append(words)
        at = joined.find(phrase, at + 1)
    return out


def word_counts(docs: DataFrame, words: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each of a few words occurs in all texts."""
    known = sorted(words)
    number = {w: k for k, w in enumerate(known)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(x for x in map(number.get, terms(text.as_py())) if x is not None)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    # As many rows as there are words at most.
    return {known[r.word]: r.n for r in docs.selectExpr(f"`{text_col}` as text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    n_base counts the places at which a phrase begins, first_word and last_word are the first and last of them (null: none).
    matches has the blocks, words [begin, end), that contain ``percent`` hundredths of a template's distinct words or
    more. labels has the phrases' labels and the templates', each once, in order, joined by commas. The score is 1 where
    a phrase stands, else the greatest containment of a match, else 0. Null and empty texts have no words and no label.
    Texts of any length are read whole; rows are independent: repeated rows and null ids give a result each, other
    columns are ignored, whatever their names, and an empty table gives an empty result.
    """
    source = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    own = Templates(templates, percent, word_counts(source, {w for text, _ in templates for w in terms(text)}))
    sought = [(b" " + b" ".join(terms(text)) + b" ", label) for text, label in phrases]
    schema = to_arrow_schema(StructType.fromDDL(SCAN))

    def scanned(doc: int | None, text: str | None) -> dict:
        words = terms(text)
        joined = b" " + b" ".join(words) + b" "
        base = [(at, label) for phrase, label in sought for at in places_of(phrase, joined)]
        met = own.matches(words)
        shares = [n / len(own.words[t]) for t, _, n in met]
        spans = [{"label": own.labels[t], "begin": b * own.lengths[t], "end": min((b + 2) * own.lengths[t], len(words)), "containment": x} for (t, b, _), x in zip(met, shares, strict=True)]
        named = {label for _, label in base}
        places = [at for at, _ in base]
        return {
            "doc_id": doc, "n_words": len(words), "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(named)),
            "labels": ",".join(sorted(named | {own.labels[t] for t, _, _ in met})), "score": 1.0 if base else max(shares, default=0.0), "matches": spans,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [scanned(doc, text.as_py()) for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return source.mapInArrow(run, SCAN)


def _oracle() -> str:
    def rows(texts: list[tuple[str, str]]) -> str:
        return ", ".join(f"({k}, '{label}', {len(own)}, [{', '.join(repr(w.decode()) for w in own)}])" for k, (own, label) in enumerate((terms(t), lab) for t, lab in texts))

    return rf"""
WITH p(k, label, n, ws) AS (VALUES {rows(PHRASES)}), t(k, label, n, ws) AS (VALUES {rows(TEMPLATES)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
pw AS (SELECT k, label, n, unnest(ws) AS word, unnest(range(n)) AS j FROM p),
base AS (SELECT doc_id, k, any_value(label) AS label, i - j AS place FROM w JOIN pw USING (word) GROUP BY doc_id, k, i - j, n HAVING count(*) = n AND i - j >= 0),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM base GROUP BY 1),
tw AS (SELECT DISTINCT k, label, n, len(list_distinct(ws)) AS size, unnest(ws) AS word FROM t),
m AS (SELECT doc_id, k, any_value(label) AS label, count(DISTINCT word) / any_value(size) AS x
      FROM (SELECT *, unnest([i // n, i // n - 1]) AS block FROM w JOIN tw USING (word)) WHERE block >= 0 GROUP BY doc_id, k, block HAVING 100 * count(DISTINCT word) >= {PERCENT} * any_value(size)),
l AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM m) GROUP BY 1),
s AS (SELECT doc_id, max(x) AS x FROM m GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(x, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""


ORACLE = _oracle()
