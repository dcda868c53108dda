"""Licence scans: a positional index of the rarest words of licence templates, over whole texts.

A template is a licence's own wording (a phrase, a notice, a header's sentence) as words, with key phrases that must stand
in it. One pass counts in how many documents each template word occurs; a template's anchors are its words of highest IDF,
so many that a place which agrees in ``need`` words agrees in two anchors at least. A file's anchor words are looked up in
the index, their postings shifted to the place where the template would begin, and places that two anchors share are
verified against all words and the key phrases. So counts decide the work and never the result.

Cases: null and empty texts have no words and no match; texts of any length are read whole; a template lies wholly inside
a text; overlapping matches are all given; repeated rows match alike; an empty table gives no rows (and anchors in the order
of words); a column of the result's name is replaced. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.arrays import ALNUM, Powers, slices, span_hashes, word_bounds
from lexmill.session import ship_package, table

#: Share of a template's words that must stand in their places; templates of fewer than SHORT words match whole.
SHARE_PERCENT = 80
SHORT = 12
#: Anchors that a match shares at least.
SHARED = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def need(self) -> int:
        n = len(self.words)
        return n if n < SHORT else -(-n * SHARE_PERCENT // 100)

    @property
    def must(self) -> list[bool]:
        """Which words belong to a key phrase."""
        words = self.words
        out = [False] * len(words)
        for key in self.keys:
            k = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            out[at : at + len(k)] = [True] * len(k)
        return out


#: The phrases of the contract, then the licences' own wording, in lower-case words.
TEMPLATES = [
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("cc0", "waived all copyright and related or neighboring rights to"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("bsl-1.0", "boost software license version 1 0"),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        ("gnu general public license as published by the free software foundation",),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
]

MATCH = "struct<template:int,label:string,base:boolean,first_word:long,n_words:long,matched:long,begin:long,end:long>"
FOUND = f"struct<n_words:long,matches:array<{MATCH}>>"


def _hashes(words: list[str], powers: Powers) -> np.ndarray:
    ends = np.cumsum([len(w.encode()) for w in words])
    return span_hashes(np.frombuffer("".join(words).encode(), np.uint8), np.concatenate([[0], ends[:-1]]), ends, powers, True)


class Words:
    """Texts as word hashes, and the numbers of those that templates have."""

    def __init__(self, templates: list[Template]) -> None:
        self.powers = Powers()
        self.names = sorted({w for t in templates for w in t.words})
        hashes = _hashes(self.names, self.powers)
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's word, -1 for others."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.number[at], -1)

    def read(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, word numbers, their starts and ends in the slice, first word of each text, its first byte)."""
        for a, b, data, at in slices(texts):
            starts, ends, first = word_bounds(data, at, ALNUM)
            numbers = self.of(span_hashes(data, starts, ends, self.powers, True)) if len(starts) else np.zeros(0, np.int64)
            yield a, b, numbers, starts, ends, first, at


class Index:
    """Postings of anchors and the templates to verify; ``counts`` are documents by word."""

    def __init__(self, templates: list[Template], counts: dict[str, int]) -> None:
        self.templates, self.words = templates, Words(templates)
        rank = {w: k for k, w in enumerate(sorted(self.words.names, key=lambda w: (counts.get(w, 0), w)))}  # highest IDF first
        number = {w: k for k, w in enumerate(self.words.names)}
        self.text = np.array([number[w] for t in templates for w in t.words], np.int64)
        self.must = np.array([m for t in templates for m in t.must], bool)
        self.size = np.array([len(t.words) for t in templates], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.need = np.array([t.need for t in templates], np.int64)
        postings = []
        for k, t in enumerate(templates):
            anchors = sorted(range(len(t.words)), key=lambda i: (rank[t.words[i]], i))[: len(t.words) - t.need + SHARED]
            postings += [(number[t.words[i]], k, i) for i in anchors]
        postings.sort()
        word, self.template, self.place = (np.array(x, np.int64) for x in zip(*postings, strict=True))
        self.start = np.searchsorted(word, np.arange(len(number) + 1))

    def find(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, first word, matching words) of all matches in texts whose words begin at ``first``, by place."""
        n = np.where(numbers >= 0, self.start[numbers + 1] - self.start[numbers], 0)
        at = np.flatnonzero(n)
        n = n[at]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[numbers[at]], n)
        template, begin = self.template[each], np.repeat(at, n) - self.place[each]
        text = np.repeat(np.searchsorted(first, at, "right") - 1, n)
        inside = (begin >= first[text]) & (begin + self.size[template] <= first[text + 1])
        key, shared = np.unique(begin[inside] * len(self.templates) + template[inside], return_counts=True)
        begin, template = np.divmod(key[shared >= SHARED], len(self.templates))
        if not len(begin):
            return template, begin, begin
        size = self.size[template]
        starts = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(starts, size)
        own = np.repeat(self.first[template], size) + step
        same = numbers[np.repeat(begin, size) + step] == self.text[own]
        matched = np.add.reduceat(same.astype(np.int64), starts)
        missed = np.add.reduceat((self.must[own] & ~same).astype(np.int64), starts)
        good = (matched >= self.need[template]) & (missed == 0)
        return template[good], begin[good], matched[good]


def word_counts(docs: DataFrame, text_col: str = "text", templates: list[Template] = TEMPLATES) -> dict[str, int]:
    """Documents that hold each template word; a dictionary of at most the templates' words."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(templates)
        total = np.zeros(len(words.names), np.int64)
        for batch in batches:
            for _, _, numbers, _, _, first, _ in words.read(batch.column(0)):
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                known = numbers >= 0
                once = np.unique(text[known] * len(total) + numbers[known])
                total += np.bincount(once % len(total), minlength=len(total))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([words.names[k] for k in has], pa.string()), pa.array(total[has])], ["word", "docs"])

    counts = docs.select(text_col).mapInArrow(count, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    return {r.word: r.docs for r in counts.collect()}


def scan_licenses(docs: DataFrame, text_col: str = "text", name: str = "licenses", templates: list[Template] = TEMPLATES) -> DataFrame:
    """``docs`` with a struct of the number of words and all matches: template, label, words (first, number, matching), bytes."""
    ship_package(docs.sparkSession)
    counts = word_counts(docs, text_col, templates)

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(templates, counts)
        labels, base = np.array([t.label for t in templates]), np.array([t.base for t in templates])
        for batch in batches:
            n_words, rows, columns = np.zeros(len(batch), np.int64), [], []
            for a, b, numbers, starts, ends, first, at in index.words.read(batch):
                n_words[a:b] = np.diff(first)
                template, begin, matched = index.find(numbers, first)
                text = np.searchsorted(first, begin, "right") - 1
                rows.append(a + text)
                columns.append([template, begin - first[text], index.size[template], matched, starts[begin] - at[text], ends[begin + index.size[template] - 1] - at[text]])
            row = np.concatenate([np.zeros(0, np.int64), *rows])
            template, begin, size, matched, left, right = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (zip(*columns, strict=True) if columns else [()] * 6))
            fields = [pa.array(template, pa.int32()), pa.array(labels[template].tolist(), pa.string()), pa.array(base[template], pa.bool_()), *(pa.array(x, pa.int64()) for x in (begin, size, matched, left, right))]
            match = pa.StructArray.from_arrays(fields, ["template", "label", "base", "first_word", "n_words", "matched", "begin", "end"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))]), pa.int32())
            yield pa.StructArray.from_arrays([pa.array(n_words), pa.ListArray.from_arrays(offsets, match)], ["n_words", "matches"])

    return docs.withColumn(name, scan(F.col(text_col)))


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score (share of the best match's words that agree)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("licenses.matches")
    base = F.filter(found, lambda m: m["base"])
    places = F.transform(base, lambda m: m["first_word"])
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return scan_licenses(docs).select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        names(base).alias("base_labels"),
        names(found).alias("labels"),
        F.coalesce(F.array_max(F.transform(found, lambda m: m["matched"] / m["n_words"])), F.lit(0.0)).alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in rows)


#: All places of all templates by a join of words; neither anchors nor counts.
OP13_SQL = rf"""
WITH t(template, label, base, need, size, keys) AS (VALUES {_values([(k, t.label, t.base, t.need, len(t.words), sum(t.must)) for k, t in enumerate(TEMPLATES)])}),
tw(template, place, word, must) AS (VALUES {_values([(k, i, w, m) for k, t in enumerate(TEMPLATES) for i, (w, m) in enumerate(zip(t.words, t.must, strict=True))])}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS word FROM d),
a AS (SELECT r, template, k - place AS begin, count(*) AS matched, count(*) FILTER (WHERE must) AS held FROM x JOIN tw USING (word) GROUP BY ALL),
m AS (SELECT r, begin, label, base, matched / size AS share FROM a JOIN t USING (template) JOIN d USING (r) WHERE matched >= need AND held = keys AND begin >= 0 AND begin + size <= len(w)),
g AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(begin) FILTER (WHERE base) AS first_word, max(begin) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""
