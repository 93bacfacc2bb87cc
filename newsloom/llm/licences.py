"""Licence scan over a positional index of rare licence words.

Templates are one-sentence notices and the paragraphs of public licences
(``licence_texts``).  A first pass counts in how many documents each
template word occurs; the index lists, for the ``ANCHORS`` words of each template
with the highest inverse document frequency, the templates and positions where they
stand.  A document is looked up by the licence words it holds; each posting proposes
a start of the template in the document, proposals that agree on it are one, and the
template's remaining words are intersected at their relative positions.  A match
needs the template's mandatory key phrases in place, word for word, and at least
``LEAST`` of its words by weight.

Base phrases are templates that must match whole.  Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A null or empty text
has no words and no labels; an empty table gives an empty result; repeated rows are
scanned each alone; where templates tie, all their labels are given.  Input columns
that bear the name of an output are replaced.  Two narrow passes; what reaches the
driver is one number for each template word.  Very long texts are scanned whole, one at a time.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns, pieces, raw_texts, words_of
from .licence_texts import PARAGRAPHS

ANCHORS = 2
LEAST = 0.6


class Template(NamedTuple):
    label: str
    text: str
    #: Parts of the text that must stand in place.
    keys: tuple[str, ...]
    base: bool = False


BASE = [
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
]
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("permission is hereby granted free of charge",),
    ),
    Template(
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use", "source and binary forms"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee"),
    ),
] + [Template(label, text, keys) for label, text, keys in PARAGRAPHS]

MATCH = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("base", T.BooleanType()),
    ]
)


class Index:
    def __init__(self, templates: list[Template], frequency: dict[bytes, int], documents: int):
        self.templates = templates
        self.words = [words_of(t.text.encode()) for t in templates]
        weight = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1 for ws in self.words for w in ws}
        self.weight = weight
        self.mass = [sum(map(weight.__getitem__, ws)) for ws in self.words]
        self.keys = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (template, words) in enumerate(zip(templates, self.words)):
            spans = []
            for key in template.keys:
                k = words_of(key.encode())
                at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
                spans.append((at, k))
            self.keys.append(spans)
            # anchors come from the key phrases: a match cannot do without them
            inside = sorted(
                {i for at, k in spans for i in range(at, at + len(k))}, key=lambda i: (-weight[words[i]], i)
            )
            for i in inside[:ANCHORS]:
                self.postings[words[i]].append((number, i))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score) of every match, by start."""
        if self.postings.keys().isdisjoint(words):
            return []
        proposed = {
            (number, i - at)
            for i, word in enumerate(words)
            if word in self.postings
            for number, at in self.postings[word]
        }
        found = []
        for number, start in proposed:
            if any(words[max(0, start + at) : start + at + len(k)] != k or start + at < 0 for at, k in self.keys[number]):
                continue
            own = self.words[number]
            held = sum(
                self.weight[w]
                for i, w in enumerate(own)
                if 0 <= start + i < len(words) and words[start + i] == w
            )
            score = held / self.mass[number]
            if score >= LEAST and not (self.templates[number].base and score < 1 - 1e-9):
                found.append((number, start, min(1.0, score)))
        return sorted(found, key=lambda x: (x[1], x[0]))


def word_frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the vocabulary occurs, and the number of documents."""

    def run(source):
        counts, rows = Counter(), 0
        for whole in source:
            for batch in pieces(whole, "text"):
                for t in raw_texts(batch.column("text")):
                    counts.update(vocabulary.intersection(words_of(t)))
                    rows += 1
        words = [w.decode() for w in counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*words, None], pa.string()), pa.array([*counts.values(), rows], pa.int64())], names=["word", "n"]
        )

    counted = docs.select(docs[text].alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n"))
    found = {w: n for w, n in counted.collect()}
    rows = found.pop(None, 0)
    return {w.encode(): n for w, n in found.items()}, rows


def scan(docs: DataFrame, text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """Adds ``n_words`` and ``matches``: label, first word, number of words, score and whether it is a base phrase."""
    templates = BASE + NOTICES if templates is None else templates
    vocabulary = {w for t in templates for w in words_of(t.text.encode())}
    frequency, rows = word_frequencies(docs, vocabulary, text)

    def make():
        index = Index(templates, frequency, rows)
        kind = pa.struct(
            [("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]
        )

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            sizes, found = [], []
            for t in raw_texts(batch.column(text if text in batch.schema.names else "__input")):
                words = words_of(t)
                sizes.append(len(words))
                found.append(
                    [
                        {
                            "label": templates[n].label,
                            "start": max(0, start),
                            "n_words": len(index.words[n]),
                            "score": score,
                            "base": templates[n].base,
                        }
                        for n, start, score in index.scan(words)
                    ]
                )
            return [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(kind))]

        return compute

    fields = [T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))]
    return add_columns(docs, fields, text, make)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base phrases with their places, and all labels."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def base_report(docs: DataFrame) -> DataFrame:
    """The columns of :func:`report` that the base phrases alone give."""
    return report(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])) AS t(label, k)),
m AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, label, k, unnest(range(1, len(w) - len(k) + 2)) AS i FROM d, p) WHERE w[i : i + len(k) - 1] = k),
f AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels
FROM d LEFT JOIN f USING (doc_id)
"""
