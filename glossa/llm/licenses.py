"""Licence scan with a positional rare-token index.

The templates (licence notices and short phrases) are indexed by word: each word has its
postings (template, position).  For a file and a template the file's words of the template
with the highest IDF are looked up, and their postings are intersected by relative
position: each occurrence at word p of a posting at position q votes for a start at p - q.
Starts with enough votes are verified: the mandatory phrase must stand there word by word.
The IDF comes from document frequencies over all rows.

A template can only be verified where the rarest word of its mandatory phrase stands, so
files without it are skipped, and every place of a phrase is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import quoted, sliced

#: Rarest words that vote for a start beside those of the mandatory phrase, and votes needed (fewer for a shorter phrase).
VOTERS = 6
VOTES = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: str  # mandatory, part of the text
    base: bool = False

    def words(self) -> list[str]:
        return self.text.split()

    def at(self) -> int:
        words, phrase = self.words(), self.phrase.split()
        return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _phrase(label: str, text: str) -> Template:
    return Template(label, text, text, True)


TEMPLATES = (
    _phrase("mit", "under the mit license"),
    _phrase("apache-2", "apache license version 2"),
    _phrase("cc-by-nc", "cc by nc"),
    Template("apache-2", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template(
        "gpl",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gnu general public license as published",
    ),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
)

# Bytes of words: digits, letters (upper case counts as lower) and all beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_KEY_BYTES = 16


class Words:
    """The words of a batch of texts, in numpy: start byte, length, and row borders."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        low, high = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.array([], np.uint8)
        self.raw = _LOWER[raw]
        inside, borders = _IN_WORD[raw], offsets - low
        # A word ends with its text, also where the next text starts with a word.
        first = np.zeros(len(raw) + 1, bool)
        first[borders] = True
        before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
        self.starts = starts
        self.lengths = np.flatnonzero(inside & (~after | first[1:])) - starts + 1
        self.rows = np.searchsorted(starts, borders)  # first word of each text, and the end

    def numbered(self, vocabulary: dict[str, int]) -> np.ndarray:
        """Number of each word in the vocabulary, -1 for others."""
        out = np.full(len(self.starts), -1, np.int16)
        longest = max(len(w.encode()) for w in vocabulary)
        by_length: dict[int, list[str]] = {}
        for word in vocabulary:
            by_length.setdefault(len(word.encode()), []).append(word)
        for length in sorted(by_length):
            if length > longest:
                break
            at = np.flatnonzero(self.lengths == length)
            start = self.starts[at]
            keys = [0] if length <= 8 else [0, length - 8]
            packed = [self._packed(start + k, min(length, 8)) for k in keys]
            middle = length > _KEY_BYTES
            for word in by_length[length]:
                raw = word.encode()
                same = np.ones(len(at), bool)
                for k, codes in zip(keys, packed, strict=True):
                    same &= codes == int.from_bytes(raw[k : k + 8], "big")
                found = at[same]
                if middle:
                    found = np.array([i for i in found if self.raw[self.starts[i] :][:length].tobytes() == raw], np.int64)
                out[found] = vocabulary[word]
        return out

    def _packed(self, start: np.ndarray, n: int) -> np.ndarray:
        code = np.zeros(len(start), np.uint64)
        for i in range(n):
            code = code << np.uint64(8) | self.raw[start + i].astype(np.uint64)
        return code


class Index:
    """Templates as word numbers, and the IDF of each word."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float] | None = None):
        self.templates = templates
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in templates for w in t.words()}))}
        self.idf = np.array([(idf or {}).get(w, 0.0) for w in self.vocabulary])
        self.lines = [np.array([self.vocabulary[w] for w in t.words()], np.int16) for t in templates]
        self.spans = [(t.at(), len(t.phrase.split())) for t in templates]
        self.anchors = [max(line[a : a + n].tolist(), key=lambda w: self.idf[w]) for line, (a, n) in zip(self.lines, self.spans, strict=True)]

    def matches(self, t: int, words: np.ndarray) -> Iterator[tuple[int, float]]:
        """(start of the mandatory phrase, share of the template's words in their places) in one file."""
        line, (a, n) = self.lines[t], self.spans[t]
        present = [w for w in dict.fromkeys(line.tolist()) if (words == w).any()]
        # The phrase's words vote in any case: where it stands there are votes enough, whatever else the file holds.
        voters = {*line[a : a + n].tolist(), *sorted(present, key=lambda w: -self.idf[w])[:VOTERS]}
        starts = np.concatenate([np.flatnonzero(words == line[q]) - q for q in range(len(line)) if line[q] in voters])
        starts, votes = np.unique(starts, return_counts=True)
        lows = starts[votes >= min(VOTES, n)] + a
        lows = lows[(lows >= 0) & (lows + n <= len(words))]
        for k in range(n):
            lows = lows[words[lows + k] == line[a + k]]
        for low in lows.tolist():
            inside = np.arange(len(line)) + low - a
            there = inside[(inside >= 0) & (inside < len(words))]
            yield low, float((words[there] == line[there - low + a]).sum()) / len(line)


def document_frequencies(docs: DataFrame, text_col: str, index: Index) -> tuple[dict[str, int], int]:
    """Rows that hold each template word, and all rows; what reaches the driver is bounded by the templates' words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in (part for b in batches for part in sliced(b)):
            words = Words(batch.column("text"))
            number = words.numbered(index.vocabulary)
            at = np.flatnonzero(number >= 0)
            row = np.searchsorted(words.rows, at, side="right")
            seen = np.unique(row * len(held) + number[at])
            held += np.bincount(seen % len(held), minlength=len(held))
            rows += len(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(len(held)), -1], pa.int32()), pa.array([*held.tolist(), rows], pa.int64())], ["word", "n"]
        )

    counts = docs.select(quoted(text_col).alias("text")).mapInArrow(count, "word int, n long")
    sums = {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: sums.get(i, 0) for w, i in index.vocabulary.items()}, sums.get(-1, 0)


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``n_base`` counts all places of base phrases, overlapping and repeated ones too;
    ``first_word`` and ``last_word`` are their smallest and largest start.  ``labels`` adds
    those of the other templates.  ``score`` is the largest share of a template's words
    found in their places, 0 without a label.  Null and empty texts have no words and no
    labels.  Repeated rows and null ids are rows like others; other columns are ignored.
    """
    frequency, rows = document_frequencies(docs, text_col, Index(templates))
    idf = {w: math.log((rows + 1) / (n + 1)) for w, n in frequency.items()}
    index = Index(templates, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in sliced(b)):
            words = Words(batch.column("text"))
            number = words.numbered(index.vocabulary)
            n = len(batch)
            places: dict[int, list[int]] = {}
            base: dict[int, set[str]] = {}
            every: dict[int, set[str]] = {}
            score = np.zeros(n)
            for t, template in enumerate(index.templates):
                at = np.flatnonzero(number == index.anchors[t])
                for row in np.unique(np.searchsorted(words.rows, at, side="right") - 1).tolist():
                    file = number[words.rows[row] : words.rows[row + 1]]
                    for low, share in index.matches(t, file):
                        every.setdefault(row, set()).add(template.label)
                        score[row] = max(score[row], share)
                        if template.base:
                            base.setdefault(row, set()).add(template.label)
                            places.setdefault(row, []).append(low)
            joined = lambda found: [",".join(sorted(found.get(i, ()))) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(words.rows).astype(np.int64)),
                    pa.array([len(places.get(i, ())) for i in range(n)], pa.int64()),
                    pa.array([min(places[i]) if i in places else None for i in range(n)], pa.int64()),
                    pa.array([max(places[i]) if i in places else None for i in range(n)], pa.int64()),
                    pa.array(joined(base), pa.string()),
                    pa.array(joined(every), pa.string()),
                    pa.array(score),
                ],
                ["doc_id", *[c.split()[0] for c in RESULT.split(", ")]],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, {RESULT}")
