"""Licence notices in documents, by a trained paragraph classifier (operator 8).

Places and counts are of lines that are not blank; notices are sought in whole paragraphs, which blank lines part, across
their line breaks, comment marks and hyphens at line ends. A multinomial logistic regression over hashed word n-grams (one to three words) tells
the licence families and the class ``unknown`` apart. It is trained on variants of the notices in ``NOTICES``
(cut, embedded in other words, with words changed) and, for ``unknown``, on at most ``BACKGROUND`` paragraphs
of the corpus, in the order of a hash of their document's id. Half of the rows train, the other half calibrates: one
temperature makes the probabilities honest, and the ``unknown`` class gets the offset that makes its mean probability equal its share. A family is reported for
a passage if it is likelier than ``unknown`` and a notice of the family confirms it: at least
``CONFIRMED`` of the notice's word triples stand in the passage, which begins and ends with such triples. Of
passages that overlap, the likeliest family counts; its place is the line in which it begins.

Lines outside these passages are scored by themselves, long ones in overlapping windows of ``WINDOW`` words; likely
but unconfirmed lines are counted apart. They are scored if their paragraph has a word stem or a word triple of a notice.

Cases: null and empty texts have no paragraphs; blank lines are none. Repeated rows get repeated results.
Without documents the background is empty and only the notices teach. Ties go to the family that sorts first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, sliced, text_rows

# Notices by which licence families are recognised.
NOTICES = {
    "AGPL": ["GNU Affero General Public License as published by the Free Software Foundation",
             "licensed under the GNU Affero General Public License, version 3"],
    "Apache": ["Licensed under the Apache License, Version 2.0",
               "you may not use this file except in compliance with the License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Licensed under the BSD 3-Clause License", "Released under the BSD License"],
    "CC-BY": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "CC-BY-SA": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "CC0": ["dedicated to the public domain under the CC0 1.0 Universal license", "Released under CC0 1.0 license"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3",
            "under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "Released under the ISC License"],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL": ["subject to the terms of the Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense license"],
}
_STEM = re.compile(r"licen[sc]e|permission|redistribution|public domain", re.IGNORECASE)
_LETTER = re.compile(r"\w")
_HYPHEN = re.compile(r"\w-\s*$")
_WORDS = re.compile(r"\w+(?:[.-]\w+)*").findall

UNKNOWN = "unknown"
BACKGROUND = 3_000
BACKGROUND_DOCS = 600
VARIANTS = 60
CELLS = 1 << 15
CONFIRMED = 0.6
WINDOW = 64
SEED = 8

SCANNED = pa.schema(
    [("id", pa.int64()), ("n_paragraphs", pa.int64()), ("families", pa.list_(pa.string())), ("confidences", pa.list_(pa.float64())),
     ("paragraphs", pa.list_(pa.int64())), ("n_unconfirmed", pa.int64())]
)
SCANNED_DDL = "id long, n_paragraphs long, families array<string>, confidences array<double>, paragraphs array<long>, n_unconfirmed long"


def words_of(paragraph: str) -> list[str]:
    return _WORDS(paragraph.lower())


def _words_of_lines(lines: list[str]) -> list[list[str]]:
    """The words of every line; one cut by a hyphen at the end of its line belongs to that line as a whole."""
    out = [words_of(line) for line in lines]
    for n in range(len(lines) - 1):
        if _HYPHEN.search(lines[n]) and out[n] and out[n + 1]:
            out[n][-1] += "-" + out[n + 1].pop(0)
    return out


def triples(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def cells(words: list[str]) -> np.ndarray:
    """Hashed n-grams of a paragraph, each once."""
    grams = (" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return np.unique(np.fromiter((zlib.crc32(g.encode()) % CELLS for g in grams), dtype=np.int64))


class _Rows:
    """Sparse rows of unit length."""

    def __init__(self, paragraphs: list[list[str]]):
        rows = [cells(w) for w in paragraphs]
        sizes = np.array([max(1, len(r)) for r in rows])
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.cell = np.concatenate([np.empty(0, dtype=np.int64), *rows])
        self.value = 1 / np.sqrt(sizes[self.row])

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]))
        np.add.at(out, self.row, weights[self.cell] * self.value[:, None])
        return out

    def gradient(self, slopes: np.ndarray) -> np.ndarray:
        out = np.zeros((CELLS, slopes.shape[1]))
        np.add.at(out, self.cell, slopes[self.row] * self.value[:, None])
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class LicenceModel:
    def __init__(self, background: list[str], rounds: int = 60, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.classes = [*sorted(NOTICES), UNKNOWN]
        self.notices = [(family, words_of(n)) for family in sorted(NOTICES) for n in NOTICES[family]]
        self.holders: dict[tuple[str, ...], list[int]] = {}
        for n, (_, words) in enumerate(self.notices):
            for triple in triples(words):
                self.holders.setdefault(triple, []).append(n)
        self.triples = {family: [triples(words_of(n)) for n in notices] for family, notices in NOTICES.items()}
        plain = [w for w in map(words_of, sorted(background)) if w and not any(self.confirms(f, w) for f in NOTICES)]
        filler = sorted({w for words in plain for w in words})[:50_000] or ["text"]
        paragraphs, labels = [], []
        for label, family in enumerate(self.classes[:-1]):
            for n in range(VARIANTS):
                notice = words_of(NOTICES[family][n % len(NOTICES[family])])
                # A few words around it, and now and then one changed: notices are copied with small changes.
                around = [filler[i] for i in random.integers(len(filler), size=random.integers(0, 12))]
                cut = int(random.integers(0, len(around) + 1))
                notice = [w if random.random() > 0.04 else filler[random.integers(len(filler))] for w in notice]
                paragraphs.append(around[:cut] + notice + around[cut:])
                labels.append(label)
        paragraphs += plain
        labels += [len(self.classes) - 1] * len(plain)
        # Words of notices in any order are no notice.
        loose = sorted({w for notices in NOTICES.values() for n in notices for w in words_of(n)})
        for _ in range(4 * VARIANTS):
            paragraphs.append([loose[i] for i in random.integers(len(loose), size=random.integers(3, 15))])
            labels.append(len(self.classes) - 1)
        labels = np.array(labels)
        train = random.random(len(labels)) < 0.5
        rows, wanted = _Rows([p for p, t in zip(paragraphs, train) if t]), np.eye(len(self.classes))[labels[train]]
        self.weights, self.bias = np.zeros((CELLS, len(self.classes))), np.zeros(len(self.classes))
        speed = np.zeros_like(self.weights)
        for _ in range(rounds):
            slopes = (_softmax(rows.times(self.weights) + self.bias) - wanted) / max(1, rows.n)
            speed = 0.9 * speed - 20.0 * (rows.gradient(slopes) + 1e-5 * self.weights)
            self.weights += speed
            self.bias -= slopes.sum(axis=0)
        held = _Rows([p for p, t in zip(paragraphs, train) if not t])
        logits, truth = held.times(self.weights) + self.bias, labels[~train]
        losses = [(-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean(), t) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)]
        self.temperature = min(losses)[1]
        share = float((truth == len(self.classes) - 1).mean())
        offsets = np.linspace(-4, 4, 33)
        means = [_softmax(logits / self.temperature + np.eye(len(self.classes))[-1] * o)[:, -1].mean() for o in offsets]
        self.offset = float(offsets[int(np.argmin(np.abs(np.array(means) - share)))])
        self.weights = self.weights.astype(np.float32)

    def confirms(self, family: str, words: list[str]) -> bool:
        own = triples(words)
        return any(len(t & own) >= CONFIRMED * len(t) for t in self.triples[family])

    def chances(self, words: list[str]) -> np.ndarray:
        """The calibrated probability of every class."""
        found = cells(words)
        logits = self.weights[found].sum(axis=0, dtype=float) / np.sqrt(max(1, len(found))) + self.bias
        logits = logits / self.temperature
        logits[-1] += self.offset
        return _softmax(logits[None])[0]

    def predict(self, words: list[str]) -> tuple[str, float]:
        """The likeliest class of a paragraph and its calibrated probability."""
        chances = self.chances(words)
        best = int(np.argmax(chances))
        return self.classes[best], float(chances[best])

    def passages(self, words: list[str], hits: list[int]) -> list[tuple[int, int, str]]:
        """``(start, end, family)`` of the stretches that confirm a notice; hits are the places of triples of notices."""
        of_notice: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        for at in hits:
            triple = tuple(words[at : at + 3])
            for n in self.holders[triple]:
                of_notice.setdefault(n, []).append((at, triple))
        found = []
        for n, places in of_notice.items():
            family, notice = self.notices[n]
            needed, reach, i = CONFIRMED * len(triples(notice)), 2 * len(notice) + 12, 0
            while i < len(places):
                taken, j = set(), i
                while j < len(places) and places[j][0] < places[i][0] + reach and places[j][1] not in taken:
                    taken.add(places[j][1])
                    j += 1
                if len(taken) < needed:
                    i += 1
                    continue
                # Stray triples far before or after the notice do not belong to it.
                first, last = i, j - 1
                while last - first >= needed and places[first + 1][0] - places[first][0] > 4:
                    first += 1
                while last - first >= needed and places[last][0] - places[last - 1][0] > 4:
                    last -= 1
                found.append((places[first][0], places[last][0] + 3, family))
                i = last + 1
        return sorted(found)

    def _paragraph(self, lines: list[str], first: int) -> tuple[list[tuple[int, str, float]], int]:
        """``(line, family, probability)`` of the confirmed passages and lines, and the number of unconfirmed lines."""
        parts = _words_of_lines(lines)
        words = [w for part in parts for w in part]
        hits = [at for at, t in enumerate(zip(words, words[1:], words[2:])) if t in self.holders]
        if not hits and not any(map(_STEM.search, lines)):
            return [], 0
        line_of = [n for n, part in enumerate(parts) for _ in part]
        out, unconfirmed, covered = [], 0, set()
        places = self.passages(words, hits)
        while places:
            # Passages that overlap are one; the likeliest of their families counts.
            start, end, families, n = *places[0][:2], set(), 0
            while n < len(places) and places[n][0] < end:
                end = max(end, places[n][1])
                families.add(places[n][2])
                n += 1
            places = places[n:]
            chances = self.chances(words[start:end])
            best = max(sorted(families), key=lambda f: chances[self.classes.index(f)])
            chance = float(chances[self.classes.index(best)])
            if chance > chances[-1]:
                out.append((first + line_of[start], best, chance))
                covered.update(line_of[start:end])
        for n, part in enumerate(parts):
            if n in covered or not part:
                continue
            likely = [self.predict(part[at : at + WINDOW]) for at in range(0, max(1, len(part) - WINDOW // 2), WINDOW // 2)]
            likely = [(chance, family) for family, chance in likely if family != UNKNOWN]
            confirmed = [(chance, family) for chance, family in likely if self.confirms(family, part)]
            if confirmed:
                chance, family = max(confirmed)
                out.append((first + n, family, chance))
            elif likely:
                unconfirmed += 1
        return sorted(out, key=lambda x: x[0]), unconfirmed

    def scan(self, text: str) -> tuple[int, list[str], list[float], list[int], int]:
        """Lines that are not blank, confirmed families with probability and line, unconfirmed lines."""
        count, unconfirmed, out = 0, 0, []
        block: list[str] = []
        for line in [*text.split("\n"), ""]:
            if _LETTER.search(line):
                block.append(line)
                continue
            if block:
                found, more = self._paragraph(block, count)
                out += found
                unconfirmed += more
                count += len(block)
                block = []
            # A line of signs only parts paragraphs, too, and counts as a line.
            count += bool(line.strip())
        return count, [f for _, f, _ in out], [c for _, _, c in out], [n for n, _, _ in out], unconfirmed


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", background: int = BACKGROUND, background_docs: int = BACKGROUND_DOCS) -> LicenceModel:
    rows = text_rows(docs, id_col, text_col)
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(background_docs)
    lines = rows.join(F.broadcast(chosen), "id").select("id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    found = lines.where(F.length(F.trim("line")) > 0).orderBy(F.xxhash64("id", "place"), "id", "place", "line").limit(background).select("line").collect()
    return LicenceModel([row.line for row in found])


def scan_documents(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_paragraphs, families, confidences, paragraphs, n_unconfirmed)`` of every row; the three lists
    have one entry per confirmed paragraph."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shared.value.scan(text) for text in batch.column("text").to_pylist()]
            yield batch_of(SCANNED, batch.column("id"), *(zip(*found) if found else ([],) * 5))

    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, SCANNED_DDL)
