"""Languages of a document and their shares (operator 7).

Each language has a table of letter trigrams, counted over at most ``EXAMPLES`` labelled documents
per language, in the order of a hash of their id. A word's likelihood in a language is the product over
its trigrams, word ends included. A document is a mixture: expectation-maximisation over its words
estimates the share of every language. Then the set of languages is chosen: for the one, two, three ... largest shares, until
that makes every text of a batch worse, the mixture is fitted again, and the set with the best likelihood minus a penalty per language
(half the logarithm of the number of words, times ``PENALTY``) wins. The language of the document is the largest share of that set.

Cases: null texts, empty ones and texts without a letter are ``und`` with score 0 and no
languages. Repeated rows get repeated results. Labelled rows without text or language teach
nothing; without any, every text is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, sliced, text_rows

EXAMPLES = 1_500
CELLS = 1 << 16
SMOOTHING = 0.5
FLOOR = -10.0  # a word is at most this much less likely, so that single odd words decide nothing
ROUNDS = 12
PENALTY = 4.0
SLICES = 64  # of a language's labelled rows, from each of which candidates for its examples are taken
UNKNOWN = "und"

MIXED = pa.schema(
    [("id", pa.int64()), ("language", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())),
     ("shares", pa.list_(pa.float64()))]
)
MIXED_DDL = "id long, language string, score double, languages array<string>, shares array<double>"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters or marks."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all trigrams, the index of each word's first one, and each word's text."""
    points = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    text_of = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    points = np.concatenate(points) if points else np.empty(0, dtype=np.uint32)
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(0))
    at = np.flatnonzero(letter)
    hashed = points[at - 1] * np.uint32(0x9E3779B1) + points[at] * np.uint32(0x85EBCA77) + points[at + 1] * np.uint32(0xC2B2AE3D)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    cells = (hashed >> np.uint32(16)).astype(np.int64)
    first = np.flatnonzero(~letter[at - 1])
    return cells, first, text_of[at[first]]


class LanguageModel:
    def __init__(self, examples: list[tuple[str, str]]):
        self.languages = sorted({language for language, _ in examples})
        self.table = np.zeros((CELLS, len(self.languages)), dtype=np.float32)
        for column, language in enumerate(self.languages):
            counts = np.full(CELLS, SMOOTHING)
            own = [text for known, text in examples if known == language]
            for start in range(0, len(own), 200):
                counts += np.bincount(trigrams(own[start : start + 200])[0], minlength=CELLS)
            self.table[:, column] = np.log(counts / counts.sum())

    def word_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word the likelihood in every language, relative to its best one, and the word's text."""
        cells, first, text_of = trigrams(texts)
        if not len(first):
            return np.empty((0, len(self.languages))), text_of
        logs = np.add.reduceat(self.table[cells], first, axis=0)
        return np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), FLOOR)), text_of

    def mixtures(self, texts: list[str]) -> list[tuple[str, float, list[str], list[float]]]:
        answers = [(UNKNOWN, 0.0, [], [])] * len(texts)
        if not self.languages:
            return answers
        likelihoods, text_of = self.word_likelihoods(texts)
        if not len(likelihoods):
            return answers
        some, first, n_words = np.unique(text_of, return_index=True, return_counts=True)
        word_text = np.repeat(np.arange(len(some)), n_words)

        def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares and log-likelihood of every text as a mixture of its allowed languages."""
            shares = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                parts = shares[word_text] * likelihoods
                total = parts.sum(axis=1, keepdims=True)
                before, shares = shares, np.add.reduceat(parts / total, first, axis=0) / n_words[:, None]
                if np.abs(shares - before).max() < 1e-4:
                    break
            total = (shares[word_text] * likelihoods).sum(axis=1)
            return shares, np.add.reduceat(np.log(np.maximum(total, 1e-300)), first)

        full, _ = fit(np.ones((len(some), len(self.languages))))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
        best_value, best_shares, value = np.full(len(some), -np.inf), full, np.full(len(some), -np.inf)
        for size in range(1, len(self.languages) + 1):
            before = value
            shares, fitted = fit((rank < size).astype(float))
            value = fitted - 0.5 * PENALTY * size * np.log(n_words + 1)
            better = value > best_value
            best_value = np.where(better, value, best_value)
            best_shares = np.where(better[:, None], shares, best_shares)
            # Once one more language makes every text worse, further ones cost more than they give.
            if not (value > before).any():
                break
        for text, row in zip(some.tolist(), best_shares):
            order = [i for i in np.argsort(-row, kind="stable").tolist() if row[i] > 0]
            names = [self.languages[i] for i in order]
            answers[text] = (names[0], float(min(1.0, row[order[0]])), names, [float(row[i]) for i in order])
        return answers


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None,
    examples: int = EXAMPLES,
) -> LanguageModel:
    """``usable`` is a condition on the column ``id`` that rows to learn from must meet.

    The ids are chosen first, so that texts are joined with a side of bounded size.
    """
    known = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").isNotNull().alias("has_text")
    ).where("id IS NOT NULL AND lang IS NOT NULL AND has_text")
    if usable is not None:
        known = known.where(usable)
    # First from every slice of a language, then from the language: its rows are never sorted in one task.
    chosen = known.select("id", "lang", F.pmod(F.xxhash64("id", F.lit("slice")), F.lit(SLICES)).alias("slice"))
    for part in (["lang", "slice"], ["lang"]):
        order = Window.partitionBy(*part).orderBy(F.xxhash64("id"), "id")
        chosen = chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= examples).drop("place")
    rows = text_rows(docs, id_col, text_col)
    found = rows.join(F.broadcast(chosen.select("id", "lang").distinct()), "id").select("lang", "text").collect()
    return LanguageModel(sorted((row.lang, row.text) for row in found))


def infer(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, language, score, languages, shares)`` of every row; the score is the language's share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            rows = shared.value.mixtures(batch.column("text").to_pylist())
            yield batch_of(MIXED, batch.column("id"), *(zip(*rows) if rows else ([],) * 4))

    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, MIXED_DDL)
