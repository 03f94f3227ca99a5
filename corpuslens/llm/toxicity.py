"""Toxicity by the nearest labelled examples (operator 1).

The model is a bounded set of labelled examples: at most ``EXAMPLES`` rows per class, in the order
of a hash of their id, drawn from all labelled rows. Features are words and word beginnings;
the ``FEATURES`` that tell the classes apart best (G-test) make the vocabulary. An example or a document is its
TF-IDF vector over the vocabulary. The examples are kept as an inverted index whose blocks hold ``BLOCK`` examples;
per term and block the largest weight is known. A document's similarity to a block is at most the
sum of its weights times these maxima: blocks are taken in falling order of that bound and the
search ends when no bound beats the k-th best similarity, so the k nearest by cosine are exact. They vote with the
fourth power of their similarities; a monotone map learned on examples left out of index and vocabulary makes the vote a probability.

Cases: null and empty texts and texts without a term of the vocabulary have no neighbours and
score the rate learned for such texts. Repeated rows get repeated results. Labels other than 0
and 1, null ids and labelled rows without a document teach nothing. Ties between neighbours go to the
lower place in the index. Without examples of both classes every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, sliced, text_key, text_rows, without_rows

EXAMPLES = 2_500
FEATURES = 4_000
NEIGHBOURS = 15
BLOCK = 128
BEGINNINGS = (3, 4, 5, 6, 7)
CHANCE = 0.02  # how many useless features may be chosen by chance among all that were looked at
MAX_WORD = 64
_WORDS = re.compile(r"[^\W\d_]+").findall

SCORED = pa.schema(
    [("id", pa.int64()), ("text_key", pa.int64()), ("score", pa.float64()), ("vote", pa.float64()), ("evidence", pa.list_(pa.int64())),
     ("similarities", pa.list_(pa.float64()))]
)
SCORED_DDL = "id long, text_key long, score double, vote double, evidence array<long>, similarities array<double>"


def word_features(word: str) -> list[str]:
    """A word and its beginnings; the part of a very long word beyond ``MAX_WORD`` letters still belongs to the word feature."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def text_features(text: str) -> set[str]:
    return {feature for word in set(_WORDS(text.lower())) for feature in word_features(word)}


def lowest_shingle(text: str) -> int:
    """The smallest hash of three words in a row: near copies nearly always share it, other texts hardly ever."""
    words = text.lower().split()
    return min(zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2)))


def _g_test(with_1, with_0, n_1, n_0):
    """How far the share of texts with a feature differs between the classes."""

    def term(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0.0)

    total = n_1 + n_0
    share = (with_1 + with_0) / total
    g = term(with_1, n_1 * share) + term(with_0, n_0 * share)
    return g + term(n_1 - with_1, np.maximum(n_1 * (1 - share), 1e-9)) + term(n_0 - with_0, np.maximum(n_0 * (1 - share), 1e-9))


class ExampleIndex:
    """Examples as a block-max inverted index over a chosen vocabulary."""

    def __init__(self, ids, labels, texts: list[str], features: int, neighbours: int = NEIGHBOURS, block: int = BLOCK):
        self.k, self.block = neighbours, block
        labels = np.asarray(labels, dtype=np.int8)
        seen = (Counter(), Counter())
        for label, text in zip(labels, texts):
            seen[label].update(text_features(text))
        names = [f for f, n in seen[1].items() if n + seen[0][f] >= 3] + [f for f, n in seen[0].items() if n >= 3 and f not in seen[1]]
        ones = np.array([seen[1][f] for f in names], dtype=float)
        zeros = np.array([seen[0][f] for f in names], dtype=float)
        n_1, n_0 = int(labels.sum()), int(len(labels) - labels.sum())
        gain = _g_test(ones, zeros, n_1, n_0) if names else np.empty(0)
        order = sorted(np.flatnonzero(gain >= np.log(max(2, len(names)) / CHANCE)).tolist(), key=lambda i: (-gain[i], names[i]))
        chosen = order[:features]
        self.vocabulary = {names[i]: j for j, i in enumerate(chosen)}
        self.idf = np.log((1 + len(labels)) / (1 + ones[chosen] + zeros[chosen])) + 1.0
        self._word_terms: dict[str, tuple] = {}

        vectors = [self.vector_of_text(text) for text in texts]
        # Examples alike in their strongest term lie in the same blocks, which makes the bounds tight.
        rows = [i for i, (terms, _) in enumerate(vectors) if len(terms)]
        rows.sort(key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))
        self.ids = np.array([ids[i] for i in rows], dtype=np.int64)
        self.labels = labels[rows].astype(float)
        self.blocks = -(-len(rows) // block)
        # Per block the lists of its terms, as rows over the block's places; ``row_of`` finds a term's row, or none.
        self.row_of = np.full((self.blocks, len(chosen)), -1, dtype=np.int32)
        self.block_max = np.zeros((self.blocks, len(chosen)))
        self.lists: list[np.ndarray] = []
        for b in range(self.blocks):
            members = rows[b * block : (b + 1) * block]
            terms = np.unique(np.concatenate([vectors[i][0] for i in members]))
            self.row_of[b, terms] = np.arange(len(terms))
            lists = np.zeros((len(terms), block))
            for at, i in enumerate(members):
                lists[self.row_of[b, vectors[i][0]], at] = vectors[i][1]
            self.lists.append(lists)
            self.block_max[b, terms] = lists.max(axis=1)
        self._word_terms = {}

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), dtype=np.int64)
        if not len(terms):
            return terms, np.empty(0)
        weights = (1 + np.log(np.array([counts[t] for t in terms.tolist()], dtype=float))) * self.idf[terms]
        return terms, weights / np.sqrt((weights**2).sum())

    def vector_of_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts: dict[int, int] = {}
        known = self._word_terms
        for word in _WORDS(text.lower()):
            terms = known.get(word)
            if terms is None:
                terms = tuple(self.vocabulary[f] for f in word_features(word) if f in self.vocabulary)
                if len(word) <= MAX_WORD:
                    if len(known) >= 200_000:
                        known.clear()
                    known[word] = terms
            for t in terms:
                counts[t] = counts.get(t, 0) + 1
        return self.vector(counts)

    def nearest(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, nearest first."""
        if not len(terms) or not self.blocks:
            return np.empty(0, dtype=np.int64), np.empty(0)
        bounds = self.block_max[:, terms] @ weights
        best_at, best = np.empty(0, dtype=np.int64), np.empty(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(best) == self.k and bounds[b] < best[-1] - 1e-12):
                break
            rows = self.row_of[b, terms]
            there = rows >= 0
            cosines = weights[there] @ self.lists[b][rows[there]]
            at = np.flatnonzero(cosines > (best[-1] - 1e-12 if len(best) == self.k else 0))
            best_at, best = np.concatenate([best_at, at + b * self.block]), np.concatenate([best, cosines[at]])
            top = np.lexsort((best_at, -best))[: self.k]
            best_at, best = best_at[top], best[top]
        return best_at, best

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        weights = cosines**4
        return float((weights * self.labels[places]).sum() / weights.sum()) if len(places) else -1.0


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours: thresholds and the values from them on."""
    blocks: list[list[float]] = []
    for value in np.unique(x):
        here = y[x == value]
        blocks.append([value, float(here.sum()), len(here)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    # Half an example of each class keeps small pools away from certainty.
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1.0) for b in blocks])


class ToxicityModel:
    def __init__(self, examples: list[tuple[int, int, str]], rate: float, features: int = FEATURES, neighbours: int = NEIGHBOURS):
        """``rate``: share of label 1 among all labelled rows; the examples may be balanced otherwise."""
        # Copies would make every word of their text look telling: one of them is enough.
        first: dict[tuple[int, int], tuple[int, int, str]] = {}
        for example in sorted(examples):
            first.setdefault((example[1], lowest_shingle(example[2])), example)
        examples = sorted(first.values())
        ids, labels = [e[0] for e in examples], np.array([e[1] for e in examples], dtype=np.int8)
        texts = [e[2] for e in examples]
        self.trained = 0 < labels.sum() < len(labels)
        if not self.trained:
            return
        votes = np.full(len(examples), -1.0)
        fold = np.arange(len(examples)) % 2
        for out in (0, 1):
            held = np.flatnonzero(fold == out)
            part = np.flatnonzero(fold != out)
            if 0 < labels[part].sum() < len(part):
                index = ExampleIndex([ids[i] for i in part], labels[part], [texts[i] for i in part], features, neighbours)
                for i in held:
                    votes[i] = index.vote(*index.nearest(*index.vector_of_text(texts[i])))
        self.index = ExampleIndex(ids, labels, texts, features, neighbours)
        # Examples of a class stand for all labelled rows of it.
        share = labels.mean()
        odds = (rate / max(1 - rate, 1e-9)) / (share / (1 - share))
        self.steps, values = _monotone(votes, labels.astype(float))
        self.values = values * odds / (values * odds + 1 - values)

    def score(self, text: str) -> tuple[float, float, list[int], list[float]]:
        """Calibrated score, vote, and the evidence: ids of the nearest examples with their cosines."""
        if not self.trained:
            return 0.0, -1.0, [], []
        places, cosines = self.index.nearest(*self.index.vector_of_text(text))
        vote = self.index.vote(places, cosines)
        step = max(0, int(np.searchsorted(self.steps, vote, side="right")) - 1)
        return float(self.values[step]), vote, self.index.ids[places].tolist(), cosines.tolist()


def labelled_examples(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column | None, examples: int
) -> tuple[list[tuple[int, int, str]], float]:
    """At most ``examples`` labelled texts per class and the share of label 1 among all labelled rows.

    The ids are chosen first, so that the join with the texts is against a side of bounded size.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1)
    )
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    sizes = {row.label: row.n for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = text_rows(docs, id_col, text_col)
    found = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    total = sum(sizes.values())
    return [(row.id, row.label, row.text) for row in found], sizes.get(1, 0) / total if total else 0.0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    usable: Column | None = None, examples: int = EXAMPLES, **options,
) -> ToxicityModel:
    """``usable`` is a condition on the column ``id`` that rows to learn from must meet."""
    return ToxicityModel(*labelled_examples(docs, labels, id_col, text_col, label_col, usable, examples), **options)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, score, vote, evidence, similarities)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [shared.value.score(text) for text in batch.column("text").to_pylist()]
            yield batch_of(SCORED, batch.column("id"), batch.column("text_key"), *(zip(*rows) if rows else ([],) * 4))

    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), text_key(), "text")
    return rows.mapInArrow(run, SCORED_DDL)


def without_toxic(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below ``limit``."""
    toxic = score_documents(docs, model, id_col, text_col).where(F.col("score") >= limit)
    return without_rows(docs, toxic, id_col, text_col)
