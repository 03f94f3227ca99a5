"""Spelling variants of words, grouped under their most frequent forms (operator 12).

Two words are near if one inserted, deleted or replaced code point makes one of the other. They are found by
asymmetric chunks: a word contributes two disjoint chunks, its halves; one edit leaves one of them whole,
moved by one place at most. The other word contributes its positional grams of those lengths at the places
where a chunk can come to lie. Chunk and gram meet by equality in a join. What is left of the two words
beside the shared chunk is again within one edit, so it is cut into chunks once more and
the key holds both: words that merely share an ending do not meet. Pairs that met are verified in the join's
condition, and only verified pairs leave it.

A word's form is its near word of largest count, if that is ``ratio`` times its own or more. Counts grow by that factor from
form to form, so a chain has at most the logarithm of the largest count many steps, and doubling the
steps of a pointer settles it in a few joins.

Words are counted within each task before the shuffle, so a word of all documents is one row a task. Keys that many
words share (long words that differ in one quarter) lean on adaptive skew joins.

Cases: null and empty texts have no words; repeated rows count each; a null id is hashed as the empty
text; equal counts prefer the smaller word in code-point order; words nobody is near have no form and are their own root.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_work_dir, work_root
from .common import byte_values, sliced, text_rows

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
DIVISOR = 199

WORDS_HELD = 200_000  # words a task counts before it hands them on


def _slip(word: str, doc: bytes, divisor: int) -> str:
    """A word as a document has it: a few lose the code point that the hash of document and word names."""
    h = zlib.crc32(word.encode(), zlib.crc32(doc))
    if h % divisor:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, divisor: int = DIVISOR,
) -> DataFrame:
    """``(word, n)``: words of at least ``min_chars`` code points that occur ``min_count`` times or more."""
    # Longest runs of at least so many letters: shorter ones cannot become long enough.
    find = re.compile(f"[A-Za-zÀ-ÿ]{{{min_chars},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return rows

        for batch in sliced(batches):
            for doc, text in zip(batch.column("id").to_pylist(), byte_values(batch.column("text"))):
                name = f"{'' if doc is None else doc}:".encode()
                # Bytes know lower case of A-Z only, which is what is meant.
                for word, n in Counter(find(text.lower().decode())).items():
                    word = _slip(word, name, divisor)
                    if len(word) >= min_chars:
                        held[word] += n
            if len(held) >= WORDS_HELD:
                yield counted()
        yield counted()

    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _cut(text: Column, size: Column, at: Column, moved: int) -> list[tuple[Column, Column]]:
    """``(kept, rest)`` for either chunk of a text of ``size`` code points cut at ``at``, as found in one that is
    ``moved`` code points longer: the first chunk where it was, the second moved on."""
    on = at + moved
    head, tail = F.substr(text, F.lit(1), at), F.substr(text, on + 1, size - at)
    return [(head, F.substr(text, at + 1, size - at + moved)), (tail, F.substr(text, F.lit(1), on))]


def _keys(word: Column, size: Column, moved: int) -> Column:
    """The four keys that a word of ``size + moved`` code points shares with chunks of words of ``size``."""
    half = F.floor(size / 2).cast("int")
    keys = []
    for side, (chunk, rest) in enumerate(_cut(word, size, half, moved)):
        left = size - half if side == 0 else half
        quarter = F.floor(left / 2).cast("int")
        for part, (piece, _) in enumerate(_cut(rest, left, quarter, moved)):
            keys.append(F.struct(size.alias("size"), F.lit(2 * side + part).alias("place"), F.concat(chunk, piece).alias("letters")))
    return F.array(*keys)


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: every pair of distinct words one edit apart, once; the shorter or smaller one is ``word``."""
    sized = words.withColumn("chars", F.char_length("word"))
    chunks = sized.select("word", "n", F.inline(_keys(F.col("word"), F.col("chars"), 0)))
    grams = [
        sized.where(F.col("chars") > moved).select(
            F.col("word").alias("near"), F.col("n").alias("near_n"), F.lit(moved).alias("moved"),
            F.inline(_keys(F.col("word"), F.col("chars") - moved, moved)),
        )
        for moved in (0, 1)
    ]
    met = chunks.join(grams[0].unionByName(grams[1]), ["size", "place", "letters"]).where(
        ((F.col("moved") == 1) | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1)
    )
    # A pair may share several keys.
    return met.select("word", "n", "near", "near_n").distinct()


def _roots(forms: DataFrame, most: int, least: int, ratio: float) -> DataFrame:
    """``(word, root)`` of the words that have a form. Every round doubles the steps a pointer goes."""
    spark, roots = forms.sparkSession, forms.select("word", F.col("form").alias("root"))
    steps = int(math.log(max(most, 1) / max(least, 1), ratio)) + 1
    for _ in range(max(steps, 1).bit_length()):
        path = new_work_dir(spark, "roots")
        roots.write.parquet(path)
        roots = spark.read.parquet(path)
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return roots


def group_variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``(word, n)``; words are distinct, counts at least 1."""
    if ratio <= 1:
        raise ValueError("a form has to be more frequent than its variant")
    spark = words.sparkSession
    path, near_path = new_work_dir(spark, "words"), new_work_dir(spark, "near")
    words.select("word", "n").write.parquet(path)
    words = spark.read.parquet(path)
    near_pairs(words).write.parquet(near_path)
    pairs = spark.read.parquet(near_path)
    turned = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The least of (-count, word) is the largest count and among equal ones the smallest word.
    best = F.min(F.struct((-F.col("near_n")).alias("below"), "near"))
    nearest = pairs.unionByName(turned).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.below") >= ratio * F.col("n")
    formed = words.join(nearest, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.below")).alias("form_n"),
    )
    formed_path = new_work_dir(spark, "forms")
    formed.write.parquet(formed_path)
    formed = spark.read.parquet(formed_path)
    ends = words.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    roots = _roots(formed.where("form IS NOT NULL"), ends.most or 1, ends.least or 1, ratio)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, **options) -> DataFrame:
    """The words of a table of texts, grouped."""
    work_root(docs.sparkSession)
    return group_variants(word_counts(docs, id_col, text_col, **options), ratio)
