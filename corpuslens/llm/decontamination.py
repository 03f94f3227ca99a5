"""Benchmark passages in documents, in DataFrame functions only (operator 4).

A benchmark item gives windows of 13 consecutive words; a shorter item is one window. A window is
contained in a document when its words stand there in a row. The search is a prefix-filtered set
join: containment needs every token of the window, so the prefix that must be shared is a single
token, and the rarest of the corpus is chosen (counted over all documents). Document words are
joined with these tokens only; the place of the token in the window gives the one start at which
the window can lie (positional bound), which must leave room for it (length bound); then the words
are compared. The comparison runs in the task that holds the document, so no text is shuffled.

The windows are broadcast only if they are few (``broadcast_windows``); beyond that the tokens are
joined by a shuffle and the candidates go back to their documents to be verified.

Cases: null and empty texts have no words, are never hit and never contaminated; an item without
words or without an id matches nothing. Items of one id are one item. Rows with the same id and text
have the same result, rows with the same id and other texts their own. An empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_root
from .common import ascii_lower, join_rows, text_key, text_rows, without_rows

WINDOW_WORDS = 13
BROADCAST_WINDOWS = 200_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = ""  # no word is empty: it stands after the last word of every document


def words_of(text: Column) -> Column:
    """The words of a text, A-Z made lower case."""
    return F.array_remove(F.split(ascii_lower(text), _SEPARATORS), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, window_words: int) -> DataFrame:
    """``(item, window)``: the distinct windows of every item."""
    words = text_rows(items, id_col, text_col).where(F.col("id").isNotNull()).select(
        F.col("id").alias("item"), words_of(F.col("text")).alias("words")
    )
    length = F.least(F.lit(window_words), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    return (
        words.where(F.size("words") > 0)
        .select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, length))).alias("window"))
        .distinct()
    )


def rarest_tokens(windows: DataFrame, doc_words: DataFrame, small: bool) -> DataFrame:
    """``(window, token, place)``: the token of each window that the corpus has least often."""
    spelled = windows.select("window", F.posexplode("window").alias("place", "token"))
    terms = spelled.select("token").distinct()
    counts = (
        doc_words.select(F.explode_outer("words").alias("token"))
        .join(F.broadcast(terms) if small else terms, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")
    return (
        spelled.join(counts, "token", "left")
        .groupBy("window")
        .agg(F.min(rarity).alias("rarest"))
        .select("window", "rarest.token", "rarest.place")
    )


def window_matches(docs: DataFrame, tokens: DataFrame, small: bool) -> DataFrame:
    """``(id, text_key, n_words, start, window)``: every occurrence of a window, and one row without
    a window for every document."""
    words = docs.select("id", text_key(), words_of(F.col("text")).alias("words"))
    end = tokens.sparkSession.range(1).select(
        F.lit(_END).alias("token"), F.lit(0).alias("place"), F.lit(None).cast("array<string>").alias("window")
    )
    keys = tokens.select("token", "place", "window").unionByName(end)
    fits = (F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n_words"))
    if small:
        placed = words.select(
            "id", "text_key", "words", F.posexplode_outer(F.concat("words", F.array(F.lit(_END)))).alias("at", "token")
        )
        start = F.col("at") - F.col("place")
        equal = F.slice("words", start + 1, F.size("window")) == F.col("window")
        hit = (start >= 0) & (start + F.size("window") <= F.size("words")) & equal
        return (
            placed.join(F.broadcast(keys), "token")
            .where(F.col("window").isNull() | hit)
            .select("id", "text_key", F.size("words").alias("n_words"), start.alias("start"), "window")
        )
    placed = words.select(
        "id", "text_key", F.size("words").alias("n_words"),
        F.posexplode_outer(F.concat("words", F.array(F.lit(_END)))).alias("at", "token"),
    )
    candidates = (
        placed.join(keys, "token")
        .select("id", "text_key", "n_words", (F.col("at") - F.col("place")).alias("start"), "window")
        .where(F.col("window").isNull() | fits)
    )
    grouped = candidates.groupBy("id", "text_key").agg(F.collect_set(F.struct("n_words", "start", "window")).alias("c"))
    verified = F.filter(
        "c", lambda c: c["window"].isNull() | (F.slice("words", c["start"] + 1, F.size(c["window"])) == c["window"])
    )
    return (
        join_rows(words, grouped).select("id", "text_key", F.inline(verified))
    )


def _words_covered(spans: Column) -> Column:
    """Number of places covered by (start, length) spans."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def step(state, span):
        end = span["start"] + span["length"]
        fresh = F.greatest(F.lit(0), end - F.greatest(span["start"], state["upto"]))
        return F.struct(F.greatest(state["upto"], end).alias("upto"), (state["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda state: state["n"])


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window_words: int = WINDOW_WORDS, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``(id, text_key, n_words, n_hit, items)`` for every distinct (id, text): words, words inside
    occurring windows, and the sorted ids, as text, of the items with such windows."""
    work_root(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    windows = item_windows(benchmark, item_col, item_text_col, window_words)
    distinct = windows.select("window").distinct()
    small = distinct.limit(broadcast_windows + 1).count() <= broadcast_windows
    tokens = rarest_tokens(distinct, rows.select(words_of(F.col("text")).alias("words")), small)
    matches = window_matches(rows, tokens, small)
    span = F.when(F.col("window").isNotNull(), F.struct("start", F.size("window").alias("length")))
    per_doc = matches.groupBy("id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        _words_covered(F.collect_set(span)).cast("long").alias("n_hit"),
        F.collect_set("window").alias("windows"),
    ).checkpoint()
    items = (
        per_doc.select("id", "text_key", F.explode("windows").alias("window"))
        .join(windows, "window")
        .groupBy("id", "text_key")
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    return join_rows(per_doc, items, "left").select(
        "id", "text_key", "n_words", "n_hit",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    """The rule: at least a twentieth of the words lies inside benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, whose documents are not contaminated."""
    bad = benchmark_hits(docs, benchmark, id_col, text_col, **options).where(contaminated())
    return without_rows(docs, bad, id_col, text_col)
