"""Tables of regular expressions matched against texts (J10, P09, D10 with many patterns).

Most patterns cannot match without some literal text. A short piece of it, its key, is looked for first: tasks go over the
bytes of the texts once and keep the pieces that are key of any pattern, whatever the number of patterns. Texts and patterns then meet
by equality of the keys, and a pattern runs only over texts that hold its literal. Patterns
without a literal, such as ``[0-9]+``, run over every text.

What goes to all tasks is a bitmap of fixed size; the keys themselves are joined, so neither the patterns
nor the texts have to fit anywhere. Patterns are Java's, as in ``rlike``. Cases: null texts match nothing, null patterns
are left out, a pattern table with repeated rows matches once per row.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import unfold
from ..session import work_root

KEY_BYTES = (8, 4, 2, 1)  # lengths of keys, tried in this order
SLOT_BITS = 22  # the bitmap has 2 ** 22 bits: 512 KB
STEP_BYTES = 1 << 20
_ANY = 0  # the key of patterns without a literal, which every text has; no ASCII piece has it

# Letters of running text, frequent ones first; whatever is not listed is rarer.
_FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"
# After a backslash these mean the same in both languages: classes, blanks, and punctuation itself.
_SAME_ESCAPES = set("dDwWsSbBntrf") | set(string.punctuation)


def _told_apart(pattern: str) -> bool:
    """Whether a pattern is written in ways that Python's parser reads as Java does."""
    if re.search(r"\(\?[a-zA-Z-]*[uUx]", pattern):
        return False  # other letters may match under u; comments under x
    inside, at = False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if at + 1 >= len(pattern) or pattern[at + 1] not in _SAME_ESCAPES:
                return False
            at += 1
        elif c == "[":
            if inside:
                return False  # a class inside a class
            inside = True
            # A bracket that closes at once is a letter in Python only.
            if pattern[at + 1 : at + 2] == "]" or pattern[at + 1 : at + 3] == "^]":
                return False
        elif c == "]":
            inside = False
        elif inside and c == "&":
            return False
        at += 1
    return not inside


def _best(needs: list[list[str]]) -> list[str] | None:
    """The requirement with the longest shortest literal, of those with fewest alternatives."""
    return max(needs, key=lambda some: (min(map(len, some)), -len(some)), default=None)


def _needs(parsed) -> list[list[str]]:
    """What a sequence of the parse tree requires: lists of literals of which one has to stand in the text."""
    needs: list[list[str]] = []
    run = ""

    def flush() -> None:
        nonlocal run
        if run:
            needs.append([run])
        run = ""

    for kind, value in parsed:
        if kind is sre.LITERAL and value < 128:
            run += chr(value)
            continue
        if kind is sre.AT:
            continue  # a place, not a character
        if kind is sre.SUBPATTERN and all(k is sre.LITERAL and v < 128 for k, v in value[3]):
            run += "".join(chr(v) for _, v in value[3])
            continue
        flush()
        if kind is sre.SUBPATTERN:
            needs += _needs(value[3])
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            needs += _needs(value[2])
        elif kind is sre.BRANCH:
            branches = [_best(_needs(branch)) for branch in value[1]]
            if None not in branches:
                needs.append([literal for branch in branches for literal in branch])
    flush()
    return needs


def required_literals(pattern: str) -> list[str] | None:
    """Literals, lower-cased, of which every match holds one; None if no such are known."""
    if not _told_apart(pattern):
        return None
    try:
        parsed = sre_parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    best = _best(_needs(parsed))
    return None if best is None else sorted({literal.lower() for literal in best})


def key_of(literal: str) -> str:
    """The piece of a literal that running text holds least often."""
    size = next(n for n in KEY_BYTES if n <= len(literal))
    pieces = [literal[i : i + size] for i in range(len(literal) - size + 1)]
    return max(pieces, key=lambda p: (sum(_FREQUENT.find(c) % 100 for c in p), p))


def _key_numbers(data: np.ndarray, size: int) -> np.ndarray:
    """A number for the piece of so many bytes, a power of two, that begins at each byte; lengths are told apart."""
    numbers = data.astype(np.uint64)
    for half in (1, 2, 4):
        if half < size:
            numbers = numbers[: max(len(numbers) - half, 0)] | numbers[half:] << np.uint64(8 * half)
    return ((numbers + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _slots(numbers: np.ndarray) -> np.ndarray:
    return numbers.view(np.uint64) >> np.uint64(64 - SLOT_BITS)


_INDEX_DDL = "array<struct<_key: long, _size: int, _literal: string, _earlier: string>>"


def pattern_index(patterns: DataFrame, pattern_col: str) -> DataFrame:
    """The pattern table with a key and its length, one row for each of the literals of which a pattern needs one;
    where these are several, with the literal and a pattern of those in the rows before."""

    @F.pandas_udf(_INDEX_DDL)
    def keys(values: pd.Series) -> pd.Series:
        def one(pattern: str) -> list[dict]:
            literals = required_literals(pattern)
            if literals is None:
                return [{"_key": _ANY, "_size": 0, "_literal": None, "_earlier": None}]
            rows = []
            for n, literal in enumerate(literals):
                piece = np.frombuffer(key_of(literal).encode(), dtype=np.uint8)
                row = {"_key": int(_key_numbers(piece, len(piece))[0]), "_size": len(piece)}
                several = {"_literal": literal, "_earlier": "|".join(map(re.escape, literals[:n])) or None}
                rows.append(row | (several if len(literals) > 1 else {"_literal": None, "_earlier": None}))
            return rows

        return values.map(one)

    pattern = F.col(f"`{pattern_col}`")
    return unfold(patterns.where(pattern.isNotNull()), patterns.columns, keys(pattern), "_need").select(
        *[f"`{c}`" for c in patterns.columns], "_need.*"
    )


def _bitmap(index: DataFrame) -> np.ndarray:
    """Which slots any key falls into: ``2 ** SLOT_BITS / 64`` rows at most come to the driver."""

    @F.pandas_udf("long")
    def slot(keys: pd.Series) -> pd.Series:
        return pd.Series(_slots(keys.to_numpy(np.int64)).astype(np.int64))

    slots = index.select("_key").distinct().select(slot("_key").alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")
    )
    out = np.zeros(1 << (SLOT_BITS - 6), dtype=np.int64)
    for row in words.collect():
        out[row.word] = row.bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _held(data: np.ndarray, ends: np.ndarray, bitmap: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """``(text, key)`` of the keys that texts hold, each once; ``ends`` are where the texts end."""
    texts, keys = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for size in sizes:
        numbers = _key_numbers(data, size)
        at = np.flatnonzero(bitmap[_slots(numbers)])
        text = np.searchsorted(ends, at, side="right")
        inside = at + size <= ends[text]
        texts.append(text[inside])
        keys.append(numbers[at[inside]])
    found = np.unique(np.stack([np.concatenate(texts), np.concatenate(keys)]), axis=1)
    return zip(*found.tolist())


def _keys_held(values: pd.Series, bitmap: np.ndarray, sizes: list[int]) -> pd.Series:
    out = [{_ANY} for _ in range(len(values))]
    texts = [b"" if x is None else x.encode().lower() for x in values]
    stops = np.cumsum([0, *map(len, texts)])
    first = 0
    while first < len(texts):
        # As many texts as fill a step. A longer one is taken alone, in slices that overlap by a key.
        last = max(first + 1, int(np.searchsorted(stops, stops[first] + STEP_BYTES, side="right")) - 1)
        data = np.frombuffer(b"".join(texts[first:last]), dtype=np.uint8)
        ends = stops[first + 1 : last + 1] - stops[first]
        for begin in range(0, len(data), STEP_BYTES):
            part = data[begin : begin + STEP_BYTES + max(KEY_BYTES)]
            for text, key in _held(part, np.clip(ends - begin, 0, len(part)), bitmap, sizes):
                out[first + text].add(key)
        first = last
    return pd.Series([sorted(x) for x in out], dtype=object)


def _with_keys(texts: DataFrame, text_col: str, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """The rows with the list of keys that their texts hold; ASCII letters count as lower case."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield _keys_held(values, shared.value, sizes)

    return texts.withColumn("_keys", keys(F.col(f"`{text_col}`")))


def candidates(texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """Every pair of a text and a pattern whose key the text holds, once. The tables share no column names."""
    work_root(texts.sparkSession)
    text = F.col(f"`{text_col}`")
    index = pattern_index(patterns, pattern_col).checkpoint()
    literal = index.where("_size > 0")
    sizes = [row[0] for row in literal.select("_size").distinct().collect()]  # some of KEY_BYTES
    kept = _with_keys(texts.where(text.isNotNull()), text_col, _bitmap(literal), sizes)
    columns = [*texts.columns, *patterns.columns]
    if index.where("_size = 0").isEmpty():
        kept = kept.withColumn("_keys", F.array_remove("_keys", F.lit(_ANY)))
    met = unfold(kept, texts.columns, F.col("_keys"), "_key").join(index, "_key")
    # A text may hold several of the literals: it meets the pattern by the first of them.
    lowered = F.lower(text)
    holds = F.contains(lowered, F.col("_literal")) & (F.col("_earlier").isNull() | ~F.rlike(lowered, F.col("_earlier")))
    return met.where(F.col("_literal").isNull() | holds).select(*[f"`{c}`" for c in columns])


def matches(texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """Every pair of a text and a pattern that matches somewhere in it."""
    found = candidates(texts, text_col, patterns, pattern_col)
    return found.where(F.rlike(F.col(f"`{text_col}`"), F.col(f"`{pattern_col}`")))


def findings(texts: DataFrame, id_col: str, text_col: str, patterns: DataFrame, rule_col: str, pattern_col: str) -> DataFrame:
    """``(id, rule, match)``: one row for each place where a pattern matches."""
    found = candidates(texts.select(id_col, text_col), text_col, patterns.select(rule_col, pattern_col), pattern_col)
    places = F.regexp_extract_all(F.col(text_col), F.col(pattern_col), F.lit(0))
    return unfold(found, [id_col, rule_col], places, "match").select(id_col, F.col(rule_col).alias("rule"), "match")
