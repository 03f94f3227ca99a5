"""Token counts without encoding whole texts or shuffling pre-tokens (operator 5).

A text's count is the sum over its pre-tokens. The lengths of the frequent ones (at most
``FREQUENT``, so the size is bounded) are broadcast as a hash table; what is not in it is encoded by the worker that
meets it and remembered in that worker's cache, which is emptied when it reaches ``CACHE``
entries. The table only saves work: it is made from the vocabulary, not from the documents, and any table gives the same
counts.

Cases: null and empty texts have no tokens; repeated rows give repeated results; special tokens
inside a text count as one token each, as the library has them by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_values, sliced, text_rows
from .pretokens import DIGITS, LETTERS, bytes_of, read_file, splitter

FREQUENT = 50_000
CACHE = 200_000
# The split pattern of the vocabulary with word ends: words, single digits, short endings, anything else.
WORD_PATTERN = rf"[{LETTERS}]+|[{DIGITS}]|'(?:[stmd]|re|ve|ll)|[^\s{LETTERS}{DIGITS}]+"

_COUNTED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def frequent_lengths(content: str, pattern: str, frequent: int = FREQUENT) -> dict[str, int]:
    """The pre-tokens that the vocabulary has as whole words, with their lengths in tokens.

    A vocabulary's words are the frequent ones of the text it was made from, the most frequent first.
    """
    split = splitter(content, pattern)
    end = json.loads(content)["model"].get("end_of_word_suffix") or ""
    words = sorted((i, token) for token, i in split.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(end))
    found: dict[str, int] = {}
    for _, token in words:
        if len(found) >= frequent:
            break
        try:
            piece = bytes_of(token.removesuffix(end)).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character
        # Only what the split gives back as one pre-token can be looked up.
        if piece and split.is_sure(piece) and split.pieces(piece) == [piece]:
            found[piece] = len(split.tokens(piece.encode()))
    return found


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = WORD_PATTERN, frequent: int = FREQUENT
) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row; ``vocabulary`` is the path of a tokenizers file."""
    content = read_file(vocabulary)
    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((content, frequent_lengths(content, pattern, frequent)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, frequent = shared.value
        split = splitter(content, pattern)
        cache: dict[str, int] = {}

        def length(piece: str) -> int:
            known = cache.get(piece)
            if known is None:
                if len(cache) >= CACHE:
                    cache.clear()
                known = len(split.tokens(piece.encode()))
                if len(piece) < 256:
                    cache[piece] = known
            return known

        def tokens(text: str) -> int:
            total = 0
            for part in split.parts(text):
                if part in split.special:
                    total += 1
                    continue
                pieces = split.pieces(part)
                lengths = list(map(frequent.get, pieces))
                if None in lengths:
                    lengths = [length(p) if n is None else n for p, n in zip(pieces, lengths)]
                total += sum(lengths)
            return total

        for batch in sliced(batches):
            texts = byte_values(batch.column("text"))
            yield batch_of(_COUNTED, batch.column("id"), [len(t) for t in texts], [tokens(t.decode()) for t in texts])

    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")
