"""Pre-tokens of texts, exactly as the tokenizers library makes them, and tokens of one pre-token.

The split pattern is run here where it is sure to give the library's result, and by the library
itself elsewhere. Sure are texts of code points below U+0180 and general punctuation, without the
few blanks and controls on which regular-expression engines differ; there the classes of letters and digits
are short lists of ranges.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from tokenizers import Tokenizer

_SURE = re.compile("[\\x09-\\x0D\\x20-\\x7E¡-ſ‐-‧‰-⁞]*")
# Letters and digits among the sure code points.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"


def read_file(path: str) -> str:
    """A tokenizer file, read by the driver; the executors get its content, whose size is that of a vocabulary."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 characters stand
    for themselves, the other bytes take the letters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_TO_LETTERS = {b: ord(c) for b, c in byte_letters().items()}
_TO_BYTES = {c: b for b, c in byte_letters().items()}


def letters_of(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_LETTERS)


def bytes_of(letters: str) -> bytes:
    return bytes([_TO_BYTES[c] for c in letters])


class Splitter:
    """Cuts texts into pre-tokens for one tokenizer; ``pattern`` is its split pattern for sure texts."""

    def __init__(self, content: str, pattern: str):
        self.tokenizer = Tokenizer.from_str(content)
        self.sure_pieces = self._find = re.compile(pattern).findall
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self._normalizer = self.tokenizer.normalizer
        self.keeps_case = self._normalizer is None

    def parts(self, text: str) -> list[str]:
        """The special tokens in a text, which the library takes out first, and the texts between them."""
        if any(s in text for s in self.special):
            return [part for part in self._cut(text) if part]
        return [text]

    def is_sure(self, part: str) -> bool:
        """Whether the split pattern of this module gives what the library gives."""
        return bool(_SURE.fullmatch(part)) and (part.isascii() or unicodedata.is_normalized("NFC", part))

    def pieces(self, part: str) -> list[str]:
        """The pre-tokens of a part without special tokens, normalized where the tokenizer does that."""
        if self.is_sure(part):
            return self._find(part if self._normalizer is None else part.lower())
        if self._normalizer is not None:
            part = self._normalizer.normalize_str(part)
        return [bytes_of(letters).decode("utf-8") for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]

    def tokens(self, data: bytes) -> list[int]:
        """The ids of one pre-token, or of a fragment of one."""
        return [t.id for t in self.tokenizer.model.tokenize(letters_of(data))]


@lru_cache(maxsize=2)
def splitter(content: str, pattern: str) -> Splitter:
    """One per worker process and vocabulary."""
    return Splitter(content, pattern)
