"""Text functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import SANITISE_PATTERN
from . import as_col

# Stop words that score a language; the best score wins.
STOP_WORDS = {
    "en": ["the", "of", "and", "is", "are", "with", "for", "that"],
    "fr": ["le", "les", "des", "une", "que", "pour", "dans", "est"],
    "de": ["der", "die", "und", "ist", "ein", "eine", "von", "zu"],
    "es": ["el", "los", "las", "una", "es", "por", "para", "del"],
}
LANGUAGE_NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}

URL_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$"
NUMERIC_PATTERN = r"^[+-]?[0-9]+([.][0-9]+)?$"
FILE_PATH_PATTERN = r"^(/[^/\s]+)+/?$"
SQL_PATTERN = r"(?i)^\s*(select\s.+\sfrom|insert\s+into|update\s.+\sset|delete\s+from|create\s+table)\s"
BASE64_PATTERN = r"^(?:[A-Za-z0-9+/]{4}){4,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
HEX_PATTERN = r"^(?:[0-9a-fA-F]{2}){16,}$"
SECRET_PATTERN = r"(?i)(api[_-]?key|secret|token|passw(or)?d)\s*[=:]\s*[\"']?[A-Za-z0-9/+_-]{8,}"


def sanitise_text(value: Column | str) -> Column:
    """Keep letters, digits, square brackets, comma, dash and underscore."""
    return F.regexp_replace(as_col(value), SANITISE_PATTERN, "")


def sanitise_identity(value: Column | str) -> Column:
    """E-mail addresses and user names: lower case, no blanks around."""
    return F.lower(F.trim(as_col(value)))


def url_parts(url: Column | str) -> dict[str, Column]:
    """Scheme, domain, path, params, query and fragment; absent parts are empty."""
    url = as_col(url)

    def part(name: str) -> Column:
        return F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))

    path = part("PATH")
    return {
        "url_scheme": part("PROTOCOL"),
        "url_domain": part("HOST"),
        "url_path": F.split(path, ";", 2)[0],
        "url_params": F.coalesce(F.get(F.split(path, ";", 2), F.lit(1)), F.lit("")),
        "url_query": part("QUERY"),
        "url_fragment": part("REF"),
    }


def word_count(text: Column | str) -> Column:
    """Runs of non-blank characters."""
    return F.regexp_count(as_col(text), F.lit(r"\S+"))


_FEW_POINTS = 1 << 12  # texts of smaller code points are counted in a table, others by sorting


def _entropy(text: str | None) -> float:
    """Natural entropy of a text's characters: with k occurrences of a character among n, ln n - sum(k ln k) / n."""
    if not text:
        return 0.0
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(points) if points.max() < _FEW_POINTS else np.unique(points, return_counts=True)[1]
    counts = counts[counts > 0].astype(float)
    return abs(math.log(len(points)) - float((counts * np.log(counts)).sum()) / len(points))


def entropies(text: Column | str) -> Column:
    """Natural, Shannon and Hartley entropy of the characters as a struct. Null and empty texts have none: 0.

    One count of the characters, whatever their number: there is no built-in function that counts the elements of an array.
    """

    @F.pandas_udf("natural_entropy double, shannon_entropy double, hartley_entropy double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        natural = np.array([_entropy(t) for t in texts], dtype=float)
        return pd.DataFrame({"natural_entropy": natural, "shannon_entropy": natural / math.log(2), "hartley_entropy": natural / math.log(10)})

    return measure(as_col(text))


def _is_one_of(words: list[str]):
    return lambda word: word.isin(words)


def language_scores(text: Column | str) -> Column:
    """An array of (score, code), one per language: how many words are stop words of it.

    One pass finds the stop words of all languages, which are then counted per language.
    """
    every = "|".join(word for stops in STOP_WORDS.values() for word in stops)
    pattern = rf"(?<!\p{{L}})(?:{every})(?!\p{{L}})"
    found = F.regexp_extract_all(F.lower(as_col(text)), F.lit(pattern), F.lit(0))

    def count(words: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.size(F.filter(words, _is_one_of(stops))).alias("score"),
                    F.lit(code).alias("code"),
                )
                for code, stops in STOP_WORDS.items()
            ]
        )

    return F.transform(F.array(found), count)[0]


def language(text: Column | str) -> Column:
    """Best-scoring language, its name, and its share of all stop words found, as a struct."""
    names = F.create_map(*[F.lit(v) for item in LANGUAGE_NAMES.items() for v in item])

    def judge(scores: Column) -> Column:
        best = F.array_max(scores)
        total = F.aggregate(scores, F.lit(0), lambda acc, s: acc + s["score"])
        return F.struct(
            F.when(total > 0, best["code"]).alias("language_code"),
            F.when(total > 0, names[best["code"]]).alias("language_name"),
            F.when(total > 0, best["score"] / total).otherwise(F.lit(0.0)).alias("language_confidence"),
        )

    # The scores are bound once, so the text is scanned once per language.
    return F.transform(F.array(language_scores(text)), judge)[0]


def text_flags(text: Column | str) -> dict[str, Column]:
    """Category flags of a string. ``isUnknownCategory`` is what none of the others claims."""
    text = as_col(text)
    bare = F.trim(text)
    flags = {
        "isNumeric": bare.rlike(NUMERIC_PATTERN),
        "isURL": bare.rlike(URL_PATTERN),
        "isFilePath": bare.rlike(FILE_PATH_PATTERN),
        "isSQLStatement": text.rlike(SQL_PATTERN),
        "isEncoded": bare.rlike(BASE64_PATTERN) | bare.rlike(HEX_PATTERN),
        "isSecret": text.rlike(SECRET_PATTERN),
        "isNaturalLanguage": F.size(F.split(bare, r"\s+")) >= 4,
    }
    claimed = F.lit(False)
    for flag in flags.values():
        claimed = claimed | flag
    flags["isUnknownCategory"] = ~claimed
    return flags
