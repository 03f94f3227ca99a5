"""Record checks and admission rules (P15-P18, P20). Every failed rule is reported, not just the first."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import (
    BUILD_FORMATS,
    EMAIL_PATTERN,
    NAME_PATTERN,
    REGEX_MAX_CHARS,
    UNSAFE_REGEX_PATTERNS,
    UPLOAD_EXTENSIONS,
    UPLOAD_MAX_BYTES,
    UPLOAD_TYPES,
)
from ..functions import any_match, any_suffix, as_col


def errors_of(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that do not hold; a rule that is null does not hold."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()])
    )


def email_rule(value: Column | str) -> Column:
    return as_col(value).rlike(EMAIL_PATTERN)


def user_name_rules(value: Column | str) -> dict[str, Column]:
    value = as_col(value)
    return {
        "user name length": F.length(value).between(3, 30),
        "user name characters": value.rlike(NAME_PATTERN),
    }


def api_key_rules(value: Column | str) -> dict[str, Column]:
    value = as_col(value)
    return {"api key length": F.length(value) >= 10, "api key characters": value.rlike(NAME_PATTERN)}


def password_rule(value: Column | str) -> Column:
    return F.length(as_col(value)) >= 8


def build_format_rule(value: Column | str) -> Column:
    return F.lower(as_col(value)).isin(BUILD_FORMATS)


def thread_count_rule(value: Column | str) -> Column:
    return as_col(value).between(1, 30)


def regex_rules(value: Column | str) -> dict[str, Column]:
    """Length and unsafe constructs. Whether a pattern compiles is asked once per pattern, by ``check_regex``."""
    value = as_col(value)
    return {
        "pattern length": F.length(value) <= REGEX_MAX_CHARS,
        "pattern constructs": ~any_match(value, UNSAFE_REGEX_PATTERNS),
    }


def check_regex(pattern: str) -> str:
    """A pattern given as an argument of a job, checked before the job starts."""
    if len(pattern) > REGEX_MAX_CHARS:
        raise ValueError(f"pattern is longer than {REGEX_MAX_CHARS} characters")
    if any(re.search(unsafe, pattern) for unsafe in UNSAFE_REGEX_PATTERNS):
        raise ValueError("pattern has unsafe constructs")
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"pattern does not compile: {error}") from error
    return pattern


def upload_rules(name: Column | str, kind: Column | str, size: Column | str, storage: Column | str) -> dict[str, Column]:
    name, kind, size = F.lower(as_col(name)), as_col(kind), as_col(size)
    return {
        "type": F.trim(kind).isin(UPLOAD_TYPES),
        "storage index": as_col(storage).cast("string").rlike("^[0-9]+$"),
        "empty": size > 0,
        "too large": size <= UPLOAD_MAX_BYTES,
        "file name": F.trim(name) != "",
        "extension": any_suffix(name, UPLOAD_EXTENSIONS),
        "app type": ~name.endswith(".apk") | (kind == "apk"),
    }
