"""Text expressions: hashes, normal forms, words, lines and patterns, all evaluated in the JVM.

The character classes are Python's (str.isspace, str.splitlines), spelled out because Java's differ.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.arrow import joined, slices

SPACES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
BREAKS = [(0x0A, 0x0D), (0x1C, 0x1E), (0x85, 0x85), (0x2028, 0x2029)]


def members(ranges: list[tuple[int, int]]) -> str:
    """The inside of a character class, in the notation that Java and RE2 share."""
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


SPACE = f"[{members(SPACES)}]"
NOT_SPACE = f"[^{members(SPACES)}]"
BREAK = f"\\r\\n|[{members(BREAKS)}]"
WORD = r"\w+|[^\w\s]"


def content_hash(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 text."""
    return F.sha2(text, 256)


@F.arrow_udf(T.StringType())
def _casefold(text: pa.Array) -> pa.Array:
    return joined([pa.array([None if x is None else x.casefold() for x in part.to_pylist()], pa.string()) for part in slices(text)], pa.string())


def normalized(text: Column, casefold: str = "sql") -> Column:
    """Case folded, white space runs made one blank, none at the ends. casefold='python' folds every character as Python does, in Arrow batches."""
    if casefold not in ("sql", "python"):
        raise ValueError("casefold is sql or python")
    folded = F.lower(F.replace(text, F.lit("ß"), F.lit("ss"))) if casefold == "sql" else _casefold(text)
    return F.trim(F.regexp_replace(folded, f"{SPACE}+", " "))


def normalized_hash(text: Column, casefold: str = "sql") -> Column:
    """Hash of the normal form, for dedup."""
    return content_hash(normalized(text, casefold))


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def lines(text: Column) -> Column:
    """As str.splitlines: no piece for a break at the end, none for the empty text."""
    parts = F.split(text, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def evaluation_hash(text: Column) -> Column:
    """The other normal form, of evaluation items: ends stripped, each line's end stripped, case kept, one break at the end."""
    rows = F.transform(lines(stripped(text)), lambda x: F.regexp_replace(x, f"{SPACE}+\\z", ""))
    return content_hash(F.concat(F.array_join(rows, "\n"), F.lit("\n")))


def words(text: Column) -> Column:
    """Runs of word characters and single other signs of the normal form."""
    return F.regexp_extract_all(normalized(text), F.lit(f"(?U){WORD}"), 0)


def shingles(tokens: Column, n: int = 3) -> Column:
    """n-grams joined by U+001F; fewer tokens than n are shingles themselves. Give it a column, not an expression, which would be computed for each n-gram."""
    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), "\x1f"))
    return F.when(F.size(tokens) >= n, grams).otherwise(tokens)


def blank_or_binary(text: Column) -> Column:
    """Only white space, or a NUL inside."""
    return ~text.rlike(NOT_SPACE) | (F.instr(text, "\0") > 0)


# Patterns are put together from parts that each have a meaning.
_QUOTE = "['\"]"
_ASSIGNED = r"\s*[:=]\s*"
KEY_BLOCK = "-----BEGIN (?:" + "|".join(f"{k} " for k in ("OPENSSH", "EC", "RSA")) + ")?PRIVATE KEY-----"
CLOUD_KEY = r"\b" + "AKIA" + "[A-Z0-9]{16}" + r"\b"
QUOTED_SECRET = r"(?i)\b(?:" + "|".join(("password", "token", "secret", "api[-_]?key")) + ")" + _ASSIGNED + _QUOTE + "[^'\"]{8,}"
EMAIL = r"(?i)\b" + "[0-9A-Z%+._-]+" + "@" + "[0-9A-Z.-]+" + r"\." + "[A-Z]{2,}" + r"\b"
_DIALLED = r"\+?[0-9][0-9 ().-]{8,}[0-9]"
PHONE = f"(?<![0-9]){_DIALLED}(?![0-9])"
#: The same for engines without look-around.
PHONE_PLAIN = f"(?:^|[^0-9]){_DIALLED}(?:$|[^0-9])"
GENERATED = ("auto-generated", "do not edit", "generated file", "@generated")
VENDOR = ("build", "dist", "node_modules", "third_party", "vendor")


def has_secret(text: Column) -> Column:
    """A private key, a cloud key or a quoted credential."""
    return text.rlike(KEY_BLOCK) | text.rlike(CLOUD_KEY) | text.rlike(QUOTED_SECRET)


def has_personal_data(text: Column) -> Column:
    """An e-mail address or a telephone number."""
    return text.rlike(EMAIL) | text.rlike(PHONE)


@F.pandas_udf(T.BooleanType())
def has_personal_data_strict(text: pd.Series) -> pd.Series:
    """As has_personal_data with Python's Unicode classes: digits of all scripts count."""
    mail = re.compile(EMAIL)
    phone = re.compile(r"(?<!\d)\+?\d[\d .()-]{8,}\d(?!\d)")
    return text.map(lambda t: None if t is None else bool(mail.search(t) or phone.search(t)))
