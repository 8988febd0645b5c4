"""Text helpers: optional text, strict numbers, name folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER_PATTERN = r"^\+?[0-9]+$"
DOUBLE_PATTERN = (
    r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def strict_long(text: Column, maximum: int) -> Column:
    """Unsigned integer up to `maximum`; blanks around the digits are not accepted."""
    value = text.try_cast("long")
    return F.when(text.rlike(INTEGER_PATTERN) & (value <= maximum), value)


def strict_double(text: Column) -> Column:
    return F.when(text.rlike(DOUBLE_PATTERN), text.try_cast("double"))


def normalize_name(name: Column) -> Column:
    """Trimmed, inner white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"[\s\p{Z}]+", " ")))


def _accent_pairs() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is one base letter plus marks."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and all(unicodedata.category(part) == "Mn" for part in parts[1:]):
            accented.append(letter)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_pairs()


def fold_text(text: Column) -> Column:
    """Case and diacritics removed; combining marks dropped."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def search_terms(query: Column) -> Column:
    """White-space separated terms of a query, blanks dropped."""
    return F.filter(F.split(query, r"[\s\p{Z}]+"), lambda term: term != "")
