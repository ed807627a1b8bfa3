"""Tokenizers: Column expressions for data, plain Python for query strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9]+"
# Java's \s is ASCII only; these are the other characters on which Python's str.split splits.
SPACES = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased ASCII alphanumeric runs, in text order.

    Runs are extracted first and lowered afterwards: lowering first would turn
    some non-ASCII letters (Kelvin sign, dotted capital I) into ASCII ones.
    """
    col = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(col, F.lit(WORD), F.lit(0)), F.lower)


def distinct_tokens(text: Column | str) -> Column:
    """Each token of the text once."""
    return F.array_distinct(tokens(text))


def whitespace_tokens(text: Column | str) -> Column:
    """The pieces between runs of Unicode white space, without empty ones."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(col, SPACES), lambda piece: piece != "")


def normalized_tokens(text: str) -> list[str]:
    """The tokens of a query string; same rule as :func:`tokens`."""
    return [run.lower() for run in re.findall(WORD, text)]


def tokenize(text: str) -> list[str]:
    """The white-space pieces of a string; same rule as :func:`whitespace_tokens`."""
    return text.split()


def query_terms(text: str | None) -> list[str]:
    """Distinct tokens of a query, in order of first appearance."""
    return list(dict.fromkeys(normalized_tokens(text or "")))
