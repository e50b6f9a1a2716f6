"""Text columns: normal forms, snippets, n-grams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def name_key(s: pd.Series) -> pd.Series:
    """What names are compared by where letter case and normal form don't count."""
    return s.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ascii_fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def snippet(text: Column, term: str, before: int = 40, width: int = 120) -> Column:
    """``width`` characters around the first place of ``term``, with ellipses where text was cut; null where it doesn't occur."""
    found = F.locate(term.lower(), ascii_fold(text))
    at = F.greatest(found - before, F.lit(1))
    cut = F.substring(text, at, F.lit(width))
    return F.when(found > 0, F.concat(F.when(at > 1, "…").otherwise(""), squeeze(cut), F.when(at + width - 1 < F.length(text), "…").otherwise("")))


def highlight(text: Column, term: str) -> Column:
    return F.regexp_replace(text, "(?i)(" + _quoted(term) + ")", "[$1]")


def _quoted(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def ngrams(text: Column, n: int) -> Column:
    """All n-character substrings in order; none of a shorter text. The text is cut into characters once, so long texts take linear time."""
    chars = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    cut = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(chars, cut), F.lit(0))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold(term: str) -> str:
    """What a search term and a text are compared by: compatibility forms and letter case don't count."""
    return unicodedata.normalize("NFKC", term).casefold()
