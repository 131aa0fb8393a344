"""Arrow UDFs for Unicode rules that Spark has no function for. ASCII values never reach them."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin letters without a decomposition, and their ASCII form.
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "Æ": "AE", "Œ": "OE", "Ø": "O", "Đ": "D", "Ð": "D", "Þ": "Th", "Ł": "L", "ẞ": "SS"}


#: A character with the marks behind it; marks at the front of a text stand alone.
_CLUSTER = regex.compile(r"\P{M}\p{M}*|\p{M}", regex.DOTALL)


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


@lru_cache(maxsize=65536)
def fold_latin_text(text: str) -> str:
    """Latin letters without their marks and ligatures; other scripts stay."""
    plain = []
    for c in unicodedata.normalize("NFKD", text):
        if not _is_mark(c):
            plain.append(LATIN.get(c, c))
        elif not plain or ord(plain[-1][-1]) > 0x24F:
            plain.append(c)
    return unicodedata.normalize("NFC", "".join(plain))


@lru_cache(maxsize=65536)
def unaccent_text(text: str) -> str:
    """Marks dropped behind letters with LATIN in their name, full-width ones among them; vowel signs of other scripts stay."""
    parts = _CLUSTER.findall(unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", "".join(p[0] if "LATIN" in unicodedata.name(p[0], "") else p for p in parts))


@lru_cache(maxsize=65536)
def without_marks_text(text: str) -> str:
    """All marks dropped, those of any script."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not _is_mark(c)))


@lru_cache(maxsize=65536)
def letter_scripts(text: str) -> tuple[str, ...]:
    """First words of the names of the letters in a text, sorted."""
    return tuple(sorted({unicodedata.name(c, "UNKNOWN").partition(" ")[0] for c in text if c.isalpha()}))


def likeness(a: str, b: str) -> float:
    """Matching-blocks ratio of two strings."""
    return SequenceMatcher(a=a, b=b, autojunk=False).ratio()


@F.pandas_udf(T.StringType())
def _casefold_nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_latin(s: pd.Series) -> pd.Series:
    return s.map(fold_latin_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _unaccent(s: pd.Series) -> pd.Series:
    return s.map(unaccent_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    return s.map(without_marks_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _scripts(s: pd.Series) -> pd.Series:
    return s.map(lambda x: list(letter_scripts(x)), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Character likeness of two columns; null where either is null. Apply it to rows that passed the cheap guards."""
    return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _split(c: Column, native: Column, udf) -> Column:
    """`native` for ASCII values, the UDF (which then sees null) for others."""
    return F.when(is_ascii(c), native).otherwise(udf(F.when(~is_ascii(c), c)))


def casefold_nfkc(c: Column) -> Column:
    return F.coalesce(_split(c, F.lower(c), _casefold_nfkc), F.lit(""))


def casefold_nfc(c: Column) -> Column:
    return _split(c, F.lower(c), _casefold_nfc)


def casefold(c: Column) -> Column:
    return _split(c, F.lower(c), _casefold)


def fold_latin(c: Column) -> Column:
    return F.coalesce(_split(c, c, _fold_latin), F.lit(""))


def unaccent(c: Column) -> Column:
    return _split(c, c, _unaccent)


def without_marks(c: Column) -> Column:
    return _split(c, c, _without_marks)


def scripts(c: Column) -> Column:
    """Sorted script names of the letters of a column."""
    latin = F.when(c.rlike("[A-Za-z]"), F.array(F.lit("LATIN"))).otherwise(F.array().cast("array<string>"))
    return _split(c, latin, _scripts)
