"""String normalisation and numbers in text.

ASCII values take built-in functions only.  Other values go through Arrow functions, which see a null
for every ASCII row, so they cost what the non-ASCII part costs.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Apostrophe-like marks are dropped, these symbols separate words as punctuation does.
APOSTROPHES = "'’‘ʻʼʹ`´"
SYMBOLS = "+$<=>|~^"
# Magnitudes after a number.
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "million": 1e6, "billion": 1e9}

_ASCII = r"^[\x00-\x7F]*$"
_GAPS = r"[\s\x1c-\x1f!-/:-@\[-`{-~]+"
#: Number with optional thousands commas, fraction, exponent and magnitude, apart from other words.
NUMBER = r"(?iU)(?<![\w.])([-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:e[-+]?\d+)?)(?:\s*(k|thousand|million|billion))?(?![\w.])"
_PLAIN = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"
_WORDY = r"^[+-]?(?:inf|infinity|nan)$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=None)
def _folded(char: str) -> str:
    if char in APOSTROPHES or unicodedata.combining(char):
        return ""
    return " " if char in SYMBOLS or unicodedata.category(char)[0] == "P" else char


def normalize_text(value: str) -> str:
    """Comparison key of one string: case, accents, apostrophes and punctuation do not count."""
    bare = value.strip().translate(_DROPPED)
    return " ".join("".join(map(_folded, unicodedata.normalize("NFKD", bare).casefold())).split())


_DROPPED = dict.fromkeys(map(ord, APOSTROPHES))


@F.pandas_udf(T.StringType())
def _normalize_udf(values: pd.Series) -> pd.Series:
    return values.map(normalize_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normalize_all_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: [None if x is None else normalize_text(x) for x in xs], na_action="ignore")


def ascii_key(c: str | Column) -> Column:
    """The comparison key by built-in functions; right for ASCII strings."""
    return F.btrim(F.regexp_replace(F.lower(F.translate(_col(c), "'`", "")), _GAPS, " "))


def key(c: str | Column) -> Column:
    """Comparison key of a string column; null stays null."""
    plain = _col(c).rlike(_ASCII)
    return F.coalesce(F.when(plain, ascii_key(c)), _normalize_udf(F.when(~plain, _col(c))))


def keys(c: str | Column) -> Column:
    """Comparison keys of an array of strings, in place."""
    plain = F.forall(_col(c), lambda x: F.coalesce(x.rlike(_ASCII), F.lit(True)))
    return F.coalesce(F.when(plain, F.transform(_col(c), ascii_key)), _normalize_all_udf(F.when(~plain, _col(c))))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _normalize_nested_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda gs: [[normalize_text(x) for x in (g if g is not None else ()) if x is not None] for g in gs], na_action="ignore")


def nested_keys(c: str | Column) -> Column:
    """Comparison keys of an array of arrays of strings; null groups are empty."""
    none = F.array().cast("array<string>")
    real = F.transform(_col(c), lambda g: F.filter(F.coalesce(g, none), lambda x: x.isNotNull()))
    plain = F.forall(real, lambda g: F.forall(g, lambda x: x.rlike(_ASCII)))
    return F.coalesce(F.when(plain, F.transform(real, lambda g: F.transform(g, ascii_key))), _normalize_nested_udf(F.when(~plain, real)))


def parse_float(value: str) -> float | None:
    """The number that a string spells, commas aside."""
    try:
        return float(value.replace(",", ""))
    except ValueError:
        return None


@F.pandas_udf(T.DoubleType())
def _float_udf(values: pd.Series) -> pd.Series:
    return values.map(parse_float, na_action="ignore").astype("float64")


def number(c: str | Column) -> Column:
    """The number that a string spells, commas aside; null if it spells none."""
    plain = _col(c).rlike(_ASCII)
    bare = F.regexp_replace(F.replace(_col(c), F.lit(","), F.lit("")), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    word = F.lower(bare)
    named = F.when(F.contains(word, F.lit("nan")), F.lit(float("nan"))).otherwise(
        F.when(F.startswith(word, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    )
    native = F.when(bare.rlike(_PLAIN), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double")).when(word.rlike(_WORDY), named)
    return F.when(plain, native).otherwise(_float_udf(F.when(~plain, _col(c))))


def format_float(value: float) -> str:
    """Whole numbers without a point, others with six significant digits."""
    return str(int(value)) if float(value).is_integer() else f"{value:g}"


@F.pandas_udf(T.StringType())
def _format_udf(values: pd.Series) -> pd.Series:
    return values.map(format_float, na_action="ignore").astype(object)


def number_text(c: str | Column) -> Column:
    """Text of a finite number, as ``format_float`` writes it."""
    x = _col(c)
    short = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(short, x.cast("long").cast("string")).otherwise(_format_udf(F.when(~short, x)))


def leading_number(c: str | Column) -> Column:
    """The first number in a string as text; magnitudes and exponents are multiplied out."""
    digits = F.replace(F.regexp_extract(_col(c), NUMBER, 1), F.lit(","), F.lit(""))
    scale = F.lower(F.regexp_extract(_col(c), NUMBER, 2))
    factor = F.lit(1.0)
    for name, value in MAGNITUDES.items():
        factor = F.when(scale == name, F.lit(value)).otherwise(factor)
    worded = (scale != "") | F.contains(F.lower(digits), F.lit("e"))
    value = F.when(worded, number(digits) * factor)
    return F.when(digits == "", F.lit(None).cast("string")).when(worded, number_text(value)).otherwise(digits)


_NUMBER = re.compile(NUMBER.replace("(?iU)", ""), re.IGNORECASE)


def first_number(value: str) -> str | None:
    """As ``leading_number``, of one string."""
    hit = _NUMBER.search(value)
    if hit is None:
        return None
    digits, scale = hit[1].replace(",", ""), (hit[2] or "").lower()
    return format_float(float(digits) * MAGNITUDES.get(scale, 1)) if scale or "e" in digits.lower() else digits
