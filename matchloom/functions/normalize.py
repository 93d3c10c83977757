"""Text, number and date functions (N, H, M, D of the survey).  All are columns; only NFKC and case folding leave the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASCII = r"^[\x00-\x7F]*$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.strip().casefold(), na_action="ignore")


def fold(c: Column) -> Column:
    """Stripped and case folded, nothing else merged; only values that aren't ASCII are sent to Python."""
    return F.when(c.rlike(_ASCII), F.lower(strip(c))).otherwise(_folded(F.when(~c.rlike(_ASCII), c)))


@F.pandas_udf(T.StringType())
def _nfkc_fold(s: pd.Series) -> pd.Series:
    fold = lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).strip()).casefold()
    return s.map(fold, na_action="ignore")


def is_ascii(c: Column) -> Column:
    """Whether a text has no character of several bytes; null for null."""
    return F.length(c) == F.octet_length(c)


def taxonomy(c: Column, ascii_only: bool = False) -> Column:
    """NFKC, trimmed, white space collapsed, case folded; blank gives null, which callers treat as an error.

    ASCII values stay in the JVM; only others are sent to Python.  ``ascii_only`` says
    that there are no others, so that no row is.
    """
    plain = F.lower(F.trim(F.regexp_replace(c, r"[\s\x0B\x1C-\x1F]+", " ")))  # blanks are all that is left to trim
    if ascii_only:
        return F.nullif(plain, F.lit(""))
    odd = _nfkc_fold(F.when(~c.rlike(_ASCII), c))
    return F.nullif(F.when(c.rlike(_ASCII), plain).otherwise(odd), F.lit(""))


def email_key(c: Column) -> Column:
    """Stripped and case folded, so that full-width and plain letters stay apart."""
    return F.coalesce(fold(c), F.lit(""))


def phone_key(c: Column) -> Column:
    """Digits of any script; fewer than seven give an empty key."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D", "")
    return F.when(F.length(digits) >= 7, digits).otherwise("")


def display(c: Column) -> Column:
    """N4."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " "))


def extracted_text(c: Column) -> Column:
    """Struct of text and error (empty_text, text_too_long or null)."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\x00", ""), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(lines, r"(?Um)[^\S\n]+$", ""), r"(?U)\A\s+|\s+\z", "")
    error = F.when(text == "", "empty_text").when(F.length(text) > 1_000_000, "text_too_long")
    return F.struct(text.alias("text"), error.alias("error"))


# fixed values: which characters make a word of evidence or of a fact
_DASHES = re.compile("[‐-―−]")
_EVIDENCE = re.compile(r"\w+(?:[+#./-]+\w+)*[+#]*")
_FACT = re.compile(r"\w+(?:[+#./]+\w+)*[+#]*")


@F.pandas_udf(T.StringType())
def evidence_key(s: pd.Series) -> pd.Series:
    """N6."""
    return s.fillna("").map(lambda x: " ".join(_EVIDENCE.findall(_DASHES.sub("-", unicodedata.normalize("NFKC", x)))).casefold())


@F.pandas_udf(T.StringType())
def fact_key(s: pd.Series) -> pd.Series:
    """As N6, with underscores and dashes as spaces."""
    return s.fillna("").map(lambda x: " ".join(_FACT.findall(_DASHES.sub("-", unicodedata.normalize("NFKC", x).replace("_", " ")).replace("-", " "))).casefold())


def explanation(c: Column, ascii_only: bool = False) -> Column:
    """N1 with blank kept."""
    return F.coalesce(taxonomy(c, ascii_only), F.when(c.isNotNull(), ""))


def bounded(c: Column, n: int) -> Column:
    """X14."""
    return F.substring(strip(F.coalesce(c.cast("string"), F.lit(""))), 1, n)


def canonical_hash(*columns: Column | str) -> Column:
    """H1: SHA-256 of compact JSON; give the columns in the order of their names.  Nulls are kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def sorted_names(c: Column, kind: T.DataType) -> Column:
    """c with the fields of every struct and the keys of every map in it in order, however deep."""
    if isinstance(kind, T.StructType):
        fields = [sorted_names(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        entry = lambda k: F.struct(k.alias("key"), sorted_names(F.element_at(c, k), kind.valueType).alias("value"))
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(c)), entry))
    return F.transform(c, lambda x: sorted_names(x, kind.elementType)) if isinstance(kind, T.ArrayType) else c


def canonical_json(df: DataFrame) -> Column:
    """A row as compact JSON with sorted names at every level, nulls kept."""
    fields = [sorted_names(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def decimal_text(c: Column) -> Column:
    """H2: plain notation without trailing zeros."""
    text = c.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def half_up(c: Column, digits: int) -> Column:
    """M1: quantise, ties away from zero."""
    return F.round(c, digits)


def gain(grade: Column, rank: Column) -> Column:
    """M2: discounted gain of a grade at a rank from 1."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank.cast("double") + 1)


def due(until: Column, as_of: Column) -> Column:
    """A known date on or before as_of."""
    return until.isNotNull() & (until <= as_of)
