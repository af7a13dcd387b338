"""The shared text dialect: white space, normal form, keyed deduplication.

Regular expressions name their white space and word borders explicitly, since
the engine's own classes are ASCII-only for one and Han-aware for the other.
Lengths are code points.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Inside a character class.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{WS}]"
#: The same characters one by one, for functions that take no pattern.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
HAN = r"\u4e00-\u9fa5"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; the one step without a built-in."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in ts], na_action="ignore")


def nfkc_text(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def tidy(text: Column) -> Column:
    """Quotes, white space and case of an already composed text."""
    plain = F.translate(text, "“”‘’" + WS_CHARS, "\"\"''" + " " * len(WS_CHARS))
    return F.lower(F.trim(F.regexp_replace(plain, "  +", " ")))


def normalize(text: Column) -> Column:
    return tidy(nfkc(text))


def normalize_all(texts: Column) -> Column:
    return F.transform(nfkc_all(texts), tidy)


def normalize_literal(text: str) -> str:
    """The same, for a query on the driver."""
    text = nfkc_text(text).translate(str.maketrans("“”‘’", "\"\"''"))
    return re.sub(f"[{WS}]+", " ", text).strip(" ").lower()


def unique_by(values: Column, keys: Column) -> Column:
    """Values in order, the first of each key; ``keys`` runs beside ``values``."""
    pairs = F.arrays_zip(values.alias("v"), keys.alias("k"))
    kept = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.transform(kept, lambda p: p["v"])


def compact(text: Column, limit: int = 520) -> Column:
    """Lines trimmed, empty ones dropped, joined by blanks, cut."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n", -1), trim), lambda x: x != "")
    return F.left(F.array_join(lines, " "), F.lit(limit))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out
