"""Cleaning of printed text as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Small kana and their full-size forms.
SMALL_KANA = "ァィゥェォヵヶッャュョヮぁぃぅぇぉっゃゅょゎ"
FULL_KANA = "アイウエオカケツヤユヨワあいうえおつやゆよわ"
SELECTORS = r"[︀-️]|[\x{E0100}-\x{E01EF}]"
#: ASCII and Unicode spaces, the control separators included.
SPACES = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]+"

#: Full-width ASCII and the ideographic space, by rule.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def squash(text: Column) -> Column:
    """Remove all white space, the ideographic space included."""
    return F.regexp_replace(text, SPACES, "")


def fold_width(text: Column) -> Column:
    """Full-width ASCII to ASCII inside the JVM: all that printed numbers need."""
    return F.translate(text, WIDE, NARROW)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC over Arrow batches; only texts with a character outside ASCII travel to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalize(text: Column) -> Column:
    return squash(nfkc(text))


def full_kana(text: Column) -> Column:
    """Small kana to full size; for match keys only."""
    return F.translate(text, SMALL_KANA, FULL_KANA)


def strip_selectors(text: Column) -> Column:
    """Remove variation selectors."""
    return F.regexp_replace(text, SELECTORS, "")


def name_key(text: Column) -> Column:
    """Match key of a name; the name itself stays as printed."""
    return full_kana(squash(nfkc(strip_selectors(F.coalesce(text, F.lit(""))))))


def strip_prefix(text: Column, prefixes: Sequence[str]) -> Column:
    """The rest after the longest matching prefix, or null when none matches."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(text.startswith(p), F.substr(text, F.lit(len(p) + 1))).otherwise(out)
    return out
