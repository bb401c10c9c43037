"""Printed numbers: parsing, exact scaling, plain and signed rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_width, squash

# Marks that stand for "no value", and units printed after numbers.
NULL_MARKS = ["", "-", "‐", "－", "―", "ー", "△", "−"]
UNIT_MARKS = ",%人票"
NEGATIVE_MARKS = "△▲"
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"

DECIMAL = "decimal(20,3)"


def _stripped(text: Column) -> tuple[Column, Column]:
    raw = squash(fold_width(text))
    body = F.translate(F.regexp_replace(raw, f"^[{NEGATIVE_MARKS}]+", ""), UNIT_MARKS, "")
    return raw, body


def number_state(text: Column) -> Column:
    """``null``, ``number`` or ``bad`` for a printed cell: the audit view of parsing."""
    raw, body = _stripped(text)
    return (
        F.when(text.isNull() | raw.isin(NULL_MARKS) | body.isin(NULL_MARKS), "null")
        .when(body.rlike(NUMBER), "number")
        .otherwise("bad")
    )


def parse_decimal(text: Column, strict: bool = True, to: str = DECIMAL) -> Column:
    """Printed number to decimal: full width, commas, units, ``△▲`` as minus.

    ``△`` alone is an empty cell. Anything else that is no number is an error, or null
    when ``strict`` is off.
    """
    raw, body = _stripped(text)
    state = number_state(text)
    value = body.cast(to)
    signed = F.when(raw.rlike(f"^[{NEGATIVE_MARKS}]"), -value).otherwise(value)
    bad = F.raise_error(F.concat(F.lit("not a number: "), text)).cast(to) if strict else F.lit(None).cast(to)
    return F.when(state == "null", F.lit(None).cast(to)).when(state == "number", signed).otherwise(bad)


def parse_int(text: Column, strict: bool = True) -> Column:
    """Printed whole number; a fraction is an error (or null when not strict)."""
    value = parse_decimal(text, strict)
    bad = F.raise_error(F.concat(F.lit("not whole: "), text)).cast("bigint") if strict else F.lit(None).cast("bigint")
    return F.when(value.isNull() | (value == F.floor(value)), value.cast("bigint")).otherwise(bad)


def plain_decimal(value: Column) -> Column:
    """Decimal as text: no exponent, whole numbers without fraction, other digits kept."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def scaled(value: Column, scale: int = 1000) -> Column:
    """Exact ``value * scale`` as a whole number; a remainder is an error."""
    shifted = value.cast("decimal(38,9)") * F.lit(scale)
    return F.when(value.isNull() | (shifted == F.floor(shifted)), shifted.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("too many decimals: "), value.cast("string"))).cast("bigint")
    )


def signed_text(value: Column) -> Column:
    """``+n``, ``−n`` or ``±0``."""
    return (
        F.when(value > 0, F.concat(F.lit("+"), value.cast("string")))
        .when(value < 0, F.concat(F.lit("−"), F.abs(value).cast("string")))
        .otherwise(F.lit("±0"))
    )


def round_step(value: Column, step: int = 5) -> Column:
    """Nearest multiple of ``step``, halves to even."""
    return (F.bround(value / step) * step).cast("int")
