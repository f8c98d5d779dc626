"""Item-number and key normalisers.

The rules differ on purpose: graph joins pad and cut to six characters, loading
pads digits only and never cuts, coverage pads digits to ten, and trace ids pad
without cutting and spell a missing item out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM_WIDTH = 6
COVERAGE_WIDTH = 10


def strip(value: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def zero_fill(value: Column, width: int) -> Column:
    """Left-pad with zeros behind a leading sign, never cutting the text."""
    sign = F.substring(value, 1, 1)
    signed = F.concat(sign, F.lpad(F.substring(value, 2, width), width - 1, "0"))
    return (
        F.when(F.length(value) >= width, value)
        .when(sign.isin("+", "-"), signed)
        .otherwise(F.lpad(value, width, "0"))
    )


def item6(value: Column) -> Column:
    """Join form of an item number: six characters, padded or cut; null stays null."""
    return F.lpad(value.cast("string"), ITEM_WIDTH, "0")


def loaded_item(value: Column) -> Column:
    """Load form: missing or blank becomes empty, digits are padded, other text is kept."""
    text = strip(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(text.rlike("^[0-9]+$"), zero_fill(text, ITEM_WIDTH)).otherwise(text)


def loaded_item_key(document: Column, item: Column) -> Column:
    return F.concat(F.coalesce(document.cast("string"), F.lit("")), F.lit("_"), loaded_item(item))


def coverage_key(value: Column) -> Column:
    """Coverage form: a missing key counts as the text ``None``; digits are padded to ten."""
    text = plain_key(value)
    return F.when(text.rlike("^[0-9]+$"), zero_fill(text, COVERAGE_WIDTH)).otherwise(text)


def plain_key(value: Column) -> Column:
    return strip(F.coalesce(value.cast("string"), F.lit("None")))


def spelled(value: Column) -> Column:
    """Text form in which a missing value reads ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def trace_item(value: Column) -> Column:
    return zero_fill(spelled(value), ITEM_WIDTH)


def present(value: Column) -> Column:
    """True for a value that is neither missing nor empty text."""
    return value.isNotNull() & (value != "")
