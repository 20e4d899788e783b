"""Column expressions over text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Tokens between white space, NBSP included; the one definition of a spoken token."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    # a text of as many bytes as characters has as many units, and most have
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int"))


def bare(token: Column) -> Column:
    """A token without what is not a letter or digit at its ends, in lower case."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def half_up(x: Column) -> Column:
    """Round, halves toward plus infinity."""
    return F.floor(x + 0.5)
