"""Declared types: normalising, sizes, conversion of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions import lexicon as L
from corroborate.functions.literals import literal_map


def bare_type(declared: Column) -> Column:
    """Upper case without a size."""
    return F.trim(F.split_part(F.upper(declared), F.lit("("), F.lit(1)))


def normalize_type(declared: Column) -> Column:
    base = F.upper(F.trim(F.regexp_replace(declared, "\\([^)]*\\)", "")))
    return F.coalesce(F.try_element_at(literal_map(L.TYPE_ALIASES), base), base)


def declared_size(declared: Column) -> Column:
    """The number in ``(n)``; ``(p,s)`` has none."""
    digits = F.regexp_extract(declared, "\\((\\d+)\\)", 1)
    return F.when(digits != "", digits.cast("int"))


def family(declared: str) -> str:
    """Normalised type of one declaration, on the driver."""
    base = declared.split("(")[0].strip().upper()
    return L.TYPE_ALIASES.get(base, base)


def parse_int(c: Column) -> Column:
    """A whole number in text; anything else is NULL. Numbers are cut to whole."""
    text = c.cast("string")
    return F.when(F.regexp_like(text, F.lit("^\\s*[+-]?[0-9]+\\s*$")), F.trim(text).try_cast("bigint"))


def parse_double(c: Column) -> Column:
    text = c.cast("string")
    number = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"
    return F.when(F.regexp_like(text, F.lit(number)), F.trim(text).try_cast("double"))


def convert(c: Column, source: str, target: str) -> Column:
    """The value of ``c`` in the target type; a pair without expression is unchanged."""
    pair = (family(source), family(target))
    expressions = {
        ("INTEGER", "VARCHAR"): lambda: c.cast("string"),
        ("FLOAT", "VARCHAR"): lambda: c.cast("string"),
        ("VARCHAR", "INTEGER"): lambda: parse_int(c),
        ("VARCHAR", "FLOAT"): lambda: parse_double(c),
        ("VARCHAR", "DATE"): lambda: c.try_cast("date"),
        ("DATE", "VARCHAR"): lambda: c.cast("string"),
        ("DATETIME", "DATE"): lambda: c.try_cast("date"),
        ("INTEGER", "BOOLEAN"): lambda: F.coalesce(c != 0, F.lit(False)),
        ("BOOLEAN", "INTEGER"): lambda: F.when(c, 1).otherwise(0),
    }
    return expressions[pair]() if pair in expressions else c
