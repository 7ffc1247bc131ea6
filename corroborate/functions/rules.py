"""Per-column migration rules, splits and merges, compiled to columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corroborate.functions.text import strip
from corroborate.functions.types import convert, parse_double, parse_int
from corroborate.specs import Mapping


def apply_rule(c: Column, rule, default=None, dtype: T.DataType | None = None) -> Column:
    """One rule. A callable gets the column; an unknown name leaves it unchanged."""
    if callable(rule):
        return rule(c)
    if rule == "cast_int":
        return c.try_cast("bigint") if isinstance(dtype, T.NumericType) else parse_int(c)
    if rule == "cast_float":
        return c.try_cast("double") if isinstance(dtype, T.NumericType) else parse_double(c)
    if rule == "cast_str":
        return c.cast("string")
    if rule == "uppercase":
        return F.upper(c.cast("string"))
    if rule == "lowercase":
        return F.lower(c.cast("string"))
    if rule == "trim":
        return strip(c.cast("string"))
    if rule == "null_to_default":
        return F.coalesce(c, F.lit(default))
    return c


def split_value(c: Column, delimiter: str, parts: int) -> list[Column]:
    """The first ``parts`` pieces between delimiters; a missing piece is NULL."""
    pieces = F.split(c.cast("string"), f"\\Q{delimiter}\\E", -1)
    return [F.try_element_at(pieces, F.lit(i + 1)) for i in range(parts)]


def merge_values(columns: list[Column], template: str | None = None) -> Column:
    """Fill ``{0} {1}`` with the columns, else join them with blanks; NULL is empty."""
    values = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    if template is None:
        return F.concat_ws(" ", *values)
    parts = []
    for literal, index in re.findall(r"([^{}]*)(?:\{(\d+)\})?", template):
        if literal:
            parts.append(F.lit(literal))
        if index:
            parts.append(values[int(index)])
    return F.concat(*parts)


def compile_mapping(mapping: Mapping, schema: T.StructType) -> list[Column]:
    """Target columns of one mapping, named and converted."""
    sources = [F.col(s) for s in mapping.sources]
    if mapping.kind == "1:N":
        pieces = split_value(sources[0], mapping.delimiter, len(mapping.targets))
        return [p.alias(t) for p, t in zip(pieces, mapping.targets)]
    if mapping.kind == "N:1":
        return [merge_values(sources, mapping.template).alias(mapping.targets[0])]
    value = sources[0]
    if mapping.source_type and mapping.target_type:
        value = convert(value, mapping.source_type, mapping.target_type)
    value = apply_rule(value, mapping.rule, mapping.default, schema[mapping.sources[0]].dataType)
    return [value.alias(mapping.targets[0])]


def describe(mapping: Mapping) -> str:
    if mapping.kind != "1:1":
        return f"{'+'.join(mapping.sources)} → {'+'.join(mapping.targets)}: {'split' if mapping.kind == '1:N' else 'merge'}"
    rule = getattr(mapping.rule, "__name__", mapping.rule)
    return f"{mapping.sources[0]} → {mapping.targets[0]}: {rule}"
