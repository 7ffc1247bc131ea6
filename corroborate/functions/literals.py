"""Lookup tables as literals.

A table is parsed from one JSON literal, which the optimizer folds into a
constant: one call from Python however long the table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(entries: dict, value_type: str = "string") -> Column:
    return F.from_json(F.lit(json.dumps(entries)), f"map<string,{value_type}>")


def literal_rows(rows: list[dict], row_type: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{row_type}>>")


def literal_array(values: list) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")
