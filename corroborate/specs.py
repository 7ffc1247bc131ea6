"""What Spark tables do not carry themselves: keys, constraints, mappings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    column: str
    ref_table: str
    ref_column: str


@dataclass(frozen=True)
class TableSpec:
    """Constraints of one table. ``checks`` are SQL boolean expressions by name, ``defaults`` the declared ones by column."""

    name: str
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    declared_types: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.primary_key + self.not_null))


@dataclass(frozen=True)
class Mapping:
    """One field mapping. ``kind`` is ``1:1``, ``1:N`` (split) or ``N:1`` (merge)."""

    sources: tuple[str, ...]
    targets: tuple[str, ...]
    kind: str = "1:1"
    rule: str | Callable[[Column], Column] = "direct"
    default: object = None
    delimiter: str = " "
    template: str | None = None
    source_type: str | None = None
    target_type: str | None = None


@dataclass(frozen=True)
class TablePlan:
    """All mappings between one source table and one target table."""

    source_table: str
    target: TableSpec
    mappings: tuple[Mapping, ...]
    row_id: tuple[str, ...]


CHECK_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("check_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("recommendations", T.ArrayType(T.StringType())),
    ]
)

REJECT_COLUMNS = ["source_table", "record_id", "record_data", "error_message", "error_type"]
