"""Statements of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Column types and index names.
TYPES = ("INT", "FLOAT", "VARCHAR", "DATE", "ARRAY[FLOAT]")
INDEXES = {"SEQ": "SEQ", "BTREE": "BTree", "ISAM": "ISAM", "HASH": "Hash", "RTREE": "RTree", "BOW": "BOW"}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    size: int | None = None
    is_key: bool = False
    index: str | None = None


@dataclass(frozen=True)
class Compare:
    """column operator value; BETWEEN and list IN have a list, spatial IN has (point, radius)."""

    column: str
    operator: str
    value: Any

    @property
    def spatial(self) -> bool:
        return self.operator == "IN" and len(self.value) == 2 and isinstance(self.value[0], list)


@dataclass(frozen=True)
class Both:
    """left AND right, or left OR right; the two bind alike and from the left."""

    operator: str
    left: Any
    right: Any


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: list[Column]

    @property
    def key(self) -> Column | None:
        return next((c for c in self.columns if c.is_key), None)


@dataclass(frozen=True)
class CreateFromFile:
    table: str
    path: str
    index: str
    column: str


@dataclass(frozen=True)
class Select:
    table: str
    columns: list[str] = field(default_factory=list)  # empty: all
    where: Compare | Both | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    values: list[Any]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Compare | Both
