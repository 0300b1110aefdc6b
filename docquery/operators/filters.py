"""Metadata filters, compiled to one predicate that Catalyst pushes into the scan as far as it can."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, fold, q_lookup


@dataclass(frozen=True)
class NumericRange:
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None

    def on(self, c: Column) -> Column:
        tests = [op(c, bound) for bound, op in ((self.gt, Column.__gt__), (self.gte, Column.__ge__), (self.lt, Column.__lt__), (self.lte, Column.__le__)) if bound is not None]
        return reduce(Column.__and__, tests, c.isNotNull())


@dataclass(frozen=True)
class FilterSpec:
    """All of these must hold; fields are columns, or ``custom.a.b`` paths into a JSON column ``custom``."""

    equals: Mapping[str, Any] = field(default_factory=dict)
    any_of: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    contains: Mapping[str, str] = field(default_factory=dict)
    numeric_ranges: Mapping[str, NumericRange] = field(default_factory=dict)
    tags_any: Sequence[str] = ()
    tags_all: Sequence[str] = ()

    @property
    def is_empty(self) -> bool:
        return not (self.equals or self.any_of or self.contains or self.numeric_ranges or self.tags_any or self.tags_all)

    def predicate(self, schema: T.StructType) -> Column:
        tests: list[Column] = []
        for name, value in self.equals.items():
            c = resolve(name, schema)
            tests.append(c.isNull() if value is None else c == F.lit(value if _typed(name, schema) else str(value)))
        for name, values in self.any_of.items():
            tests.append(resolve(name, schema).isin([v if _typed(name, schema) else str(v) for v in values]) if values else F.lit(False))
        for name, needle in self.contains.items():
            tests.append(_contains(resolve(name, schema), needle, schema, name))
        tests += [bounds.on(resolve(name, schema) if _typed(name, schema) else resolve(name, schema).try_cast("double")) for name, bounds in self.numeric_ranges.items()]
        if self.tags_any:
            tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, self.tags_any))))
        if self.tags_all:
            tests.append(F.size(F.array_except(F.array(*map(F.lit, self.tags_all)), "tags")) == 0)
        return F.coalesce(reduce(Column.__and__, tests, F.lit(True)), F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        return df if self.is_empty else df.where(self.predicate(df.schema))


def _typed(name: str, schema: T.StructType) -> bool:
    return not name.startswith("custom.") and name in schema.names


def resolve(name: str, schema: T.StructType) -> Column:
    """A column, else a key of ``custom``; null if there's neither."""
    if _typed(name, schema):
        return F.col(name)
    if "custom" not in schema.names:
        return F.lit(None).cast("string")
    return F.get_json_object("custom", "$." + name.removeprefix("custom."))


def _contains(c: Column, needle: str, schema: T.StructType, name: str) -> Column:
    n = q_lookup(needle)
    if _typed(name, schema) and isinstance(schema[name].dataType, T.ArrayType):
        return F.exists(c, lambda x: collapse(fold(x.cast("string"))).contains(n))
    return collapse(fold(c.cast("string"))).contains(n)


def for_app(domain: str | None = None, source_types: Sequence[str] = ()) -> FilterSpec:
    """The filter that a user's choice of domain and source types stands for."""
    return FilterSpec(equals={"domain": domain} if domain else {}, any_of={"source_type": list(source_types)} if source_types else {})
