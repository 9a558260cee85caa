"""Canonical JSON: nested values with their keys in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_keys(value: Column, kind: T.DataType) -> Column:
    """value with the fields of every structure and the keys of every map in order, however deep; nulls stay null."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = F.struct(*[sorted_keys(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), sorted_keys(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def canonical_json(table: DataFrame, column: str) -> Column:
    """The compact JSON text of a column of table, with sorted keys and explicit nulls."""
    return F.to_json(sorted_keys(F.col(column), table.schema[column].dataType), {"ignoreNullFields": "false"})
