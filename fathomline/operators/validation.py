"""Integrity checks: each gives rows of (rule, severity, table_name, row_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from fathomline.operators.evidence import childless, dangling


def _rows(df: DataFrame, rule: str, severity: str, table_name: str, row_id: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(table_name).alias("table_name"), F.col(row_id).cast("string").alias("row_id"))


def check_rows(df: DataFrame, bad: Column, rule: str, table_name: str, row_id: str, severity: str = "error") -> DataFrame:
    """Rows for which ``bad`` is true; an unknown (null) condition is no violation."""
    return _rows(df.where(F.coalesce(bad, F.lit(False))), rule, severity, table_name, row_id)


def check_reference(df: DataFrame, keys: list[str], parents: DataFrame, parent_keys: list[str], rule: str, table_name: str, row_id: str, severity: str = "error") -> DataFrame:
    """Rows whose reference names no parent."""
    return _rows(dangling(df.select(*{*keys, row_id}), keys, parents, parent_keys), rule, severity, table_name, row_id)


def check_children(df: DataFrame, key: str, children: DataFrame, child_key: str, rule: str, table_name: str, severity: str = "error") -> DataFrame:
    """Rows that no child refers to."""
    return _rows(childless(df.select(key), key, children, child_key), rule, severity, table_name, key)


def check_unique(tables: dict[str, tuple[DataFrame, str]], rule: str, severity: str = "error") -> DataFrame:
    """Identifiers that occur more than once over all tables, once each, under the first table name."""
    ids = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("table_name"), F.col(k).cast("string").alias("row_id")) for n, (df, k) in tables.items()])
    twice = ids.where("row_id IS NOT NULL").groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.min("table_name").alias("table_name")).where("n > 1")
    return _rows(twice, rule, severity, "", "row_id").drop("table_name").join(twice.select("row_id", "table_name"), "row_id").select("rule", "severity", "table_name", "row_id")


def all_violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def struct_paths(schema: StructType, fields: set[str], prefix: str = "") -> list[str]:
    """Dotted paths of all structs, at any depth outside arrays, that have all of ``fields``; arrays end with ``[]``."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, f"{prefix}{f.name}"
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            kind, path = kind.elementType, path + "[]"
        if isinstance(kind, StructType):
            if fields <= set(kind.names):
                out.append(path)
            out += struct_paths(kind, fields, path + ".")
    return out


def schema_drift(expected: StructType, actual: StructType) -> list[str]:
    """Differences of two schemas: missing, new and changed columns."""
    a, b = {f.name: f.dataType for f in expected.fields}, {f.name: f.dataType for f in actual.fields}
    return sorted([f"missing {n}" for n in a.keys() - b.keys()] + [f"new {n}" for n in b.keys() - a.keys()] + [f"changed {n}: {a[n].simpleString()} to {b[n].simpleString()}" for n in a.keys() & b.keys() if a[n] != b[n]])
