"""find, count and distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.filters import compile_filter
from vellum.functions.paths import Scope, check_name
from vellum.operators.projection import project
from vellum.operators.stages import sort_columns


def find(df: DataFrame, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0, key: str = "_id", missing: str = "first") -> DataFrame:
    """Filter, sort, skip, limit (0 and less: no limit), project, in this order."""
    out = df.filter(compile_filter(filter, Scope.of(df))) if filter else df
    if sort:
        cols = sort_columns(out, sort, missing)
        out = out.orderBy(*cols) if cols else out
    if skip > 0:
        out = out.offset(skip)
    if limit > 0:
        out = out.limit(limit)
    return project(out, projection, key, expressions=False) if projection else out


def count(df: DataFrame, filter: dict | None = None) -> DataFrame:
    """One row: n."""
    return find(df, filter).agg(F.count(F.lit(1)).cast("int").alias("n"))


def distinct(df: DataFrame, path: str, filter: dict | None = None) -> DataFrame:
    """The distinct values at a path, arrays flattened (with their NULL elements), missing ones left out; column ``value``."""
    rows = find(df, filter)
    col, kind = Scope.of(rows).get(check_name(path))
    if isinstance(kind, T.ArrayType):
        return rows.select(F.explode(col).alias("value")).distinct()
    return rows.select(col.alias("value")).filter("value is not null").distinct()
