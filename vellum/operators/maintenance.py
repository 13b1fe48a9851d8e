"""Expiry, capped collections, statistics, index checks and layouts: what a collection's owner runs beside queries.

An index never changes results. What it buys in a document store, Parquet gives by layout: ``layout`` sorts within
partitions (min/max skipping) or buckets; a partial index is a filtered copy, a unique one a check, a wildcard one a table of
paths and values.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError
from vellum.functions.filters import compile_filter
from vellum.functions.paths import Scope, check_name, quoted


def expire(df: DataFrame, field: str, seconds: int, now: dt.datetime) -> DataFrame:
    """The rows that aren't older than ``seconds`` at ``now``; a missing date and 0 seconds never expire."""
    col, kind = Scope.of(df).get(field)
    if seconds <= 0 or kind is None:
        return df
    # A comparison of the column itself, so that it reaches the scan.
    return df.filter(col.isNull() | (col >= F.lit(now - dt.timedelta(seconds=seconds)).cast(kind)))


def row_size(df: DataFrame) -> Column:
    """Bytes of a row's JSON text."""
    return F.octet_length(F.to_json(F.struct(*(F.col(quoted(c)) for c in df.columns))))


def capped(df: DataFrame, max_docs: int | None = None, max_size: int | None = None, key: str = "_id") -> DataFrame:
    """The newest rows by key, at most ``max_docs`` and of together at most ``max_size`` bytes."""
    out = df
    if max_docs:
        # A top-k by key: no window over all rows.
        out = out.orderBy(F.col(quoted(key)).desc()).limit(max_docs)
    if max_size:
        sized = out.withColumn("__size", row_size(df).cast("long"))
        ranges = sized.repartitionByRange(F.col(quoted(key)).desc()).withColumn("__part", F.spark_partition_id())
        # Running sums in two steps: totals of the key ranges first, then within a range, so that no task sees all rows.
        totals = ranges.groupBy("__part").agg(F.sum("__size").alias("__total"))
        before = totals.withColumn("__before", F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
        within = Window.partitionBy("__part").orderBy(F.col(quoted(key)).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = ranges.withColumn("__run", F.sum("__size").over(within)).join(F.broadcast(before), "__part")  # a row for each partition
        out = run.filter(F.col("__run") + F.col("__before") <= max_size).drop("__size", "__part", "__run", "__before")
    return out


def stats(df: DataFrame) -> DataFrame:
    """One row: count, size in bytes and average size, by whole division."""
    return df.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(row_size(df).cast("long")), F.lit(0)).alias("size")).withColumn("avg_obj_size", F.when(F.col("count") > 0, F.expr("size div count")).otherwise(F.lit(0)))


def index_stats(df: DataFrame, fields: list[str], exact: bool = True) -> DataFrame:
    """One row: entries, distinct keys and their ratio."""
    cols = [Scope.of(df).get(check_name(f))[0] for f in fields]
    unique = F.count_distinct(F.struct(*cols)) if exact else F.approx_count_distinct(F.struct(*cols))
    return df.agg(F.count(F.lit(1)).alias("entries"), unique.alias("distinct_keys")).withColumn("selectivity", F.try_divide(F.col("distinct_keys"), F.col("entries")))


def unique_violations(df: DataFrame, fields: list[str], sparse: bool = False, partial: dict | None = None) -> DataFrame:
    """Keys that more than one row has, with their number; ``sparse`` leaves rows without any of the fields out."""
    rows = df.filter(compile_filter(partial, Scope.of(df))) if partial else df
    cols = [Scope.of(rows).get(check_name(f))[0].alias(f.replace(".", "_")) for f in fields]
    keys = rows.select(*cols)
    if sparse:
        keys = keys.dropna(how="all")
    return keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def multikey(df: DataFrame, field: str, key: str = "_id") -> DataFrame:
    """(value, key): an index entry for each array element, or for the plain value."""
    col, kind = Scope.of(df).get(check_name(field))
    return df.select((F.explode(col) if isinstance(kind, T.ArrayType) else col).alias("value"), F.col(quoted(key)))


def wildcard(df: DataFrame, key: str = "_id") -> DataFrame:
    """(path, value, key): every present leaf of every row, array elements with their number in the path."""
    entries: list[Column] = []

    def walk(path: Column | str, col: Column, kind: T.DataType) -> Column:
        name = F.lit(path) if isinstance(path, str) else path
        if isinstance(kind, T.StructType):
            parts = [walk(F.concat(name, F.lit("." + f.name)), col.getField(f.name), f.dataType) for f in kind.fields]
            return F.flatten(F.array(*parts)) if parts else F.array().cast("array<struct<path:string,value:string>>")
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(col, lambda e, i: walk(F.concat(name, F.lit("."), i.cast("string")), e, kind.elementType))), F.array().cast("array<struct<path:string,value:string>>"))
        return F.filter(F.array(F.struct(name.alias("path"), col.cast("string").alias("value"))), lambda x: x["value"].isNotNull())

    for f in df.schema.fields:
        if f.name != key:
            entries.append(walk(f.name, F.col(quoted(f.name)), f.dataType))
    if not entries:
        raise SpecError("no fields but the key")
    rows = df.select(F.col(quoted(key)), F.explode(F.flatten(F.array(*entries))).alias("__e"))
    return rows.select(F.col("__e.path").alias("path"), F.col("__e.value").alias("value"), F.col(quoted(key)))


def hash_key(col: Column) -> Column:
    """The equality hash of a hashed index: a bucket key, not comparable with other systems'."""
    return F.xxhash64(col)


def split_points(df: DataFrame, field: str, parts: int) -> DataFrame:
    """One row: the array of values that cut a numeric field into ranges of about equal size."""
    if parts < 2:
        raise SpecError("at least 2 parts")
    return df.agg(F.percentile_approx(Scope.of(df).get(check_name(field))[0], [i / parts for i in range(1, parts)]).alias("points"))


def layout(df: DataFrame, fields: list[str], partitions: int | None = None, hashed: bool = False) -> DataFrame:
    """Rows arranged for skipping: ranges of (or hashed by) the fields, sorted within."""
    cols = [Scope.of(df).get(check_name(f))[0] for f in fields]
    args = [partitions, *cols] if partitions else cols
    return (df.repartition(*args) if hashed else df.repartitionByRange(*args)).sortWithinPartitions(*cols)
