"""Heterogeneous fields: documents as VARIANT, with presence, explicit null, and an order across types.

``sort_key`` maps a value to a struct whose order is missing < null < numbers < strings < objects < arrays < ObjectIds <
booleans < dates, equal for equal numbers of any width; it can be compared, sorted by and grouped by, which VARIANT can't.
ObjectIds and dates are written in extended JSON ({"$oid": ...}, {"$date": ...}). Objects and arrays compare by their text.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.errors import SpecError

_RANKS = {"null": 0, "number": 1, "string": 2, "object": 3, "array": 4, "oid": 6, "bool": 7, "date": 8}


def parse(df: DataFrame, json: str, name: str = "doc") -> DataFrame:
    """A table of variants of a JSON column."""
    return df.withColumn(name, F.parse_json(json))


def _path(path: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))


def get(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, _path(path), "variant")


def present(doc: Column, path: str) -> Column:
    return get(doc, path).isNotNull()


def is_null(doc: Column, path: str) -> Column:
    """Whether an explicit null is there."""
    return F.coalesce(F.is_variant_null(get(doc, path)), F.lit(False))


def sort_key(v: Column) -> Column:
    """struct<rank int, num double, str string>; rank -1 for a missing value."""
    kind = F.schema_of_variant(v)
    text = v.cast("string")
    oid = F.try_variant_get(v, "$['$oid']", "string")
    date = F.try_variant_get(v, "$['$date']", "string")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    rank = (
        F.when(v.isNull(), -1)
        .when(F.is_variant_null(v), _RANKS["null"])
        .when(number, _RANKS["number"])
        .when(kind == "STRING", _RANKS["string"])
        .when(kind == "BOOLEAN", _RANKS["bool"])
        .when(oid.isNotNull(), _RANKS["oid"])
        .when(date.isNotNull(), _RANKS["date"])
        .when(F.startswith(kind, F.lit("ARRAY")), _RANKS["array"])
        .otherwise(_RANKS["object"])
    )
    num = F.when(number, F.try_variant_get(v, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double"))
    return F.struct(rank.cast("int").alias("rank"), num.alias("num"), F.when(number | (kind == "BOOLEAN") | F.is_variant_null(v), F.lit(None)).otherwise(F.coalesce(oid, date, text)).alias("str"))


def key_of(value: Any) -> Column:
    """The sort key of a plain value."""
    import json

    from vellum.sources.bson import plain

    return sort_key(F.parse_json(F.lit(json.dumps(plain(value)))))


def compare(doc: Column, path: str, op: str, value: Any) -> Column:
    """$eq, $ne, $gt, $gte, $lt, $lte across types, two-valued: missing equals null only."""
    k, x = sort_key(get(doc, path)), key_of(value)
    there = present(doc, path)
    if op == "$eq":
        return ~there | is_null(doc, path) if value is None else there & k.eqNullSafe(x)
    if op == "$ne":
        return there & ~is_null(doc, path) if value is None else ~(there & k.eqNullSafe(x))
    tests = {"$gt": lambda: k > x, "$gte": lambda: k >= x, "$lt": lambda: k < x, "$lte": lambda: k <= x}
    if op not in tests:
        raise SpecError(f"unknown operator {op}")
    return there & F.coalesce(tests[op](), F.lit(False))
