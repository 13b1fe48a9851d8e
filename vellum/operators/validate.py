"""Schema validation: a schema document compiled to a column with the first violation, NULL where a row is valid."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError
from vellum.functions.filters import _ALIASES
from vellum.functions.paths import Scope, family, family_of_value, literal

_KEYS = {"bsonType", "enum", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "items", "properties", "required", "description", "title"}


def _is_type(kind: T.DataType | None, name: Any) -> bool:
    names = name if isinstance(name, (list, tuple)) else [name]
    for n in names:
        if n not in _ALIASES:
            raise SpecError(f"unknown type {n!r}")
    return any(isinstance(kind, _ALIASES[n]) for n in names if _ALIASES[n])


def _checks(name: str, col: Column, kind: T.DataType, schema: dict) -> list[Column]:
    """For each keyword a column: its message where the present value breaks it, else NULL."""
    if set(schema) - _KEYS:
        raise SpecError(f"unknown keywords: {sorted(set(schema) - _KEYS)}")
    out: list[Column] = []

    def broken(test: Column, keyword: str) -> None:
        out.append(F.when(col.isNotNull() & test, F.lit(f"{keyword}: {name}")))

    if "bsonType" in schema and not _is_type(kind, schema["bsonType"]):
        broken(F.lit(True), "bsonType")
    if "enum" in schema:
        same = [v for v in schema["enum"] if family_of_value(v) == family(kind)]
        broken(~col.isin(*same) if same else F.lit(True), "enum")
    if isinstance(kind, T.StringType):
        size = F.octet_length(col)
        for key, test in (("minLength", lambda n: size < n), ("maxLength", lambda n: size > n)):
            if key in schema:
                broken(test(schema[key]), key)
        if "pattern" in schema:
            broken(~col.rlike(schema["pattern"]), "pattern")
    if family(kind) == "number":
        for key, test in (("minimum", lambda n: col < n), ("maximum", lambda n: col > n), ("exclusiveMinimum", lambda n: col <= n), ("exclusiveMaximum", lambda n: col >= n)):
            if key in schema:
                broken(test(literal(schema[key])), key)
    if isinstance(kind, T.ArrayType):
        for key, test in (("minItems", lambda n: F.size(col) < n), ("maxItems", lambda n: F.size(col) > n)):
            if key in schema:
                broken(test(schema[key]), key)
        if "items" in schema:
            broken(F.exists(col, lambda e: _first(_checks(f"{name}[]", e, kind.elementType, schema["items"])).isNotNull()), "items")
    if "properties" in schema and isinstance(kind, T.StructType):
        out += _properties(name + ".", Scope(kind, col), schema["properties"])
    return out


def _first(checks: list[Column]) -> Column:
    return F.coalesce(*checks, F.lit(None).cast("string"))


def _properties(prefix: str, scope: Scope, properties: dict) -> list[Column]:
    out = []
    for field, schema in properties.items():
        col, kind = scope.top(field)
        if col is not None:
            out += _checks(prefix + field, col, kind, schema)
    return out


def violation(scope: Scope, schema: dict) -> Column:
    """The first violation of the schema, as "keyword: field"."""
    schema = schema.get("$jsonSchema", schema)
    checks: list[Column] = []
    if "bsonType" in schema and schema["bsonType"] != "object":
        checks.append(F.lit("bsonType: document"))
    for name in schema.get("required", ()):
        col, _ = scope.top(name)
        checks.append(F.lit(f"required: {name}") if col is None else F.when(col.isNull(), F.lit(f"required: {name}")))
    return _first(checks + _properties("", scope, schema.get("properties", {})))


def violations(df: DataFrame, schema: dict) -> DataFrame:
    """The rows that break the schema, with the column ``violation``."""
    return df.withColumn("violation", violation(Scope.of(df), schema)).filter("violation is not null")


def valid(df: DataFrame, schema: dict, action: str = "error") -> DataFrame:
    """The rows that keep the schema; with the action ``warn`` all of them, with the column ``violation``."""
    marked = df.withColumn("violation", violation(Scope.of(df), schema))
    if action == "warn":
        return marked
    if action != "error":
        raise SpecError(f"the action is error or warn, not {action!r}")
    return marked.filter("violation is null").drop("violation")
