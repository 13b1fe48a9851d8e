"""Dotted paths as columns: reading, presence, nested set and unset.

In a typed table SQL NULL stands for a missing field; an explicit null can't be told from it. Paths go down structs;
a number after an array picks that element and ends the path.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Scope:
    """Where paths are looked up: a struct type, and the column it is of (None: a table's columns)."""

    schema: T.StructType
    root: Column | None = None

    @staticmethod
    def of(df: DataFrame) -> "Scope":
        return Scope(df.schema)

    def top(self, name: str) -> tuple[Column | None, T.DataType | None]:
        field = next((f for f in self.schema.fields if f.name == name), None)
        if field is None:
            return None, None
        return (F.col(quoted(name)) if self.root is None else self.root.getField(name)), field.dataType

    def get(self, path: str) -> tuple[Column, T.DataType | None]:
        """(column, type) of a path; a typeless NULL where the schema has no such field."""
        first, *rest = path.split(".")
        col, kind = self.top(first)
        for step in rest:
            if isinstance(kind, T.StructType) and step in kind.names:
                col, kind = col.getField(step), kind[step].dataType
            elif isinstance(kind, T.ArrayType) and step.isdigit():
                return F.get(col, F.lit(int(step))), kind.elementType
            else:
                return F.lit(None), None
        return (F.lit(None), None) if col is None else (col, kind)


def literal(value: Any) -> Column:
    """A column of a plain value; documents become structs, lists arrays."""
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items())) if value else F.struct()
    if isinstance(value, (list, tuple)):
        return F.array(*(literal(v) for v in value))
    return F.lit(value)


def family(kind: T.DataType | None) -> str:
    """The comparison class of a type; values of different classes are never equal."""
    if kind is None or isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, NUMERIC):
        return "number"
    if isinstance(kind, TEMPORAL):
        return "date"
    for cls, name in ((T.StringType, "string"), (T.BooleanType, "bool"), (T.BinaryType, "binary"), (T.ArrayType, "array"), (T.StructType, "object")):
        if isinstance(kind, cls):
            return name
    return kind.typeName()


def family_of_value(value: Any) -> str:
    import datetime as dt
    from decimal import Decimal

    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    for cls, name in (((int, float, Decimal), "number"), (str, "string"), ((bytes, bytearray), "binary"), ((dt.date, dt.datetime), "date"), ((list, tuple), "array"), (dict, "object")):
        if isinstance(value, cls):
            return name
    return type(value).__name__


def with_path(df: DataFrame, path: str, value: Column, hit: Column | None = None) -> DataFrame:
    """``df`` with a dotted path set to a value, where ``hit`` holds; parents are made where they are missing."""
    first, *rest = path.split(".")
    scope = Scope.of(df)
    old, kind = scope.top(first)
    new = _nested(old, kind, rest, value)
    if hit is not None:
        new = F.when(hit, new) if old is None else F.when(hit, new).otherwise(old)
    return df.withColumn(first, new)


def _nested(old: Column | None, kind: T.DataType | None, rest: list[str], value: Column) -> Column:
    if not rest:
        return value
    step, *deeper = rest
    if old is None or not isinstance(kind, T.StructType):
        # A scalar on the way is replaced by a document.
        return F.struct(_nested(None, None, deeper, value).alias(step))
    inner = kind[step].dataType if step in kind.names else None
    child = _nested(old.getField(step) if inner is not None else None, inner, deeper, value)
    names = [*kind.names, *([] if inner is not None else [step])]
    return F.struct(*((child if n == step else old.getField(n)).alias(n) for n in names))


def without_path(df: DataFrame, path: str, hit: Column | None = None) -> DataFrame:
    """``df`` with a path missing, where ``hit`` holds (everywhere: its field goes from the schema)."""
    first, *rest = path.split(".")
    old, kind = Scope.of(df).top(first)
    if old is None:
        return df
    if not rest:
        return df.drop(F.col(quoted(first))) if hit is None else df.withColumn(first, F.when(~hit, old))
    if Scope.of(df).get(path)[1] is None:
        return df
    if hit is None:
        return df.withColumn(first, F.when(old.isNotNull(), old.dropFields(".".join(quoted(r) for r in rest))))
    return with_path(df, path, F.lit(None).cast(Scope.of(df).get(path)[1]), hit & old.isNotNull())


def check_name(path: Any) -> str:
    if not isinstance(path, str) or not path or any(not p for p in path.split(".")):
        raise SpecError(f"no valid field path: {path!r}")
    return path
