"""Filter documents compiled to predicates.

Predicates are two-valued: a missing field makes a comparison false, and its negation true. In positive places the plain
comparison is emitted, so that it reaches the Parquet scan; only under a negation NULL is made false first. Values of
different type classes are never equal, nor ordered. An unknown operator is an error; a document without operators is
compared as a whole. ``$nin`` negates ``$in``; ``$in`` takes an array's elements as well as the whole array; the other
comparisons don't look into arrays.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError
from vellum.functions import geo, text
from vellum.functions.paths import Scope, check_name, family, family_of_value, literal


def _true() -> Column:
    return F.lit(True)


def _false() -> Column:
    return F.lit(False)


def _not(p: Column) -> Column:
    return ~F.coalesce(p, _false())


def compile_filter(spec: dict, scope: Scope) -> Column:
    """The predicate of a filter document over a scope's fields."""
    if not isinstance(spec, dict):
        raise SpecError(f"a filter is a document, not {spec!r}")
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, (list, tuple)) or not value:
                raise SpecError(f"{key} needs a list of filters")
            each = [compile_filter(v, scope) for v in value]
            p = reduce(lambda a, b: a & b, each) if key == "$and" else reduce(lambda a, b: a | b, each)
            parts.append(_not(p) if key == "$nor" else p)
        elif key == "$not":
            parts.append(_not(compile_filter(value, scope)))
        elif key == "$text":
            parts.append(_text(value, scope))
        elif key == "$expr":
            from vellum.functions.exprs import compile_expr, truthy

            parts.append(truthy(compile_expr(value, scope)))
        elif key == "$comment":
            continue
        elif key.startswith("$"):
            raise SpecError(f"unknown operator {key}")
        else:
            parts.append(field_predicate(value, *scope.get(check_name(key))))
    return reduce(lambda a, b: a & b, parts) if parts else _true()


def is_operators(cond: Any) -> bool:
    if not isinstance(cond, dict) or not cond:
        return False
    marks = [k.startswith("$") for k in cond]
    if any(marks) and not all(marks):
        raise SpecError(f"operators and fields are mixed: {cond!r}")
    return marks[0]


def field_predicate(cond: Any, col: Column, kind: T.DataType | None) -> Column:
    """The predicate of a field's condition."""
    if not is_operators(cond):
        return _eq(col, kind, cond)
    parts = []
    for op, x in cond.items():
        if op == "$options":
            if "$regex" not in cond:
                raise SpecError("$options without $regex")
            continue
        f = OPERATORS.get(op)
        if f is None:
            raise SpecError(f"unknown operator {op}")
        parts.append(f(col, kind, x, cond))
    return reduce(lambda a, b: a & b, parts)


def _eq(col: Column, kind: T.DataType | None, x: Any, _: Any = None) -> Column:
    if x is None:
        return col.isNull()
    if family(kind) != family_of_value(x):
        return _false()
    if isinstance(x, dict):
        if list(x) != list(kind.names):
            return _false()
        return reduce(lambda a, b: a & b, (_eq(col.getField(k), kind[k].dataType, v) for k, v in x.items()), col.isNotNull())
    if isinstance(x, (list, tuple)):
        if any(v is not None and family_of_value(v) != family(kind.elementType) for v in x):
            return _false()
        return col == (literal(x).cast(kind) if x else F.array().cast(kind))
    return col == F.lit(x)


def _ne(col: Column, kind: T.DataType | None, x: Any, _: Any = None) -> Column:
    if x is None:
        return col.isNotNull()
    if family(kind) != family_of_value(x):
        return _true()
    return _not(_eq(col, kind, x)) if isinstance(x, (dict, list, tuple)) else ~col.eqNullSafe(F.lit(x))


def _range(compare):
    def f(col: Column, kind: T.DataType | None, x: Any, _: Any) -> Column:
        if x is None or family(kind) != family_of_value(x):
            return _false()
        return compare(col, literal(x).cast(kind) if isinstance(x, (list, tuple, dict)) else F.lit(x))

    return f


def _in(col: Column, kind: T.DataType | None, xs: Any, _: Any = None) -> Column:
    if not isinstance(xs, (list, tuple)):
        raise SpecError("$in and $nin need a list")
    parts = [col.isNull()] if any(x is None for x in xs) else []
    xs = [x for x in xs if x is not None]
    if isinstance(kind, T.ArrayType):
        inner = [x for x in xs if family_of_value(x) == family(kind.elementType)]
        if inner:
            parts.append(F.arrays_overlap(col, literal(inner).cast(T.ArrayType(kind.elementType))))
        parts += [_eq(col, kind, x) for x in xs if isinstance(x, (list, tuple))]
    else:
        same = [x for x in xs if family_of_value(x) == family(kind)]
        if same and isinstance(kind, T.StructType):
            parts += [_eq(col, kind, x) for x in same]
        elif same:
            parts.append(col.isin(*same))
    return reduce(lambda a, b: a | b, parts) if parts else _false()


def _exists(col: Column, kind: T.DataType | None, x: Any, _: Any) -> Column:
    return col.isNotNull() if x else col.isNull()


_ALIASES = {
    "double": (T.DoubleType, T.FloatType), "string": (T.StringType,), "object": (T.StructType,), "array": (T.ArrayType,),
    "binData": (T.BinaryType,), "bool": (T.BooleanType,), "date": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "int": (T.IntegerType, T.ShortType, T.ByteType), "long": (T.LongType,), "decimal": (T.DecimalType,),
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "objectId": (), "regex": (), "timestamp": (), "minKey": (), "maxKey": (), "null": (T.NullType,),
}
_CODES = {1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 7: "objectId", 8: "bool", 9: "date", 10: "null", 11: "regex", 16: "int", 17: "timestamp", 18: "long", 19: "decimal", -1: "minKey", 127: "maxKey"}


def _type(col: Column, kind: T.DataType | None, x: Any, _: Any) -> Column:
    names = x if isinstance(x, (list, tuple)) else [x]
    names = [_CODES.get(n, n) if isinstance(n, (int, float)) and not isinstance(n, bool) else n for n in names]
    for n in names:
        if n not in _ALIASES:
            raise SpecError(f"unknown type {n!r}")
    return col.isNotNull() if any(isinstance(kind, _ALIASES[n]) for n in names if _ALIASES[n]) else _false()


def _regex(col: Column, kind: T.DataType | None, x: Any, cond: dict) -> Column:
    options = cond.get("$options", "")
    if isinstance(x, re.Pattern):
        x = x.pattern
    if not isinstance(x, str) or set(options) - set("ims"):
        raise SpecError("$regex needs a pattern, $options some of i, m, s")
    if not isinstance(kind, T.StringType):
        return _false()
    try:
        re.compile(x)
    except re.error:
        return _false()
    return col.rlike((f"(?{options})" if options else "") + x)


def _mod(col: Column, kind: T.DataType | None, x: Any, _: Any) -> Column:
    if not isinstance(x, (list, tuple)) or len(x) != 2 or family_of_value(x[0]) != "number" or family_of_value(x[1]) != "number":
        raise SpecError("$mod needs [divisor, remainder]")
    d, r = int(x[0]), int(x[1])
    if d == 0:
        raise SpecError("$mod by zero")
    if family(kind) != "number":
        return col.isNotNull() if r == 0 else _false()
    return col.try_cast("long") % F.lit(d) == F.lit(r)


def _size(col: Column, kind: T.DataType | None, x: Any, _: Any) -> Column:
    if not isinstance(x, int) or isinstance(x, bool):
        raise SpecError("$size needs an integer")
    return (F.size(col) == x) & col.isNotNull() if isinstance(kind, T.ArrayType) else _false()


def _all(col: Column, kind: T.DataType | None, xs: Any, _: Any) -> Column:
    if not isinstance(xs, (list, tuple)):
        raise SpecError("$all needs a list")
    if not isinstance(kind, T.ArrayType):
        return _false()
    parts = [col.isNotNull()]
    for x in xs:
        if x is None:
            parts.append(F.exists(col, lambda e: e.isNull()))
        elif family_of_value(x) != family(kind.elementType):
            return _false()
        else:
            parts.append(F.array_contains(col, literal(x).cast(kind.elementType)))
    return reduce(lambda a, b: a & b, parts)


def _elem_match(col: Column, kind: T.DataType | None, x: Any, _: Any) -> Column:
    if not isinstance(x, dict):
        raise SpecError("$elemMatch needs a filter")
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        return _false()
    return F.exists(col, lambda e: F.coalesce(compile_filter(x, Scope(kind.elementType, e)), _false()))


def _near(col: Column, kind: T.DataType | None, x: Any, _: Any) -> Column:
    return geo.near(col, kind, x)


def _within(col: Column, kind: T.DataType | None, x: Any, _: Any) -> Column:
    return geo.within_box(col, kind, x)


def _text(value: Any, scope: Scope) -> Column:
    query = text.parse_text_query(value)
    fields = [f.name for f in scope.schema.fields if isinstance(f.dataType, T.StringType)]
    return text.match_all([scope.top(f)[0] for f in fields], query.search)


OPERATORS = {
    "$eq": _eq, "$ne": _ne,
    "$gt": _range(lambda a, b: a > b), "$gte": _range(lambda a, b: a >= b), "$lt": _range(lambda a, b: a < b), "$lte": _range(lambda a, b: a <= b),
    "$in": _in, "$nin": lambda c, k, x, s: _not(_in(c, k, x)), "$not": lambda c, k, x, s: _not(field_predicate(x, c, k)),
    "$exists": _exists, "$type": _type, "$regex": _regex, "$mod": _mod, "$size": _size, "$all": _all, "$elemMatch": _elem_match,
    "$near": _near, "$nearSphere": _near, "$geoWithin": _within, "$geoIntersects": _within,
}
