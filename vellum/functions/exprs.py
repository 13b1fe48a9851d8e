"""Scalar expressions compiled to columns.

Arithmetic always gives doubles; in it NULL and what is no number count as 0, booleans as 0 and 1; division by zero is NULL.
``$concat`` skips NULLs. Expressions beyond those of the reference engine (comparisons, logic, date parts) are marked as
extensions in ``EXTENSIONS``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError
from vellum.functions.paths import NUMERIC, Scope, family, family_of_value, literal


@dataclass(frozen=True)
class Expr:
    """A column with what is known of its type (None: unknown or NULL)."""

    col: Column
    kind: T.DataType | None


def _type_of(value: Any) -> T.DataType | None:
    if isinstance(value, int) and not isinstance(value, bool):
        return T.IntegerType() if -(2**31) <= value < 2**31 else T.LongType()
    return {"bool": T.BooleanType(), "number": T.DoubleType(), "string": T.StringType(), "date": T.TimestampType(), "binary": T.BinaryType()}.get(family_of_value(value))


def number(e: Expr) -> Column:
    """A double; 0 for NULL and for what is no number."""
    if isinstance(e.kind, NUMERIC):
        return F.coalesce(e.col.cast("double"), F.lit(0.0))
    if isinstance(e.kind, T.BooleanType):
        return F.coalesce(e.col.cast("int").cast("double"), F.lit(0.0))
    return F.lit(0.0)


def truthy(e: Expr) -> Column:
    """False for NULL, false, 0 and the empty string."""
    if e.kind is None:
        return F.lit(False)
    if isinstance(e.kind, T.BooleanType):
        return F.coalesce(e.col, F.lit(False))
    if isinstance(e.kind, NUMERIC):
        return F.coalesce(e.col != 0, F.lit(False))
    if isinstance(e.kind, T.StringType):
        return F.coalesce(e.col != "", F.lit(False))
    return e.col.isNotNull()


def printed(e: Expr) -> Column:
    """As ``$concat`` prints it: whole doubles without a fraction, others in plain decimals, NULL and others as nothing."""
    if isinstance(e.kind, T.StringType):
        return e.col
    if isinstance(e.kind, (T.DoubleType, T.FloatType)):
        whole = (e.col == F.floor(e.col)) & (F.abs(e.col) < 9e15)
        plain = F.regexp_replace(e.col.cast("decimal(30,6)").cast("string"), "0+$", "")
        return F.when(whole, e.col.cast("long").cast("string")).otherwise(plain)
    if isinstance(e.kind, (*NUMERIC, T.BooleanType)):
        return e.col.cast("string")
    return F.lit(None).cast("string")


def compile_expr(spec: Any, scope: Scope) -> Expr:
    if isinstance(spec, str) and spec.startswith("$") and len(spec) > 1:
        return Expr(*scope.get(spec[1:]))
    if isinstance(spec, dict) and len(spec) == 1 and next(iter(spec)).startswith("$"):
        op, arg = next(iter(spec.items()))
        if op == "$literal":
            return Expr(literal(arg), _type_of(arg))
        f = OPERATORS.get(op) or EXTENSIONS.get(op)
        if f is None:
            raise SpecError(f"unknown expression {op}")
        return f(arg, scope)
    if isinstance(spec, dict):
        if any(k.startswith("$") for k in spec):
            raise SpecError(f"an expression has one operator: {spec!r}")
        parts = {k: compile_expr(v, scope) for k, v in spec.items()}
        kind = T.StructType([T.StructField(k, e.kind or T.NullType()) for k, e in parts.items()])
        return Expr(F.struct(*(e.col.alias(k) for k, e in parts.items())), kind)
    return Expr(literal(spec), _type_of(spec))


def _args(arg: Any, scope: Scope, least: int = 0, most: int | None = None) -> list[Expr]:
    each = arg if isinstance(arg, (list, tuple)) else [arg]
    if len(each) < least or most is not None and len(each) > most:
        raise SpecError(f"wrong number of arguments: {arg!r}")
    return [compile_expr(x, scope) for x in each]


def _fold(join, empty: float):
    def f(arg: Any, scope: Scope) -> Expr:
        return Expr(reduce(join, (number(e) for e in _args(arg, scope)), F.lit(empty)), T.DoubleType())

    return f


def _subtract(arg: Any, scope: Scope) -> Expr:
    if not isinstance(arg, (list, tuple)) or len(arg) < 2:
        return Expr(F.lit(0), T.IntegerType())
    a, b = _args(arg[:2], scope)
    return Expr(number(a) - number(b), T.DoubleType())


def _divide(arg: Any, scope: Scope) -> Expr:
    a, b = _args(arg, scope, 2, 2)
    return Expr(F.try_divide(number(a), number(b)), T.DoubleType())


def _concat(arg: Any, scope: Scope) -> Expr:
    return Expr(F.concat_ws("", *(printed(e) for e in _args(arg, scope))), T.StringType())


def _case(f):
    def g(arg: Any, scope: Scope) -> Expr:
        (e,) = _args(arg, scope, 1, 1)
        return Expr(f(e.col) if isinstance(e.kind, T.StringType) else F.lit(None).cast("string"), T.StringType())

    return g


def _substr(arg: Any, scope: Scope) -> Expr:
    s, start, size = _args(arg, scope, 3, 3)
    if not isinstance(s.kind, T.StringType):
        return Expr(F.lit(""), T.StringType())
    begin = F.greatest(number(start).cast("int"), F.lit(0))
    n = number(size).cast("int")
    # A negative length reads to the end.
    cut = F.substring(s.col, begin + 1, F.when(n < 0, F.length(s.col)).otherwise(n))
    return Expr(F.coalesce(cut, F.lit("")), T.StringType())


def _join_kinds(a: Expr, b: Expr) -> T.DataType | None:
    if a.kind is None or a.kind == b.kind:
        return b.kind
    if b.kind is None:
        return a.kind
    if family(a.kind) == family(b.kind) == "number":
        return T.DoubleType()
    raise SpecError(f"branches of different types: {a.kind.simpleString()} and {b.kind.simpleString()}")


def _cond(arg: Any, scope: Scope) -> Expr:
    if isinstance(arg, dict):
        arg = [arg.get("if"), arg.get("then"), arg.get("else")]
    test, then, other = _args(arg, scope, 3, 3)
    kind = _join_kinds(then, other)
    a, b = (e.col.cast(kind) if kind is not None and e.kind != kind else e.col for e in (then, other))
    return Expr(F.when(truthy(test), a).otherwise(b), kind)


def _if_null(arg: Any, scope: Scope) -> Expr:
    a, b = _args(arg, scope, 2, 2)
    kind = _join_kinds(a, b)
    x, y = (e.col.cast(kind) if kind is not None and e.kind != kind else e.col for e in (a, b))
    return Expr(F.coalesce(x, y), kind)


def _compare(op):
    def f(arg: Any, scope: Scope) -> Expr:
        a, b = _args(arg, scope, 2, 2)
        if a.kind is not None and b.kind is not None and family(a.kind) != family(b.kind):
            return Expr(F.lit(False), T.BooleanType())
        return Expr(F.coalesce(op(a.col, b.col), F.lit(False)), T.BooleanType())

    return f


def _logic(join, empty: bool):
    def f(arg: Any, scope: Scope) -> Expr:
        return Expr(reduce(join, (truthy(e) for e in _args(arg, scope)), F.lit(empty)), T.BooleanType())

    return f


def _date(part):
    def f(arg: Any, scope: Scope) -> Expr:
        (e,) = _args(arg, scope, 1, 1)
        return Expr(part(e.col) if family(e.kind) == "date" else F.lit(None).cast("int"), T.IntegerType())

    return f


OPERATORS = {
    "$add": _fold(lambda a, b: a + b, 0.0), "$multiply": _fold(lambda a, b: a * b, 1.0), "$subtract": _subtract, "$divide": _divide,
    "$concat": _concat, "$toLower": _case(F.lower), "$toUpper": _case(F.upper), "$substr": _substr, "$cond": _cond, "$ifNull": _if_null,
}
EXTENSIONS = {
    "$eq": _compare(lambda a, b: a.eqNullSafe(b)), "$ne": _compare(lambda a, b: ~a.eqNullSafe(b)), "$gt": _compare(lambda a, b: a > b),
    "$gte": _compare(lambda a, b: a >= b), "$lt": _compare(lambda a, b: a < b), "$lte": _compare(lambda a, b: a <= b),
    "$and": _logic(lambda a, b: a & b, True), "$or": _logic(lambda a, b: a | b, False),
    "$not": lambda arg, scope: Expr(~truthy(_args(arg, scope, 1, 1)[0]), T.BooleanType()),
    "$year": _date(F.year), "$month": _date(F.month), "$dayOfMonth": _date(F.dayofmonth), "$hour": _date(F.hour), "$minute": _date(F.minute), "$second": _date(F.second),
}


def register(op: str, f) -> None:
    """Adds an expression operator: f(argument, scope) -> Expr."""
    if not op.startswith("$") or op in OPERATORS:
        raise SpecError(f"can't register {op}")
    EXTENSIONS[op] = f
