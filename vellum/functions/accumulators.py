"""Accumulators of ``$group`` compiled to aggregates.

``$sum`` of an integer literal gives an int, else a double that skips what is no number; ``$avg`` is over numbers; ``$min``
and ``$max`` skip NULLs; ``$first``, ``$last`` and ``$push`` follow an explicit order (that of a ``$sort`` before, else the
collection's key), as rows of a cluster have none of their own; ``$addToSet`` gives a sorted array.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError
from vellum.functions.exprs import Expr, compile_expr, family
from vellum.functions.paths import Scope

#: (column, ascending) pairs.
Order = list[tuple[Column, bool]]


def _double(e: Expr) -> Column:
    """A number as double, NULL for anything else."""
    return e.col.cast("double") if family(e.kind) == "number" else F.lit(None).cast("double")


def _sum(arg: Any, e: Expr, order: Order) -> Column:
    if isinstance(arg, int) and not isinstance(arg, bool):
        return (F.count(F.lit(1)) * F.lit(arg)).cast("int")
    return F.coalesce(F.sum(_double(e)), F.lit(0.0))


def _one_way(order: Order) -> bool | None:
    ways = {up for _, up in order}
    return ways.pop() if len(ways) == 1 else None


def ordered(value: Column, order: Order) -> Column:
    """The values in order, as an array; NULLs are kept."""
    if not order:
        raise SpecError("$first, $last and $push need an order: a $sort before, or a collection with a key")
    ups = [up for _, up in order]
    rows = F.collect_list(F.struct(F.struct(*(c.alias(f"k{i}") for i, (c, _) in enumerate(order))).alias("k"), value.alias("v")))
    way = _one_way(order)
    if way is not None:
        return F.transform(F.sort_array(rows, asc=way), lambda r: r["v"])

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(len(ups))):
            x, y = a["k"][f"k{i}"], b["k"][f"k{i}"]
            less = F.coalesce(x < y, x.isNull() & y.isNotNull())
            more = F.coalesce(x > y, x.isNotNull() & y.isNull())
            lo, hi = (-1, 1) if ups[i] else (1, -1)
            out = F.when(less, F.lit(lo)).when(more, F.lit(hi)).otherwise(out)
        return out

    return F.transform(F.array_sort(rows, compare), lambda r: r["v"])


def _end(first: bool):
    def f(arg: Any, e: Expr, order: Order) -> Column:
        way = _one_way(order)
        if order and way is not None:
            by = F.struct(*(c for c, _ in order))
            # One pass with partial aggregation; the struct keeps a NULL value apart from no value.
            pick = F.min_by if first == way else F.max_by
            return pick(F.struct(e.col.alias("v")), by)["v"]
        return F.element_at(ordered(e.col, order), 1 if first else -1)

    return f


def _push(arg: Any, e: Expr, order: Order) -> Column:
    return ordered(e.col, order)


ACCUMULATORS = {
    "$sum": _sum,
    "$avg": lambda arg, e, order: F.avg(_double(e)),
    "$min": lambda arg, e, order: F.min(e.col),
    "$max": lambda arg, e, order: F.max(e.col),
    "$count": lambda arg, e, order: F.count(F.lit(1)).cast("int"),
    "$first": _end(True),
    "$last": _end(False),
    "$push": _push,
    "$addToSet": lambda arg, e, order: F.array_sort(F.collect_set(e.col)),
}


def compile_accumulator(spec: Any, scope: Scope, order: Order) -> Column:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise SpecError(f"an accumulator is one operator: {spec!r}")
    op, arg = next(iter(spec.items()))
    f = ACCUMULATORS.get(op)
    if f is None:
        raise SpecError(f"unknown accumulator {op}")
    e = Expr(F.lit(1), T.IntegerType()) if op == "$count" else compile_expr(arg, scope)
    return f(arg, e, order)


def register(op: str, f) -> None:
    """Adds an accumulator: f(argument, expression, order) -> column."""
    if not op.startswith("$") or op in ACCUMULATORS:
        raise SpecError(f"can't register {op}")
    ACCUMULATORS[op] = f
