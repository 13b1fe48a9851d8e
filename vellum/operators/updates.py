"""Update documents compiled to column expressions: rows in, rows out.

Operators apply in the order written, to rows where ``hit`` holds. A number keeps its column's type: ``$inc`` and ``$mul``
truncate their operand to it. A document without operators replaces the row but for its key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError
from vellum.functions.filters import compile_filter, field_predicate, is_operators
from vellum.functions.paths import NUMERIC, Scope, check_name, family, family_of_value, literal, quoted, with_path, without_path

_HIT = "__hit"


def _typed(value: Any, kind: T.DataType | None) -> Column:
    """A value as a column, of a column's type where they agree."""
    col = literal(value)
    if kind is None or value is None:
        return col if kind is None else F.lit(None).cast(kind)
    if family_of_value(value) != family(kind):
        raise SpecError(f"can't put {value!r} into a column of type {kind.simpleString()}")
    if isinstance(value, float) and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and value != int(value):
        raise SpecError(f"can't put {value!r} into a column of type {kind.simpleString()}")
    return col.cast(kind)


def _set(df: DataFrame, path: str, value: Any) -> DataFrame:
    kind = Scope.of(df).get(path)[1]
    return with_path(df, path, _typed(value, kind), F.col(_HIT))


def _unset(df: DataFrame, path: str, value: Any) -> DataFrame:
    return without_path(df, path, F.col(_HIT))


def _arithmetic(join: Callable[[Column, Column], Column], missing: Callable[[Any], Any]):
    def f(df: DataFrame, path: str, x: Any) -> DataFrame:
        if family_of_value(x) != "number":
            raise SpecError(f"no number: {x!r}")
        col, kind = Scope.of(df).get(path)
        if kind is None:
            return with_path(df, path, F.lit(missing(x)), F.col(_HIT))
        if not isinstance(kind, NUMERIC):
            return with_path(df, path, F.coalesce(col, F.lit(None).cast(kind)), F.col(_HIT)) if family(kind) != "number" else df
        operand = F.lit(int(x) if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else x).cast(kind)
        start = F.lit(int(missing(x)) if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else missing(x)).cast(kind)
        return with_path(df, path, F.coalesce(join(col, operand).cast(kind), start), F.col(_HIT))

    return f


def _extreme(pick: Callable[..., Column]):
    def f(df: DataFrame, path: str, x: Any) -> DataFrame:
        col, kind = Scope.of(df).get(path)
        value = _typed(x, kind)
        return with_path(df, path, value if kind is None else pick(col, value), F.col(_HIT))

    return f


def _rename(df: DataFrame, path: str, new: Any) -> DataFrame:
    col, kind = Scope.of(df).get(path)
    if kind is None:
        return df
    there = Scope.of(df).get(check_name(new))[1]
    moved = with_path(df.withColumn("__moved", col), new, F.coalesce(F.col("__moved"), Scope.of(df).get(new)[0]) if there is not None else F.col("__moved"), F.col(_HIT))
    return without_path(moved, path, F.col(_HIT)).drop("__moved")


def _array(df: DataFrame, path: str, item: Any) -> tuple[Column, T.ArrayType]:
    """(the array there, empty where it is missing, its type)."""
    col, kind = Scope.of(df).get(path)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(col, F.array().cast(kind)), kind
    if kind is not None and not isinstance(kind, T.NullType):
        raise SpecError(f"{path} is no array")
    made = T.ArrayType(df.sparkSession.range(1).select(literal(item).alias("x")).schema["x"].dataType)
    return F.array().cast(made), made


def _items(value: Any) -> tuple[list, dict]:
    if isinstance(value, dict) and "$each" in value:
        if set(value) - {"$each", "$slice"} or not isinstance(value["$each"], (list, tuple)):
            raise SpecError(f"$each takes a list, beside it only $slice: {value!r}")
        return list(value["$each"]), value
    return [value], {}


def _push(df: DataFrame, path: str, value: Any) -> DataFrame:
    items, options = _items(value)
    if not items and Scope.of(df).get(path)[1] is None:
        return df
    array, kind = _array(df, path, items[0] if items else None)
    out = F.concat(array, literal(items).cast(kind)) if items else array
    if (n := options.get("$slice")) is not None:
        out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n + 1, F.lit(1)), F.lit(-n))
    return with_path(df, path, out, F.col(_HIT))


def _pop(df: DataFrame, path: str, way: Any) -> DataFrame:
    col, kind = Scope.of(df).get(path)
    if not isinstance(kind, T.ArrayType):
        return df
    rest = F.greatest(F.size(col) - 1, F.lit(0))
    out = F.slice(col, F.lit(1), rest) if way == 1 else F.slice(col, F.lit(2), rest)
    return with_path(df, path, F.when(F.size(col) > 0, out).otherwise(col), F.col(_HIT))


def _add_to_set(df: DataFrame, path: str, value: Any) -> DataFrame:
    items, _ = _items(value)
    if not items:
        return df
    array, kind = _array(df, path, items[0])
    return with_path(df, path, F.concat(array, F.array_except(literal(items).cast(kind), array)), F.col(_HIT))


def _pull(df: DataFrame, path: str, cond: Any) -> DataFrame:
    col, kind = Scope.of(df).get(path)
    if not isinstance(kind, T.ArrayType):
        return df
    item = kind.elementType

    def drop(x: Column) -> Column:
        if isinstance(cond, dict) and not is_operators(cond) and isinstance(item, T.StructType):
            p = compile_filter(cond, Scope(item, x))
        else:
            p = field_predicate(cond, x, item)
        return ~F.coalesce(p, F.lit(False))

    return with_path(df, path, F.filter(col, drop), F.col(_HIT))


def _current_date(now: Column):
    def f(df: DataFrame, path: str, spec: Any) -> DataFrame:
        kind = Scope.of(df).get(path)[1]
        return with_path(df, path, now if kind is None else now.cast(kind), F.col(_HIT))

    return f


OPERATORS: dict[str, Callable[[DataFrame, str, Any], DataFrame]] = {
    "$set": _set, "$unset": _unset, "$inc": _arithmetic(lambda a, b: a + b, lambda x: x), "$mul": _arithmetic(lambda a, b: a * b, lambda x: 0),
    "$min": _extreme(F.least), "$max": _extreme(F.greatest), "$rename": _rename, "$push": _push, "$pop": _pop, "$addToSet": _add_to_set, "$pull": _pull,
}


def apply_update(df: DataFrame, update: dict, hit: Column, insert: bool = False, key: str = "_id", now: dt.datetime | None = None) -> DataFrame:
    """``df`` with the update applied to the rows where ``hit`` holds; columns keep their order, new ones come last."""
    if not isinstance(update, dict) or not update:
        raise SpecError("an update is a document")
    clock = F.current_timestamp() if now is None else F.lit(now)
    # The predicate sees the rows as they came in, however the operators change them.
    out = df.withColumn(_HIT, F.coalesce(hit, F.lit(False)))
    if not is_operators(update):
        for name in df.columns:
            if name != key and name not in update:
                out = out.withColumn(name, F.when(~F.col(_HIT), F.col(quoted(name))))
        for name, value in update.items():
            if name != key:
                out = _set(out, check_name(name), value)
        return out.drop(_HIT)
    for op, fields in update.items():
        if op == "$setOnInsert":
            if not insert:
                continue
            f = _set
        elif op == "$currentDate":
            f = _current_date(clock)
        else:
            f = OPERATORS.get(op)
        if f is None or not isinstance(fields, dict):
            raise SpecError(f"unknown update {op}")
        for path, value in fields.items():
            if path.split(".")[0] == key:
                raise SpecError(f"{key} can't be changed")
            out = f(out, check_name(path), value)
    return out.drop(_HIT)


def _first(df: DataFrame, hit: Column, key: str, sort: dict | None = None) -> Column:
    """``hit``, but only for the first row in key order (or in ``sort``, then key order)."""
    from vellum.operators.stages import sort_columns

    order = [*(sort_columns(df, sort) if sort else []), F.col(quoted(key))]
    chosen = df.filter(hit).orderBy(*order).limit(1).select(F.col(quoted(key)).alias("__first"))
    return hit & F.col(quoted(key)).eqNullSafe(chosen.scalar())


def update(df: DataFrame, filter: dict, change: dict, multi: bool = False, upsert: bool = False, key: str = "_id", key_value: Any = None, now: dt.datetime | None = None) -> DataFrame:
    """The whole collection after the update; one row only, the first by key, unless ``multi``."""
    hit = F.coalesce(compile_filter(filter, Scope.of(df)), F.lit(False))
    out = apply_update(df, change, hit if multi else _first(df, hit, key), key=key, now=now)
    return out.unionByName(_inserted(df, filter, change, hit, key, key_value, now), allowMissingColumns=True) if upsert else out


def changed(df: DataFrame, filter: dict, change: dict, multi: bool = False, key: str = "_id", now: dt.datetime | None = None) -> DataFrame:
    """The rows, as they are after the update, that it makes different; only rows that the filter hits are looked at."""
    hit = F.coalesce(compile_filter(filter, Scope.of(df)), F.lit(False))
    rows = df.filter(hit if multi else F.coalesce(_first(df, hit, key), F.lit(False)))
    out = apply_update(rows.withColumn("__was", F.to_json(F.struct(*(F.col(quoted(c)) for c in df.columns)))), change, F.lit(True), key=key, now=now)
    if "__was" not in out.columns:
        raise SpecError("__was is no field name")
    names = [c for c in out.columns if c != "__was"]
    is_ = F.to_json(F.struct(*(F.col(quoted(c)) for c in names)))
    return out.filter(~F.col("__was").eqNullSafe(is_)).select(*(F.col(quoted(c)) for c in names))


def upserted(df: DataFrame, filter: dict, change: dict, key: str = "_id", key_value: Any = None, now: dt.datetime | None = None) -> DataFrame:
    """The row that an upsert adds, if any."""
    hit = F.coalesce(compile_filter(filter, Scope.of(df)), F.lit(False))
    return _inserted(df, filter, change, hit, key, key_value, now)


def deleted(df: DataFrame, filter: dict, multi: bool = True, key: str = "_id") -> DataFrame:
    """The rows that a delete takes away."""
    hit = F.coalesce(compile_filter(filter, Scope.of(df)), F.lit(False))
    return df.filter(hit if multi else F.coalesce(_first(df, hit, key), F.lit(False)))


def _inserted(df: DataFrame, filter: dict, change: dict, hit: Column, key: str, key_value: Any, now: dt.datetime | None) -> DataFrame:
    """The row that an upsert adds: none where the filter has a match."""
    spark = df.sparkSession
    fixed = {p: (v["$eq"] if isinstance(v, dict) and set(v) == {"$eq"} else v) for p, v in filter.items() if not p.startswith("$")}
    fixed = {p: v for p, v in fixed.items() if not isinstance(v, (dict, list, tuple))}
    kind = df.schema[key].dataType if key in df.columns else None
    value = fixed.pop(key, key_value)
    if value is None:
        value = F.uuid() if isinstance(kind, T.StringType) or kind is None else None
        if value is None:
            raise SpecError("an upsert into a collection whose key isn't a string needs the key's value")
    else:
        value = F.lit(value)
    typed = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != key]
    row = spark.range(1).select((value if kind is None else value.cast(kind)).alias(key), *typed)
    for p, v in fixed.items():
        row = with_path(row, p, _typed(v, Scope.of(row).get(p)[1]))
    row = apply_update(row, change, F.lit(True), insert=True, key=key, now=now)
    there = df.filter(hit).limit(1).select(F.lit(1).alias("__there"))
    return row.join(F.broadcast(there), F.lit(True), "left_anti")  # one row at most on either side


def delete(df: DataFrame, filter: dict, multi: bool = True, key: str = "_id") -> DataFrame:
    """The collection without the matching rows, or without the first of them."""
    hit = F.coalesce(compile_filter(filter, Scope.of(df)), F.lit(False))
    return df.filter(~(hit if multi else F.coalesce(_first(df, hit, key), F.lit(False))))


def find_and_modify(df: DataFrame, filter: dict, sort: dict | None = None, change: dict | None = None, remove: bool = False, new: bool = False, fields: dict | None = None, upsert: bool = False, key: str = "_id", key_value: Any = None, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(the collection afterwards, the row before or with ``new`` after the change, if any)."""
    from vellum.operators.projection import project

    if remove == (change is not None):
        raise SpecError("either an update or remove")
    hit = F.coalesce(compile_filter(filter, Scope.of(df)), F.lit(False))
    one = F.coalesce(_first(df, hit, key, sort), F.lit(False))
    before = df.filter(one)
    if remove:
        return df.filter(~one), (project(before, fields, key, False) if fields else before)
    after = apply_update(df, change, one, key=key, now=now)
    value = apply_update(before, change, F.lit(True), key=key, now=now) if new else before
    if upsert:
        made = _inserted(df, filter, change, hit, key, key_value, now)
        after = after.unionByName(made, allowMissingColumns=True)
        if new:
            value = value.unionByName(made, allowMissingColumns=True)
    return after, (project(value, fields, key, False) if fields else value)


def last_of_each(rows: DataFrame, key: str = "_id") -> DataFrame:
    """Of rows of equal keys the last, in the order of the rows' partitions; a partial aggregate, however often a key occurs."""
    numbered = rows.select(F.col(quoted(key)).alias("__key"), F.struct(*(F.col(quoted(c)) for c in rows.columns)).alias("__row"), F.monotonically_increasing_id().alias("__n"))
    return numbered.groupBy("__key").agg(F.max_by("__row", "__n").alias("__row")).select("__row.*")


def insert(df: DataFrame, rows: DataFrame, key: str = "_id") -> DataFrame:
    """The collection with the rows; a row whose key is there already takes its place, the last of equal new ones counts."""
    rows = last_of_each(rows, key)
    kept = df.join(rows.select(F.col(quoted(key)).alias("__key")), F.col(quoted(key)).eqNullSafe(F.col("__key")), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)
