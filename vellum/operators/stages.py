"""Pipeline stages: each a function of (rows, spec, context), folded from left to right into one plan for Catalyst.

``$lookup`` followed by ``$unwind`` of the looked-up field is compiled to a plain join, without arrays. A stage that isn't
known is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError
from vellum.functions.accumulators import Order, compile_accumulator
from vellum.functions.exprs import compile_expr
from vellum.functions.filters import compile_filter
from vellum.functions.paths import Scope, check_name, family, quoted
from vellum.operators import projection


@dataclass(frozen=True)
class Context:
    """What stages know besides the rows: other collections, the key, the order so far, and where missing values sort."""

    collection: Callable[[str], DataFrame] | None = None
    key: str = "_id"
    order: tuple[tuple[str, bool], ...] = ()
    missing: str = "first"
    oplog: Callable[[], DataFrame] | None = None
    variables: dict[str, Any] = field(default_factory=dict)

    def order_of(self, df: DataFrame) -> Order:
        scope = Scope.of(df)
        found = [(scope.get(p)[0], up) for p, up in self.order if scope.get(p)[1] is not None]
        if not found and self.key in df.columns:
            found = [(scope.get(self.key)[0], True)]
        return found


def match(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    return df.filter(compile_filter(spec, Scope.of(df))), ctx


def group(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise SpecError("$group needs an _id")
    scope = Scope.of(df)
    key = compile_expr(spec["_id"], scope).col if spec["_id"] is not None else F.lit(None).cast("string")
    order = ctx.order_of(df)
    made = [compile_accumulator(a, scope, order).alias(check_name(n)) for n, a in spec.items() if n != "_id"]
    # Without accumulators it is a distinct.
    grouped = df.groupBy(key.alias("_id"))
    out = grouped.agg(*made) if made else df.select(key.alias("_id")).distinct()
    return out, replace(ctx, order=(), key="_id")


def sort_columns(df: DataFrame, spec: dict, missing: str = "first") -> list[Column]:
    scope, out = Scope.of(df), []
    for path, way in spec.items():
        up = way is True or way == 1
        if not up and way != -1:
            raise SpecError(f"a sort direction is 1 or -1, not {way!r}")
        col, kind = scope.get(check_name(path))
        if kind is None:
            continue
        if missing == "first":
            out.append(col.asc_nulls_first() if up else col.desc_nulls_last())
        else:
            out.append(col.asc_nulls_last() if up else col.desc_nulls_first())
    return out


def sort(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    if not isinstance(spec, dict) or not spec:
        raise SpecError("$sort needs fields")
    cols = sort_columns(df, spec, ctx.missing)
    order = tuple((p, w is True or w == 1) for p, w in spec.items())
    return (df.orderBy(*cols) if cols else df), replace(ctx, order=order)


def _count(n: Any, least: int, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, float)) or n != int(n) or n < least:
        raise SpecError(f"{what} needs a whole number of at least {least}, not {n!r}")
    return int(n)


def limit(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    return df.limit(_count(spec, 1, "$limit")), ctx


def skip(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    return df.offset(_count(spec, 0, "$skip")), ctx


def count(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    return df.agg(F.count(F.lit(1)).cast("int").alias(check_name(spec))), replace(ctx, order=())


def project(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    return projection.project(df, spec, ctx.key), ctx


def add_fields(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    return projection.add_fields(df, spec), ctx


def _unwind_spec(spec: Any) -> tuple[str, bool]:
    path = spec.get("path") if isinstance(spec, dict) else spec
    if not isinstance(path, str) or not path.startswith("$"):
        raise SpecError("$unwind needs a path that begins with $")
    if isinstance(spec, dict) and set(spec) - {"path", "preserveNullAndEmptyArrays"}:
        raise SpecError(f"unknown options of $unwind: {spec!r}")
    return check_name(path[1:]), bool(isinstance(spec, dict) and spec.get("preserveNullAndEmptyArrays"))


def unwind(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    path, preserve = _unwind_spec(spec)
    col, kind = Scope.of(df).get(path)
    if not isinstance(kind, T.ArrayType):
        # No array: gone, or passed on as it is.
        return (df if preserve else df.filter(F.lit(False))), ctx
    if "." not in path:
        return df.withColumn(path, F.explode_outer(col) if preserve else F.explode(col)), ctx
    from vellum.functions.paths import with_path

    out = df.withColumn("__item", F.explode_outer(col) if preserve else F.explode(col))
    return with_path(out, path, F.col("__item")).drop("__item"), ctx


def _lookup_parts(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Column | None, Column | None, str]:
    if not isinstance(spec, dict) or set(spec) != {"from", "localField", "foreignField", "as"} or ctx.collection is None:
        raise SpecError("$lookup needs from, localField, foreignField and as")
    right = ctx.collection(spec["from"])
    a, ka = Scope.of(df).get(check_name(spec["localField"]))
    b, kb = Scope.of(right).get(check_name(spec["foreignField"]))
    if ka is None or kb is None:
        # A field that nowhere exists is missing in all rows, and missing equals missing.
        a = a if ka is not None else F.lit(None).cast(kb or T.StringType())
        b = b if kb is not None else F.lit(None).cast(ka or T.StringType())
    elif family(ka) != family(kb):
        return right, None, None, spec["as"]
    return right, a, b, spec["as"]


def lookup(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    """Each row with the array of all rows of another collection whose field equals its own; missing equals missing."""
    right, a, b, name = _lookup_parts(df, spec, ctx)
    empty = F.array().cast(T.ArrayType(right.schema))
    if a is None:
        return df.withColumn(name, empty), ctx
    found = right.groupBy(b.alias("__key")).agg(F.array_sort(F.collect_list(F.struct(*(F.col(quoted(c)) for c in right.columns)))).alias("__found"))
    left = df.withColumn("__local", a)
    out = left.join(found, F.col("__local").eqNullSafe(F.col("__key")), "left").drop("__local", "__key")
    out = out.withColumn("__found", F.coalesce("__found", empty))
    return out.drop(*([name] if name in df.columns else [])).withColumnRenamed("__found", name), ctx


def lookup_unwind(df: DataFrame, spec: Any, preserve: bool, ctx: Context) -> tuple[DataFrame, Context]:
    """``$lookup`` and ``$unwind`` of its field: an inner or left join, without an array in between."""
    right, a, b, name = _lookup_parts(df, spec, ctx)
    item = F.struct(*(F.col(quoted(c)) for c in right.columns))
    base = df.drop(name) if name in df.columns else df
    if a is None:
        out = base.withColumn(name, F.lit(None).cast(right.schema))
        return (out if preserve else out.filter(F.lit(False))), ctx
    side = right.select(b.alias("__key"), item.alias("__item"))
    left = df.withColumn("__local", a)
    out = left.join(side, F.col("__local").eqNullSafe(F.col("__key")), "left" if preserve else "inner").drop("__local", "__key")
    return out.drop(*([name] if name in df.columns else [])).withColumnRenamed("__item", name), ctx


def change_stream(df: DataFrame, spec: Any, ctx: Context) -> tuple[DataFrame, Context]:
    """The collection's change events so far instead of its rows."""
    from vellum.streaming import changes

    if ctx.oplog is None:
        raise SpecError("$changeStream needs a collection with an oplog")
    return changes.events(ctx.oplog(), **{k: v for k, v in (spec or {}).items() if k in ("resumeAfter", "startAtOperationTime")}), replace(ctx, order=(("_id", True),))


Stage = Callable[[DataFrame, Any, Context], tuple[DataFrame, Context]]
STAGES: dict[str, Stage] = {
    "$match": match, "$group": group, "$sort": sort, "$limit": limit, "$skip": skip, "$count": count, "$project": project,
    "$addFields": add_fields, "$set": add_fields, "$unwind": unwind, "$lookup": lookup, "$changeStream": change_stream,
}


def register(name: str, stage: Stage) -> None:
    """Adds a stage: f(rows, spec, context) -> (rows, context)."""
    if not name.startswith("$") or name in STAGES:
        raise SpecError(f"can't register {name}")
    STAGES[name] = stage


def aggregate(df: DataFrame, pipeline: list[dict], ctx: Context | None = None) -> DataFrame:
    """The rows after all stages."""
    ctx = ctx or Context()
    if not isinstance(pipeline, (list, tuple)):
        raise SpecError("a pipeline is a list of stages")
    i = 0
    while i < len(pipeline):
        stage = pipeline[i]
        if not isinstance(stage, dict) or len(stage) != 1:
            raise SpecError(f"a stage is one operator: {stage!r}")
        (name, spec), following = next(iter(stage.items())), pipeline[i + 1] if i + 1 < len(pipeline) else None
        if name == "$lookup" and isinstance(following, dict) and "$unwind" in following and isinstance(spec, dict):
            path, preserve = _unwind_spec(following["$unwind"])
            if path == spec.get("as"):
                df, ctx = lookup_unwind(df, spec, preserve, ctx)
                i += 2
                continue
        f = STAGES.get(name)
        if f is None:
            raise SpecError(f"unknown stage {name}")
        df, ctx = f(df, spec, ctx)
        i += 1
    return df
