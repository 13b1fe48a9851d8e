"""Projections: inclusion, exclusion and computed fields, with dotted paths."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.errors import SpecError
from vellum.functions.exprs import compile_expr
from vellum.functions.paths import Scope, check_name, quoted, with_path, without_path


def _off(v: Any) -> bool:
    return v is False or (isinstance(v, (int, float)) and not isinstance(v, bool) and v == 0)


def _on(v: Any) -> bool:
    return v is True or (isinstance(v, (int, float)) and not isinstance(v, bool) and v != 0)


def project(df: DataFrame, spec: dict, key: str = "_id", expressions: bool = True) -> DataFrame:
    """``$project`` and find's projection (without expressions): exclusion if any field but the key is switched off."""
    if not isinstance(spec, dict) or not spec:
        raise SpecError("a projection needs fields")
    rest = {check_name(k): v for k, v in spec.items() if k != key}
    if any(_off(v) for v in rest.values()) or (not rest and _off(spec.get(key))):
        if any(not _off(v) for v in rest.values()):
            raise SpecError("a projection either includes or excludes")
        return exclude(df, [*rest, *([key] if key in spec and _off(spec[key]) else [])])
    scope = Scope.of(df)
    tree: dict[str, Any] = {}
    keep_key = key not in spec or not _off(spec[key])
    if keep_key and scope.top(key)[0] is not None or key in spec and keep_key:
        tree[key] = scope.get(key)[0] if key not in spec or _on(spec[key]) else compile_expr(spec[key], scope).col
    for path, v in rest.items():
        if _on(v):
            col, kind = scope.get(path)
            if kind is None:
                continue  # a field that is missing stays so
        elif expressions:
            col = compile_expr(v, scope).col
        else:
            raise SpecError(f"a find projection has no expressions: {path}")
        _put(tree, path.split("."), col)
    return df.select(*(_build(v).alias(k) for k, v in tree.items()))


def _put(tree: dict, path: list[str], col: Column) -> None:
    for step in path[:-1]:
        inner = tree.setdefault(step, {})
        if not isinstance(inner, dict):
            raise SpecError(f"paths collide at {step}")
        tree = inner
    if path[-1] in tree:
        raise SpecError(f"paths collide at {path[-1]}")
    tree[path[-1]] = col


def _build(v: Any) -> Column:
    return F.struct(*(_build(x).alias(k) for k, x in v.items())) if isinstance(v, dict) else v


def exclude(df: DataFrame, paths: list[str]) -> DataFrame:
    for p in paths:
        df = without_path(df, p)
    return df


def add_fields(df: DataFrame, spec: dict) -> DataFrame:
    """``$addFields``: every expression sees the rows as they came in, none another's result."""
    if not isinstance(spec, dict) or not spec:
        raise SpecError("$addFields needs fields")
    scope = Scope.of(df)
    made = {check_name(p): compile_expr(e, scope).col for p, e in spec.items()}
    if all("." not in p for p in made):
        return df.withColumns(made)
    names = [f"__new{i}" for i in range(len(made))]
    df = df.withColumns(dict(zip(names, made.values())))
    for n, p in zip(names, made):
        df = with_path(df, p, F.col(quoted(n)))
    return df.drop(*names)
