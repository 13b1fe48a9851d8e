"""Points on a sphere: normalising, great-circle distance, distance and box predicates.

Points are documents {type: Point, coordinates: [lon, lat]}, {lng|lon|longitude, lat|latitude}, or [lon, lat]; any numeric type
counts. ``within_box`` tests the bounding box of the polygon, as the engine this follows does; ``near`` has a default
distance of 1,000 m and doesn't sort.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import SpecError

RADIUS = 6_371_000.0
DEFAULT_DISTANCE = 1_000.0


def point_of_value(value: Any) -> tuple[float, float]:
    """(lon, lat) of a plain value."""
    if isinstance(value, dict):
        if "coordinates" in value:
            value = value["coordinates"]
        else:
            lon = next((value[k] for k in ("lng", "lon", "longitude") if k in value), None)
            lat = next((value[k] for k in ("lat", "latitude") if k in value), None)
            value = [lon, lat]
    if not isinstance(value, (list, tuple)) or len(value) < 2 or not all(isinstance(v, (int, float)) for v in value[:2]):
        raise SpecError(f"no point: {value!r}")
    return float(value[0]), float(value[1])


def point_of(col: Column, kind: T.DataType | None) -> tuple[Column, Column] | None:
    """(lon, lat) of a column, by its type; None if it can't hold points."""
    if isinstance(kind, T.ArrayType):
        return F.get(col, F.lit(0)).cast("double"), F.get(col, F.lit(1)).cast("double")
    if isinstance(kind, T.StructType):
        if "coordinates" in kind.names:
            return point_of(col.getField("coordinates"), kind["coordinates"].dataType)
        lon = next((n for n in ("lng", "lon", "longitude") if n in kind.names), None)
        lat = next((n for n in ("lat", "latitude") if n in kind.names), None)
        if lon and lat:
            return col.getField(lon).cast("double"), col.getField(lat).cast("double")
    return None


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points along the great circle."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    # The squares are made first, as pow() in SQL does: another order differs in the last bit, and with it the order of rows.
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (F.sin(half_lon) * F.sin(half_lon))
    return F.lit(2 * RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def near(col: Column, kind: T.DataType | None, spec: Any) -> Column:
    if not isinstance(spec, dict) or "$geometry" not in spec:
        raise SpecError("$near needs a $geometry")
    lon, lat = point_of_value(spec["$geometry"])
    most = spec.get("$maxDistance", DEFAULT_DISTANCE)
    p = point_of(col, kind)
    if p is None:
        return F.lit(False)
    distance = haversine(F.lit(lon), F.lit(lat), *p)
    # A band of latitude is a cheap bound that can skip most rows before the trigonometry.
    band = float(most) / RADIUS * 57.29577951308232 * 1.0001 + 1e-9
    return p[1].between(lat - band, lat + band) & (distance <= F.lit(float(most)))


def within_box(col: Column, kind: T.DataType | None, spec: Any) -> Column:
    geometry = spec.get("$geometry") if isinstance(spec, dict) else None
    if not isinstance(geometry, dict) or not geometry.get("coordinates"):
        raise SpecError("$geoWithin needs a $geometry with coordinates")
    points = geometry["coordinates"]
    while isinstance(points[0][0], (list, tuple)):
        points = [p for ring in points for p in ring]
    xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
    p = point_of(col, kind)
    return F.lit(False) if p is None else p[0].between(min(xs), max(xs)) & p[1].between(min(ys), max(ys))


def near_sorted(df: DataFrame, field: str, lon: float, lat: float, limit: int | None = None, max_distance: float | None = None, key: str = "_id") -> DataFrame:
    """Rows by distance from a point, with the column ``distance``; of equal distances by the key, where there is such a column."""
    from vellum.functions.paths import Scope, quoted

    p = point_of(*Scope.of(df).get(field))
    if p is None:
        raise SpecError(f"{field} holds no points")
    out = df.withColumn("distance", haversine(F.lit(float(lon)), F.lit(float(lat)), *p)).filter(F.col("distance").isNotNull())
    if max_distance is not None:
        out = out.filter(F.col("distance") <= float(max_distance))
    out = out.orderBy("distance", *([F.col(quoted(key)).asc_nulls_last()] if key in df.columns else []))
    return out if limit is None else out.limit(limit)
