"""Extents: NaN-skipping bounding boxes with expansion and clamps."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how far a clamped box stays off a pole, the square root of the double's epsilon.
POLE_GAP = 2.0**-26
LIMITS = ("xmin", "xmax", "ymin", "ymax")


def expanded(xmin: Column, xmax: Column, ymin: Column, ymax: Column, xexpand: float, yexpand: float) -> list[Column]:
    """Each side moved out by its share of the span and clamped. Where latitude reaches a pole that side's expansion is dropped."""
    dx, dy = (xmax - xmin) * F.lit(float(xexpand)), (ymax - ymin) * F.lit(float(yexpand))
    west, east, south, north = xmin - dx, xmax + dx, ymin - dy, ymax + dy
    return [
        F.when(west < -180, -180.0).otherwise(west),
        F.when(east > 180, 180.0).otherwise(east),
        F.when(south <= -90, F.greatest(F.lit(-90 + POLE_GAP), ymin)).otherwise(south),
        F.when(north >= 90, F.least(F.lit(90 - POLE_GAP), ymax)).otherwise(north),
    ]


def extent(df: DataFrame, x: str = "LON", y: str = "LAT", by: Sequence[str] = (), xexpand: float = 0.0, yexpand: float = 0.0, also: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per group: raw_xmin, ... (NaN and null skipped on each axis for itself) and the expanded xmin, ...

    A group without any number on an axis has null limits there; null is a group like any other. One aggregation,
    combined before the shuffle; also: further aggregates by name.
    """
    clean = {a: F.when(~F.isnan(a), F.col(a).cast("double")) for a in (x, y)}
    raw = df.groupBy(*by).agg(
        F.min(clean[x]).alias("raw_xmin"), F.max(clean[x]).alias("raw_xmax"), F.min(clean[y]).alias("raw_ymin"), F.max(clean[y]).alias("raw_ymax"),
        *[c.alias(n) for n, c in (also or {}).items()],
    )
    sides = expanded(*[F.col(f"raw_{n}") for n in LIMITS], xexpand, yexpand)
    return raw.withColumns(dict(zip(LIMITS, sides, strict=True)))


def bbox_of(xs: Iterable[float], ys: Iterable[float], xexpand: float = 0.0, yexpand: float = 0.0) -> tuple[tuple, tuple]:
    """The same over plain numbers: (expanded box, raw box), each ((xmin, xmax), (ymin, ymax))."""
    xs, ys = list(xs), list(ys)
    if len(xs) != len(ys):
        raise ValueError(f"{len(xs)} longitudes and {len(ys)} latitudes")
    x, y = ([float(v) for v in vs if not math.isnan(v)] for vs in (xs, ys))
    if not x or not y:
        raise ValueError("no coordinates")
    raw = ((min(x), max(x)), (min(y), max(y)))
    (a, b), (c, d) = raw
    west, east = a - (b - a) * xexpand, b + (b - a) * xexpand
    south, north = c - (d - c) * yexpand, d + (d - c) * yexpand
    south = max(-90 + POLE_GAP, c) if south <= -90 else south
    north = min(90 - POLE_GAP, d) if north >= 90 else north
    return ((max(west, -180.0), min(east, 180.0)), (south, north)), raw
