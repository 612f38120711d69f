"""Scalar geometry: boxes, regions, distances, bearings and label sectors, all as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Longitude and latitude limits of the preset regions.
WORLD_LIMITS = ((-180.0, 180.0), (-75.0, 75.0))
US_LIMITS = ((-180.0, -65.0), (15.0, 72.0))
CUS_LIMITS = ((-125.0, -65.0), (24.0, 50.0))
REGIONS = {"World": WORLD_LIMITS, "US": US_LIMITS, "CUS": CUS_LIMITS}

Box = tuple[Sequence[float], Sequence[float]]


def box(limits: Box | None = None, *, xmin: Column | None = None, xmax: Column | None = None, ymin: Column | None = None, ymax: Column | None = None) -> Column:
    """A box column: struct of xmin, xmax, ymin, ymax (doubles)."""
    if limits is not None:
        (a, b), (c, d) = (tuple(x)[:2] for x in limits)
        xmin, xmax, ymin, ymax = (F.lit(float(v)) for v in (a, b, c, d))
    return F.struct(xmin.cast("double").alias("xmin"), xmax.cast("double").alias("xmax"), ymin.cast("double").alias("ymin"), ymax.cast("double").alias("ymax"))


def _side(limits: Box | Column) -> tuple[Column, Column, Column, Column]:
    if isinstance(limits, Column):
        return tuple(limits[k] for k in ("xmin", "xmax", "ymin", "ymax"))
    (a, b), (c, d) = (tuple(x)[:2] for x in limits)
    return tuple(F.lit(float(v)) for v in (a, b, c, d))


def point_in_bbox(x: Column | Sequence[float], y: Column | None = None, limits: Box | Column | None = None) -> Column | bool:
    """Whether a point lies in a closed box. A point of plain numbers needs exactly two. NaN lies nowhere, no NaN limit holds a point; null gives null."""
    if not isinstance(x, Column):
        if len(x) != 2:
            raise ValueError(f"a point has 2 coordinates, not {len(x)}")
        (a, b), (c, d) = limits if limits is not None else y
        return a <= x[0] <= b and c <= x[1] <= d
    xmin, xmax, ymin, ymax = _side(limits)
    inside = (x >= xmin) & (x <= xmax) & (y >= ymin) & (y <= ymax)
    if isinstance(limits, Column):  # Spark sorts NaN above all numbers
        inside &= ~(F.isnan(xmax) | F.isnan(ymax))
    return inside


def bbox_in_bbox(inner: Box | Column, outer: Box | Column) -> Column:
    """Closed containment of one box in another; NaN limits contain nothing."""
    a, b = _side(inner), _side(outer)
    inside = (a[0] >= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] <= b[3])
    for v in (*a, *b):
        inside &= ~F.isnan(v)
    return inside


def is_continental(lon: Column, lat: Column) -> Column:
    """The ISCUS flag: in the continental U.S. box."""
    return point_in_bbox(lon, lat, CUS_LIMITS)


def region_tag(lon: Column, lat: Column) -> Column:
    """The smallest preset region that holds the point, else null."""
    return F.when(point_in_bbox(lon, lat, CUS_LIMITS), "CUS").when(point_in_bbox(lon, lat, US_LIMITS), "US").when(point_in_bbox(lon, lat, WORLD_LIMITS), "World")


def region_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v[0], *v[1]) for k, v in REGIONS.items()], "region string, xmin double, xmax double, ymin double, ymax double")


def planar_distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """In degrees, without regard to the sphere."""
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def bearing(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Direction from the first point to the second in degrees, counter-clockwise from east, above -180 up to 180."""
    return F.degrees(F.atan2(y1 - y0, x1 - x0))


def mercator(lon: Column, lat: Column, radius: float = 6378137.0) -> Column:
    """Spherical Mercator x and y."""
    return F.struct((F.radians(lon) * radius).alias("x"), (F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * radius).alias("y"))


# The placement of each 45-degree sector from 22.5 degrees on: alignments, and the signs of the offsets.
SECTORS = [
    ("left", "bottom", 1, 1), ("center", "bottom", 0, 1), ("right", "bottom", -1, 1), ("right", "center", -1, 0),
    ("right", "top", -1, -1), ("center", "top", 0, -1), ("left", "top", 1, -1),
]
#: What a label on an axis is moved further, across and along.
ACROSS, ALONG = 3, 2


def sector_placement(angle: Column, offset: float | Column = 1.0) -> Column:
    """The placement of a label in a direction: struct halign, valign, hoffset, voffset.

    A negative angle gains 360 once. What then lies in no sector (360 and more, far negative, NaN) falls to
    left, top; so does a negative angle too small to lower 360. Null gives null.
    """
    d = offset if isinstance(offset, Column) else F.lit(float(offset))
    turned = F.when(angle < 0, angle + 360).otherwise(angle)

    def made(h: str, v: str, a: int, b: int) -> Column:
        dx = d + ACROSS if not b else d
        dy = d + ALONG if not a else d
        return F.struct(F.lit(h).alias("halign"), F.lit(v).alias("valign"), (dx * float(a) if a else F.lit(0.0)).alias("hoffset"), (dy * float(b) if b else F.lit(0.0)).alias("voffset"))

    def between(lo: float, hi: float) -> Column:
        return (turned >= lo) & (turned < hi) & ~F.isnan(turned)

    east = made("left", "center", 1, 0)
    out = F.when(angle.isNull(), F.lit(None)).when(between(0.0, 22.5) | between(337.5, 360.0), east)
    for i, sector in enumerate(SECTORS):
        out = out.when(between(22.5 + 45 * i, 67.5 + 45 * i), made(*sector))
    return out.otherwise(made("left", "top", 1, -1))
