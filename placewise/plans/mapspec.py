"""Map plans: limits, and which layers a map draws in which style."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions.geometry import CUS_LIMITS, REGIONS, US_LIMITS, bbox_in_bbox, box
from placewise.operators.bbox import LIMITS, extent

# How far a map reaches beyond its points, and up to which span of latitudes it has roads.
XEXPAND, YEXPAND, ROAD_SPAN = 0.3, 0.1, 2.5


def _layer(name: str, color: str, width: float, alpha: float | Column, style: str | Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(name).alias("name"), F.lit(color).alias("color"), F.lit(width).alias("width"), as_column(alpha).alias("alpha"), as_column(style).alias("linestyle"))


def _with_layers(df: DataFrame, countries: Column, states: Column, roads: bool, road_span: float) -> DataFrame:
    short = F.lit(bool(roads)) & (F.abs(F.col("ymax") - F.col("ymin")) <= F.lit(float(road_span)))
    # state borders step back where country borders are drawn over them
    both = countries & states
    # fixed values: names and styles of the layers
    wanted = [
        F.when(short, _layer("NHS Roads", "grey", 0.5, 0.5, "solid")),
        F.when(states, _layer("US State Borders", "blue", 0.75, F.when(both, 0.5).otherwise(1.0), F.when(both, "dash").otherwise("solid"))),
        F.when(countries, _layer("Country Borders", "blue", 0.75, 1.0, "solid")),
    ]
    return df.withColumns({"country_borders": countries, "us_borders": states, "roads": short, "layers": F.array_compact(F.array(*wanted))})


def region_spec(spark: SparkSession, region: str | None = None, roads: bool = True, road_span: float = ROAD_SPAN) -> DataFrame:
    """The plan of a preset region, or of all."""
    if region is not None and region not in REGIONS:
        raise ValueError(f"no region {region!r}; known are {', '.join(REGIONS)}")
    rows = [(k, *map(float, v[0]), *map(float, v[1])) for k, v in REGIONS.items() if region in (None, k)]
    df = spark.createDataFrame(rows, "region string, xmin double, xmax double, ymin double, ymax double")
    return _with_layers(df, F.col("region") != "CUS", F.col("region") != "World", roads, road_span)


def map_spec(points: DataFrame, x: str = "LON", y: str = "LAT", by: Sequence[str] = (), xexpand: float = XEXPAND, yexpand: float = YEXPAND, roads: bool = True, road_span: float = ROAD_SPAN, us_borders_abroad: bool = False) -> DataFrame:
    """One plan per group from its points' extent.

    State borders are drawn where the raw box lies in the continental U.S., country borders elsewhere; with
    us_borders_abroad both where it lies in the U.S. box. Roads are drawn up to a latitude span of the final
    limits. Groups of fewer than two points have no plan; null is a group like any other.
    """
    box_ = extent(points, x, y, by, xexpand, yexpand, also={"_n": F.count("*")})
    raw = box(**{n: F.col(f"raw_{n}") for n in LIMITS})
    home = F.coalesce(bbox_in_bbox(raw, CUS_LIMITS), F.lit(False))
    states = home | F.coalesce(bbox_in_bbox(raw, US_LIMITS), F.lit(False)) if us_borders_abroad else home
    return _with_layers(box_.where("_n >= 2").drop("_n"), ~home, states, roads, road_span)


def layer_rows(spec: DataFrame) -> DataFrame:
    """A row per layer in drawing order, with seq from 1."""
    rest = [c for c in spec.columns if c != "layers"]
    out = spec.select(*rest, F.posexplode("layers").alias("_k", "_l"))
    return out.select(*rest, (F.col("_k") + 1).alias("seq"), "_l.name", "_l.color", "_l.width", "_l.alpha", "_l.linestyle")
