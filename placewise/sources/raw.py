"""Adapters of raw sources: gazetteer and population files, delineations, and GeoJSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions.geometry import is_continental


def read_delimited(spark: SparkSession, path: str, sep: str, schema: str) -> DataFrame:
    """A headed text file with a declared schema; names are taken by position, blanks around values are dropped."""
    return spark.read.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path, sep=sep, header=True, schema=schema, enforceSchema=True)


def read_gazetteer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Areas and interior points, tab-separated."""
    return read_delimited(spark, path, "\t", schema)


def read_population_centres(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Centres of population, comma-separated."""
    return read_delimited(spark, path, ",", schema)


def read_delineation(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Which counties or principal cities belong to which metropolitan area; exported from its spreadsheet as CSV."""
    return read_delimited(spark, path, ",", schema)


def assemble(areas: DataFrame, population: DataFrame, keys: list[str], membership: DataFrame | None = None, flag: bool = False) -> DataFrame:
    """Areas with population by key; membership (keys, CBSA) may lack rows; flag adds ISCUS from the coordinates."""
    out = areas.join(population, keys)
    if membership is not None:
        out = out.join(membership, keys, "left")
    return out.withColumn("ISCUS", is_continental(F.col("LON"), F.col("LAT"))) if flag else out


def read_geojson_lines(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Vertices of the LineString, MultiLineString, Polygon and MultiPolygon features of a GeoJSON file as a polyline layer.

    Parts are numbered in the order of the file, which is one JSON value and so one task's to read; its parts are
    dealt to all tasks before their vertices come apart.
    """
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>>>"

    def parts(feature: Column) -> Column:
        kind, raw = feature["geometry"]["type"], feature["geometry"]["coordinates"]
        lines = F.when(kind == "LineString", F.array(F.from_json(raw, "array<array<double>>")))
        lines = lines.when(kind.isin("MultiLineString", "Polygon"), F.from_json(raw, "array<array<array<double>>>"))
        lines = lines.when(kind == "MultiPolygon", F.flatten(F.from_json(raw, "array<array<array<array<double>>>>")))
        return F.coalesce(lines, F.array().cast("array<array<array<double>>>"))

    every = spark.read.json(path, multiLine=True, schema=schema).select(F.posexplode(F.flatten(F.transform("features", parts))).alias("part_id", "points"))
    vertices = every.repartition("part_id").select("part_id", F.posexplode("points").alias("seq", "p"))
    return vertices.select(F.lit(layer).alias("layer"), "part_id", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
