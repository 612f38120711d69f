"""The same operators on streams of points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from placewise.functions.geometry import is_continental, region_tag
from placewise.operators.bbox import extent
from placewise.operators.labels import place_labels


def tag_points(stream: DataFrame, lon: str = "LON", lat: str = "LAT") -> DataFrame:
    """Stateless: region and ISCUS of each point."""
    return stream.withColumns({"region": region_tag(F.col(lon), F.col(lat)), "ISCUS": is_continental(F.col(lon), F.col(lat))})


def windowed_extent(stream: DataFrame, ts: str, length: str, late: str, lon: str = "LON", lat: str = "LAT") -> DataFrame:
    """The extent of each time window; rows later than `late` are dropped and their windows' state freed."""
    windowed = stream.withWatermark(ts, late).withColumn("window", F.window(ts, length))
    return extent(windowed, lon, lat, by=["window"])


def label_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], **columns: str) -> DataStreamWriter:
    """Labels need a group's points together: each micro-batch is labelled on its own and handed to sink."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(place_labels(batch, **columns), number))
