"""Polyline layers: parts from NaN breaks, and clipping to limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.geometry import Box, point_in_bbox
from placewise.operators.keys import join_groups

#: Numbers of seq that are numbered in one task.
BLOCK = 1 << 16


def split_parts(vertices: DataFrame, layer: str = "layer", seq: str = "seq", lon: str = "lon", lat: str = "lat", block: int = BLOCK) -> DataFrame:
    """Number the parts that NaN or null vertices separate, and drop these: layer, part_id, seq, lon, lat.

    seq is a number that no vertex of a layer shares. Breaks are counted in blocks of it, so that a layer of any
    length is numbered by many tasks.
    """
    gap = F.isnan(lon) | F.isnan(lat) | F.col(lon).isNull() | F.col(lat).isNull()
    marked = vertices.select(layer, seq, lon, lat).withColumns({"_gap": gap.cast("int"), "_block": F.floor(F.col(seq) / block)})
    counts = marked.groupBy(layer, "_block").agg(F.sum("_gap").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(layer).orderBy("_block")) - F.col("_n")).drop("_n")
    within = F.sum("_gap").over(Window.partitionBy(layer, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    numbered = join_groups(marked.withColumn("_within", within), before, [layer, "_block"])
    return numbered.where("_gap = 0").select(layer, (F.col("_before") + F.col("_within")).cast("int").alias("part_id"), seq, lon, lat)


def clip(vertices: DataFrame, limits: Box, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Vertices within the limits."""
    return vertices.where(point_in_bbox(F.col(lon), F.col(lat), limits))


def clip_lines(vertices: DataFrame, limits: Box, layer: str = "layer", part: str = "part_id", seq: str = "seq", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The lines cut at the limits: layer, part_id, piece, seq, lon, lat.

    Each stretch of a part within the limits is a piece, numbered from 0, with its ends on the limits where the line
    crosses them, and its vertices numbered from 0; a line that leaves and comes back gives two. What only touches
    the limits in a point, and a part of one vertex, gives nothing. A part is a group of one task.
    """
    (xmin, xmax), (ymin, ymax) = limits
    x, y, nx, ny = F.col("_x"), F.col("_y"), F.col("_nx"), F.col("_ny")
    dx, dy = nx - x, ny - y

    def reach(v: Column, d: Column, low: float, high: float) -> tuple[Column, Column]:
        """Where a segment enters and leaves a band, as shares of its length."""
        a, b = (F.lit(float(low)) - v) / F.nullif(d, F.lit(0.0)), (F.lit(float(high)) - v) / F.nullif(d, F.lit(0.0))
        inside = (v >= low) & (v <= high)
        return (
            F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)),
            F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b)),
        )

    segments = vertices.select(layer, part, F.col(seq).alias("_seq"), F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y"))
    order = Window.partitionBy(layer, part).orderBy("_seq")
    segments = segments.withColumns({"_nx": F.lead("_x").over(order), "_ny": F.lead("_y").over(order)}).where(nx.isNotNull())
    (x0, x1), (y0, y1) = reach(x, dx, xmin, xmax), reach(y, dy, ymin, ymax)
    cut = segments.withColumns({"_t0": F.greatest(F.lit(0.0), x0, y0), "_t1": F.least(F.lit(1.0), x1, y1)})
    # a segment goes on from the one before if that one ends, uncut, where this one begins
    goes_on = (F.col("_t0") == 0) & F.coalesce((F.lag("_t1").over(order) == 1) & (F.lag("_t0").over(order) < 1), F.lit(False))
    cut = cut.withColumn("_starts", ~goes_on).where("_t0 < _t1")
    cut = cut.withColumn("piece", (F.sum(F.col("_starts").cast("int")).over(order) - 1).cast("int"))
    held = lambda v, low, high: F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))

    def at(t: Column) -> Column:
        return F.struct(
            held(F.when(t == 0, x).when(t == 1, nx).otherwise(x + t * dx), xmin, xmax).alias("lon"),
            held(F.when(t == 0, y).when(t == 1, ny).otherwise(y + t * dy), ymin, ymax).alias("lat"),
        )

    ends = F.array(F.when(F.col("_starts"), at(F.col("_t0"))), at(F.col("_t1")))
    points = cut.select(layer, part, "piece", "_seq", F.posexplode(ends).alias("_k", "_p")).where(F.col("_p").isNotNull())
    number = F.row_number().over(Window.partitionBy(layer, part, "piece").orderBy("_seq", "_k")) - 1
    return points.select(layer, part, "piece", number.alias("seq"), F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat"))
