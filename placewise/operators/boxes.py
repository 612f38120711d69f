"""Points met with a table of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.geometry import box, point_in_bbox
from placewise.operators.neighbors import finite

#: Degrees of a side of a cell; the earth has 72 by 36 of them.
CELL = 5.0


def _cell(v: Column, most: float) -> Column:
    """The cell of a coordinate; what is beyond the earth falls into its outermost cells."""
    return F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), v)) / CELL).cast("int")


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str = "LON", y: str = "LAT", sides: tuple[str, str, str, str] = ("xmin", "xmax", "ymin", "ymax")) -> DataFrame:
    """Every pair of a point and a closed box that holds it: the columns of both.

    Both sides may be of any size: a box is listed under the cells that it covers (at most all of the earth's), a
    point has one cell, and cells are joined by equality. Points without finite coordinates and boxes with a null or
    NaN side, or none inside, meet nothing. Column names of the two tables must differ.
    """
    a, b, c, d = (F.col(s).cast("double") for s in sides)
    good = boxes.where((a <= b) & (c <= d) & ~F.isnan(b) & ~F.isnan(d))
    listed = good.withColumn("_cx", F.explode(F.sequence(_cell(a, 180.0), _cell(b, 180.0)))).withColumn("_cy", F.explode(F.sequence(_cell(c, 90.0), _cell(d, 90.0))))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    placed = points.where(finite(px) & finite(py)).withColumns({"_cx": _cell(px, 180.0), "_cy": _cell(py, 90.0)})
    held = point_in_bbox(px, py, box(xmin=a, xmax=b, ymin=c, ymax=d))
    return placed.join(listed, ["_cx", "_cy"]).where(held).drop("_cx", "_cy")
