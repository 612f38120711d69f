"""Label placement: away from a close neighbour, or into the widest gap between neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.geometry import bearing, sector_placement
from placewise.operators.keys import join_groups
from placewise.operators.neighbors import neighbours, spots_of


def isolation(near: DataFrame, by: Sequence[str] = ("g",), ratio: float = 1.5) -> DataFrame:
    """For each point of neighbours(): d1, d2, d3, the direction of the nearest, and whether it stands apart with it.

    A point stands apart if its second distance exceeds `ratio` times the first, or the third `ratio` times their sum;
    with one neighbour only it does.
    """
    nth = lambda k, c: F.max(F.when(F.col("rn") == k, F.col(c)))
    out = near.where("rn <= 3").groupBy(*by, "i").agg(nth(1, "d").alias("d1"), nth(2, "d").alias("d2"), nth(3, "d").alias("d3"), nth(1, "ang").alias("nearest"))
    apart = F.col("d2").isNull() | (F.col("d2") > ratio * F.col("d1")) | F.coalesce(F.col("d3") > ratio * (F.col("d1") + F.col("d2")), F.lit(False))
    return out.withColumn("isolated", apart)


def gaps(near: DataFrame, by: Sequence[str] = ("g",)) -> DataFrame:
    """Angles between neighbouring directions: by..., i, ang (where the gap begins) and gap; the last one wraps around."""
    own = Window.partitionBy(*by, "i")
    following = F.lead("ang").over(own.orderBy("ang", "j"))
    wrapped = (F.min("ang").over(own) + 180) + (180 - F.max("ang").over(own))
    return near.withColumn("gap", F.coalesce(following - F.col("ang"), wrapped)).select(*by, "i", "ang", "gap")


def widest_gap(near: DataFrame, by: Sequence[str] = ("g",)) -> DataFrame:
    """The widest gap of each point, the first of equal ones."""
    best = F.min(F.struct((-F.col("gap")).alias("n"), F.col("ang").alias("ang"))).alias("best")
    return gaps(near, by).groupBy(*by, "i").agg(best).select(*by, "i", F.col("best.ang").alias("ang"), (-F.col("best.n")).alias("gap"))


def place_labels(points: DataFrame, id: str = "id", x: str = "x", y: str = "y", by: Sequence[str] = ("g",), offset: float = 1.0, ratio: float = 1.5) -> DataFrame:
    """by..., id, halign, valign, hoffset, voffset for each point of each group; null is a group of its own.

    One point: to the upper right. Two: the first towards the second, the second the other way. More: a point
    that stands apart with its nearest neighbour is labelled away from it, any other into its widest gap. Points
    at one place share a label; points without id or without finite coordinates get none.
    """
    by = list(by)
    placed = spots_of(points, id, x, y, by).withColumn("i", F.min("id").over(Window.partitionBy(*by, "x", "y")))
    group = Window.partitionBy(*by)
    counted = placed.select(*by, "i", "x", "y").distinct().withColumn("_n", F.count("*").over(group))
    few = counted.where("_n <= 2")
    order = group.orderBy("i")
    turn = F.row_number().over(order)
    other = lambda c: F.coalesce(F.lead(c).over(order), F.lag(c).over(order))
    few = few.withColumns({"_turn": turn, "_ox": other("x"), "_oy": other("y")})
    first = bearing(F.col("x"), F.col("y"), F.col("_ox"), F.col("_oy"))
    second = bearing(F.col("_ox"), F.col("_oy"), F.col("x"), F.col("y")) - 180
    few = few.withColumn("angle", F.when(F.col("_n") == 1, F.lit(45.0)).when(F.col("_turn") == 1, first).otherwise(second)).select(*by, "i", "angle")
    many = counted.where("_n > 2").select(*by, "i", "x", "y")
    near = neighbours(many, "i", "x", "y", by)
    angle = F.when(F.col("isolated"), F.col("nearest") - 180).otherwise(F.col("ang") + F.col("gap") / 2)
    # both come from rows that are dealt by the same keys
    more = join_groups(isolation(near, by, ratio), widest_gap(near, by), [*by, "i"]).select(*by, "i", angle.alias("angle"))
    out = join_groups(placed.select(*by, "id", "i"), few.unionByName(more), [*by, "i"])
    return out.withColumn("_p", sector_placement(F.col("angle"), offset)).select(*by, "id", "_p.halign", "_p.valign", "_p.hoffset", "_p.voffset")
