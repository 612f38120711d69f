"""Delaunay neighbours of point groups.

Groups are spread over the cluster and triangulated by exact insertion (triangulate.py); a single group, the labels
of one map, is one task. Null is a group like any other. Points without id or without finite coordinates take no
part; of points at one place the one of least id stands for all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.geometry import bearing, planar_distance
from placewise.operators.triangulate import Triangulation


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))


def spots_of(points: DataFrame, id: str, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """by..., id, x, y of the points that take part."""
    kept = points.where(finite(F.col(x).cast("double")) & finite(F.col(y).cast("double")) & F.col(id).isNotNull())
    # -0.0 and 0.0 are one place
    return kept.select(*by, F.col(id).alias("id"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y"))


def _grouped(points: DataFrame, id: str, x: str, y: str, by: Sequence[str], wanted, corners: Sequence[str]) -> DataFrame:
    """For each group the index tuples that `wanted` takes from its triangulation, as ids under the names of corners, and their x and y."""
    kept = spots_of(points, id, x, y, by)

    def made(key: tuple, part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part["id"]))
        px, py = part["x"].to_numpy(), part["y"].to_numpy()
        _, first = np.unique(np.stack((px, py), axis=1), axis=0, return_index=True)
        first.sort()
        found = np.array(wanted(Triangulation(px[first], py[first])), np.int64).reshape(-1, len(corners))
        rows = first[found] if len(found) else found
        out = [pa.array([k.as_py()] * len(rows), k.type) for k in key]
        for name in ("id", "x", "y"):
            column = part[name].combine_chunks()
            out += [column.take(pa.array(rows[:, i])) for i in range(len(corners))]
        return pa.table(out, names=[*by, *corners, *[f"{c}{k}" for c in "xy" for k in corners]])

    kind = dict(kept.dtypes)
    schema = [*[f"`{k}` {kind[k]}" for k in by], *[f"`{k}` {kind['id']}" for k in corners], *[f"`{c}{k}` double" for c in "xy" for k in corners]]
    return kept.groupBy(*by).applyInArrow(made, ", ".join(schema))


def delaunay_edges(points: DataFrame, id: str = "id", x: str = "x", y: str = "y", by: Sequence[str] = ("g",)) -> DataFrame:
    """Undirected edges of each group: by..., i, j with i < j in the order of ids.

    Of points on one circle, as far as the rounding of their coordinates tells, the diagonals that a triangulation
    would choose among are left out, at every size of a group.
    """
    return _grouped(points, id, x, y, by, Triangulation.edges, ("i", "j")).select(*by, "i", "j")


def delaunay_triangles(points: DataFrame, id: str = "id", x: str = "x", y: str = "y", by: Sequence[str] = ("g",)) -> DataFrame:
    """Triangles between the edges of each group: by..., i < j < k."""
    return _grouped(points, id, x, y, by, Triangulation.triangles, ("i", "j", "k")).select(*by, "i", "j", "k")


def neighbours(points: DataFrame, id: str = "id", x: str = "x", y: str = "y", by: Sequence[str] = ("g",)) -> DataFrame:
    """Each point's Delaunay neighbours: by..., i, j, d (planar distance), ang (bearing from i to j), rn (rank by d, then j)."""
    edges = _grouped(points, id, x, y, by, Triangulation.edges, ("i", "j"))
    end = lambda a, b: F.struct(*[F.col(c.format(a=a, b=b)).alias(n) for c, n in (("{a}", "i"), ("{b}", "j"), ("x{a}", "xi"), ("y{a}", "yi"), ("x{b}", "xj"), ("y{b}", "yj"))])
    both = edges.select(*by, F.explode(F.array(end("i", "j"), end("j", "i"))).alias("_e")).select(*by, "_e.*")
    ends = [F.col(c) for c in ("xi", "yi", "xj", "yj")]
    out = both.withColumns({"d": planar_distance(*ends), "ang": bearing(*ends)})
    rank = F.row_number().over(Window.partitionBy(*by, "i").orderBy("d", "j"))
    return out.withColumn("rn", rank).select(*by, "i", "j", "d", "ang", "rn")
