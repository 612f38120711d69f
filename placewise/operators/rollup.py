"""Geographic roll-ups: sums and population-weighted centroids over a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.geometry import is_continental

SUMS = ("POP", "ALAND", "AWATER")


def weighted_rollup(df: DataFrame, keys: Sequence[str | Column], sums: Sequence[str] = SUMS, lat: str = "LAT", lon: str = "LON", weight: str = "POP", flag: bool = False) -> DataFrame:
    """Sums of `sums` and centroids of raw degrees weighted by `weight`; without weight the plain mean. Rows with a null key go.

    flag: ISCUS from the centroid.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    kept = df
    for k in named:
        kept = kept.where(k.isNotNull())
    centre = lambda c: F.coalesce(F.sum(F.col(c) * F.col(weight)) / F.when(F.sum(weight) != 0, F.sum(weight)), F.avg(c)).alias(c)
    out = kept.groupBy(*named).agg(centre(lat), centre(lon), *[F.sum(c).alias(c) for c in sums])
    return out.withColumn("ISCUS", is_continental(F.col(lon), F.col(lat))) if flag else out


def zcta3(zcta5: DataFrame) -> DataFrame:
    return weighted_rollup(zcta5.withColumn("ZCTA3", F.expr("cast(ZCTA5 div 100 as int)")), ["ZCTA3"], flag=True)


def cbsa(county: DataFrame, delineation: DataFrame) -> DataFrame:
    """Counties to core-based areas; delineation: CBSA, NAME, M_MSA, CSA, a row for each area."""
    return weighted_rollup(county, ["CBSA"], flag=True).join(delineation, "CBSA", "left")


def csa(cbsas: DataFrame, names: DataFrame) -> DataFrame:
    """Core-based areas to combined areas; names: CSA, NAME."""
    return weighted_rollup(cbsas, ["CSA"]).join(names, "CSA", "left")
