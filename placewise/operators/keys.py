"""Joins on group keys, of which null is one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null equals null; the keys stay once. Other columns need distinct names."""
    other = [c for c in right.columns if c not in names]
    renamed = right.select(*[F.col(c).alias(f"_key{k}") for k, c in enumerate(names)], *other)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(names)])
    return left.join(renamed, same, how).drop(*[f"_key{k}" for k in range(len(names))])
