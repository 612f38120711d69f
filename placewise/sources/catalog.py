"""The catalog: typed tables and polyline layers under a data folder of Parquet files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from placewise.sources.schemas import LAYERS, POLYLINE, TABLES


def _path(data_dir: str, name: str) -> str:
    return f"{data_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, name: str, data_dir: str) -> DataFrame:
    """A table or layer by name, lazily, with its declared schema."""
    schema = TABLES.get(name) or (POLYLINE if name in LAYERS else None)
    if schema is None:
        raise ValueError(f"no table {name!r}; known are {', '.join([*TABLES, *LAYERS])}")
    try:
        return spark.read.schema(schema).parquet(_path(data_dir, name))
    except AnalysisException as e:
        raise FileNotFoundError(f"failed to load table {name} from {_path(data_dir, name)}") from e


def _accessor(name: str):
    def read(spark: SparkSession, data_dir: str) -> DataFrame:
        return table(spark, name, data_dir)

    read.__name__, read.__doc__ = name, f"The table {name}."
    return read


usplace, uscounty, uscentract, uscenblkgrp, uszcta5, uszcta3, uscbsa, uscsa = map(_accessor, TABLES)
countries, usstates, nhsroads = map(_accessor, LAYERS)


def write_table(df: DataFrame, name: str, data_dir: str) -> None:
    """Store a table under its declared schema; a missing or superfluous column is an error."""
    schema = TABLES.get(name) or POLYLINE
    want = [c.strip().split(" ")[0] for c in schema.split(",")]
    if set(df.columns) != set(want):
        raise ValueError(f"{name} has columns {want}, not {df.columns}")
    df.sparkSession.createDataFrame([], schema).unionByName(df.select(*[df[c.strip().split(" ")[0]].cast(c.strip().split(" ")[1]) for c in schema.split(",")])).write.mode("overwrite").parquet(_path(data_dir, name))


def register_views(spark: SparkSession, data_dir: str, names: list[str] | None = None) -> None:
    """Make the tables known to spark.sql by their names."""
    for name in names or [*TABLES, *LAYERS]:
        table(spark, name, data_dir).createOrReplaceTempView(name)


def column_table(df: DataFrame) -> DataFrame:
    """The columns of a table as rows: position, name, type."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
