"""State symbols and their FIPS codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIPS codes of the states, DC, and (last line) the territories.
STATE_FIPS = {
    "AL": 1, "AK": 2, "AZ": 4, "AR": 5, "CA": 6, "CO": 8, "CT": 9, "DE": 10, "DC": 11, "FL": 12, "GA": 13, "HI": 15,
    "ID": 16, "IL": 17, "IN": 18, "IA": 19, "KS": 20, "KY": 21, "LA": 22, "ME": 23, "MD": 24, "MA": 25, "MI": 26,
    "MN": 27, "MS": 28, "MO": 29, "MT": 30, "NE": 31, "NV": 32, "NH": 33, "NJ": 34, "NM": 35, "NY": 36, "NC": 37,
    "ND": 38, "OH": 39, "OK": 40, "OR": 41, "PA": 42, "RI": 44, "SC": 45, "SD": 46, "TN": 47, "TX": 48, "UT": 49,
    "VT": 50, "VA": 51, "WA": 53, "WV": 54, "WI": 55, "WY": 56,
    "AS": 60, "GU": 66, "MP": 69, "PR": 72, "VI": 78,
}


def state_to_fips(state: str | Column, strict: bool = True) -> int | Column | None:
    """The code of a state symbol (case-sensitive). Unknown: an error if strict, else null; a null symbol gives null."""
    if isinstance(state, str):
        if strict and state not in STATE_FIPS:
            raise ValueError(f"no state symbol {state!r}; known are {', '.join(sorted(STATE_FIPS))}")
        return STATE_FIPS.get(state)
    known = F.create_map(*reduce(lambda a, kv: [*a, F.lit(kv[0]), F.lit(kv[1])], STATE_FIPS.items(), []))
    code = known[state]
    if not strict:
        return code
    return F.when(state.isNull() | code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("no state symbol "), state)).cast("int"))


def states_to_fips(states: Column, strict: bool = False) -> Column:
    """The codes of an array of symbols."""
    return F.transform(states, lambda s: state_to_fips(s, strict))


def fips_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(STATE_FIPS.items()), "ST string, STFIP int")
