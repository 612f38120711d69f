"""Declared schemas of the statistical tables and the polyline layers."""

from __future__ import annotations

_AREA = "LAT double, LON double, POP bigint, ALAND double, AWATER double"
# Columns of each table, in order. Areas are square miles.
TABLES = {
    "usplace": f"STFIP int, PLFIP int, NAME string, ST string, {_AREA}, LSAD int, FUNCSTAT string, CBSA int, ISCUS boolean",
    "uscounty": f"STFIP int, COFIP int, NAME string, ST string, {_AREA}, CBSA int",
    "uscentract": f"STFIP int, COFIP int, TRFIP int, ST string, {_AREA}, ISCUS boolean",
    "uscenblkgrp": f"STFIP int, COFIP int, TRFIP int, BGFIP int, {_AREA}",
    "uszcta5": f"ZCTA5 int, {_AREA}, ISCUS boolean",
    "uszcta3": f"ZCTA3 int, {_AREA}, ISCUS boolean",
    "uscbsa": f"CBSA int, NAME string, {_AREA}, M_MSA string, CSA int, ISCUS boolean",
    "uscsa": f"CSA int, NAME string, {_AREA}",
}
POLYLINE = "layer string, part_id int, seq int, lon double, lat double"
LAYERS = ("countries", "usstates", "nhsroads")
