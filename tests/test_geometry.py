from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from placewise.functions import geometry as geo
from placewise.functions.codes import STATE_FIPS, fips_table, state_to_fips, states_to_fips
from placewise.operators.bbox import POLE_GAP, bbox_of, extent
from placewise.plans.mapspec import layer_rows, map_spec, region_spec


def test_state_codes(spark):
    assert state_to_fips("NC") == 37 and state_to_fips("NY") == 36
    assert len(STATE_FIPS) == 56 == fips_table(spark).count()
    with pytest.raises(ValueError):
        state_to_fips("XX")
    assert state_to_fips("nc", strict=False) is None
    df = spark.createDataFrame([("NC",), (None,)], "s string")
    assert [r[0] for r in df.select(state_to_fips(F.col("s"))).collect()] == [37, None]
    assert df.select(states_to_fips(F.array(F.lit("NC"), F.lit("XX")))).first()[0] == [37, None]
    with pytest.raises(Exception, match="no state symbol"):
        spark.createDataFrame([("XX",)], "s string").select(state_to_fips(F.col("s"))).collect()


def test_presets():
    assert geo.WORLD_LIMITS == ((-180, 180), (-75, 75))
    assert geo.US_LIMITS == ((-180, -65), (15, 72))
    assert geo.CUS_LIMITS == ((-125, -65), (24, 50))


def test_extent_numbers():
    out, raw = bbox_of([-80, -75, -78], [35, 40, 38], 0.1, 0.1)
    assert raw == ((-80, -75), (35, 40))
    assert out[0] == pytest.approx((-80.5, -74.5)) and out[1] == pytest.approx((34.5, 40.5))
    assert bbox_of([0, 1], [-80, 80], 0, 0.1)[0][1] == (-80, 80)
    assert bbox_of([0, 1], [-90, 0])[0][1][0] == -90 + POLE_GAP
    assert bbox_of([-179, 179], [0, 1], 0.1)[0][0] == (-180, 180)
    assert bbox_of([math.nan, 1, 3], [-5, math.nan, 2])[1] == ((1, 3), (-5, 2))
    with pytest.raises(ValueError):
        bbox_of([1], [1, 2])
    with pytest.raises(ValueError):
        bbox_of([], [])


def test_extent_frames_agree_with_numbers(spark):
    points = [("a", -80.0, 35.0), ("a", -75.0, 40.0), ("b", math.nan, -80.0), ("b", 179.0, math.nan), ("b", -179.0, 80.0), ("c", None, math.nan)]
    df = spark.createDataFrame(points, "g string, LON double, LAT double")
    got = {r["g"]: r for r in extent(df, by=["g"], xexpand=0.1, yexpand=0.1).collect()}
    for g in "ab":
        xs, ys = zip(*[(x, y) for k, x, y in points if k == g], strict=True)
        (x, y), (rx, ry) = bbox_of(xs, ys, 0.1, 0.1)
        assert tuple(got[g][k] for k in ("xmin", "xmax", "ymin", "ymax", "raw_xmin", "raw_xmax", "raw_ymin", "raw_ymax")) == (*x, *y, *rx, *ry)
    assert got["c"]["xmin"] is None
    assert extent(df.limit(0)).first()["xmin"] is None and extent(df.limit(0), by=["g"]).count() == 0


def test_points_and_boxes(spark):
    world = ((-180, 180), (-90, 90))
    assert geo.point_in_bbox((0, 0), world) is True and geo.point_in_bbox([200, 100], world) is False
    with pytest.raises(ValueError):
        geo.point_in_bbox((1, 2, 3), world)
    df = spark.createDataFrame([(-125.0, 24.0), (-65.0, 50.0), (-64.9, 30.0), (math.nan, 30.0)], "x double, y double")
    assert [r[0] for r in df.select(geo.point_in_bbox(F.col("x"), F.col("y"), geo.CUS_LIMITS)).collect()] == [True, True, False, False]
    one = spark.range(1)
    test = lambda a, b: one.select(geo.bbox_in_bbox(geo.box(a), geo.box(b))).first()[0]
    assert test(geo.CUS_LIMITS, geo.US_LIMITS) and not test(geo.US_LIMITS, geo.CUS_LIMITS)
    assert not test(geo.CUS_LIMITS, ((-180, math.nan), (15, 72)))


@pytest.mark.parametrize(
    ("angle", "want"),
    [
        (0, ("left", "center", 4, 0)), (22.5, ("left", "bottom", 1, 1)), (67.5, ("center", "bottom", 0, 3)), (112.5, ("right", "bottom", -1, 1)),
        (157.5, ("right", "center", -4, 0)), (202.5, ("right", "top", -1, -1)), (247.5, ("center", "top", 0, -3)), (292.5, ("left", "top", 1, -1)),
        (337.5, ("left", "center", 4, 0)), (360, ("left", "top", 1, -1)), (-361, ("left", "top", 1, -1)), (math.nan, ("left", "top", 1, -1)), (-1e-20, ("left", "top", 1, -1)),
        (-135, ("right", "top", -1, -1)),
    ],
)
def test_sectors(spark, angle, want):
    assert tuple(spark.range(1).select(geo.sector_placement(F.lit(float(angle)), 1)).first()[0]) == want


def test_map_plans(spark):
    names = lambda df: [(r["name"], r["linestyle"], r["alpha"]) for r in layer_rows(df).collect()]
    assert names(region_spec(spark, "World")) == [("Country Borders", "solid", 1.0)]
    assert names(region_spec(spark, "US")) == [("US State Borders", "dash", 0.5), ("Country Borders", "solid", 1.0)]
    assert names(region_spec(spark, "CUS")) == [("US State Borders", "solid", 1.0)]
    with pytest.raises(ValueError):
        region_spec(spark, "Mars")
    points = spark.createDataFrame([(-84.0, 41.0), (-83.0, 42.0), (-82.0, 43.0)], "LON double, LAT double")
    spec = map_spec(points).first()
    assert (spec.xmin, spec.xmax, spec.ymin, spec.ymax) == pytest.approx((-84.6, -81.4, 40.8, 43.2))
    assert names(map_spec(points)) == [("NHS Roads", "solid", 0.5), ("US State Borders", "solid", 1.0)]
    assert names(map_spec(points, roads=False)) == [("US State Borders", "solid", 1.0)]
    alaska = spark.createDataFrame([(-150.0, 61.0), (-149.0, 62.0)], "LON double, LAT double")
    assert [n for n, *_ in names(map_spec(alaska, roads=False))] == ["Country Borders"]
    assert [n for n, *_ in names(map_spec(alaska, roads=False, us_borders_abroad=True))] == ["US State Borders", "Country Borders"]
    assert map_spec(points.limit(1)).count() == 0
