from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from placewise.functions.geometry import mercator
from placewise.operators import polylines, rollup
from placewise.operators.boxes import points_in_boxes
from placewise.plans import render
from placewise.plans.mapspec import region_spec
from placewise.sources import catalog, raw
from placewise.sources.schemas import TABLES
from placewise.streaming import points as streaming


def test_catalog_round_trip(spark, tmp_path):
    for name, schema in TABLES.items():
        empty = spark.createDataFrame([], schema)
        catalog.write_table(empty, name, str(tmp_path))
        assert getattr(catalog, name)(spark, str(tmp_path)).schema.simpleString() == empty.schema.simpleString()
    catalog.register_views(spark, str(tmp_path), list(TABLES))
    assert spark.sql("SELECT NAME FROM usplace WHERE STFIP = 37").count() == 0
    with pytest.raises(ValueError):
        catalog.write_table(spark.range(1), "uscsa", str(tmp_path))
    with pytest.raises(FileNotFoundError, match="nhsroads"):
        catalog.nhsroads(spark, str(tmp_path))
    with pytest.raises(ValueError):
        catalog.table(spark, "nothing", str(tmp_path))


def test_filter_reaches_the_scan(spark, tmp_path):
    catalog.write_table(spark.createDataFrame([], TABLES["usplace"]), "usplace", str(tmp_path))
    plan = catalog.usplace(spark, str(tmp_path)).where((F.col("STFIP") == 37) & (F.col("POP") > 100_000)).select("NAME")._jdf.queryExecution().toString()
    assert "GreaterThan(POP,100000)" in plan and "ReadSchema: struct<STFIP:int,NAME:string,POP:bigint>" in plan


def test_rollups(spark):
    z = spark.createDataFrame([(27601, 35.0, -78.0, 10, 1.0, 0.5, True), (27602, 37.0, -79.0, 30, 2.0, 0.5, True), (501, 1.0, 2.0, 0, 1.0, 1.0, False), (502, 3.0, 4.0, 0, 1.0, 1.0, False)], TABLES["uszcta5"])
    got = {r["ZCTA3"]: r for r in rollup.zcta3(z).collect()}
    assert (got[276].LAT, got[276].LON, got[276].POP, got[276].ALAND, got[276].ISCUS) == (36.5, -78.75, 40, 3.0, True)
    assert (got[5].LAT, got[5].LON, got[5].POP, got[5].ISCUS) == (2.0, 3.0, 0, False)  # without people the plain mean
    county = spark.createDataFrame([(1, 1, "a", "AL", 30.0, -80.0, 5, 1.0, 1.0, 7), (1, 2, "b", "AL", 32.0, -80.0, 15, 1.0, 1.0, 7), (1, 3, "c", "AL", 0.0, 0.0, 5, 1.0, 1.0, None)], TABLES["uscounty"])
    areas = rollup.cbsa(county.drop("NAME"), spark.createDataFrame([(7, "Seven", "Metro", 9)], "CBSA int, NAME string, M_MSA string, CSA int"))
    assert [(r.CBSA, r.LAT, r.POP, r.NAME, r.CSA) for r in areas.collect()] == [(7, 31.5, 20, "Seven", 9)]
    combined = rollup.csa(areas.drop("NAME"), spark.createDataFrame([(9, "Nine")], "CSA int, NAME string")).first()
    assert (combined.CSA, combined.POP, combined.NAME) == (9, 20, "Nine")


def test_raw_sources(spark, tmp_path):
    (tmp_path / "gaz.txt").write_text("GEOID\tALAND\tLAT\tLON \n1\t5.5\t35.0\t-80.0 \n2\t6.5\t60.0\t-150.0\n")
    (tmp_path / "pop.csv").write_text("GEOID,POP\n1,100\n2,200\n")
    (tmp_path / "list.csv").write_text("GEOID,CBSA\n1,77\n")
    areas = raw.read_gazetteer(spark, str(tmp_path / "gaz.txt"), "id int, ALAND double, LAT double, LON double")
    people = raw.read_population_centres(spark, str(tmp_path / "pop.csv"), "id int, POP bigint")
    members = raw.read_delineation(spark, str(tmp_path / "list.csv"), "id int, CBSA int")
    got = {r["id"]: r for r in raw.assemble(areas, people, ["id"], members, flag=True).collect()}
    assert (got[1].POP, got[1].CBSA, got[1].ISCUS) == (100, 77, True) and (got[2].CBSA, got[2].ISCUS) == (None, False)


def test_geojson_lines(spark, tmp_path):
    geometry = [("LineString", [[0, 1], [2, 3]]), ("Polygon", [[[0, 0], [1, 0], [0, 0]], [[5, 5], [6, 6]]]), ("MultiPolygon", [[[[7, 7], [8, 8]]]])]
    (tmp_path / "x.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": k, "coordinates": c}} for k, c in geometry]}))
    rows = [tuple(r) for r in raw.read_geojson_lines(spark, str(tmp_path / "x.json"), "countries").orderBy("part_id", "seq").collect()]
    assert [r[1] for r in rows] == [0, 0, 1, 1, 1, 2, 2, 3, 3] and rows[0] == ("countries", 0, 0, 0.0, 1.0)


def test_polyline_parts(spark):
    v = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, math.nan, math.nan), ("a", 3, -100.0, 30.0), ("b", 1, 5.0, 5.0)], "layer string, seq int, lon double, lat double")
    parts = polylines.split_parts(v)
    assert sorted((r.layer, r.part_id, r.seq) for r in parts.collect()) == [("a", 0, 1), ("a", 1, 3), ("b", 0, 1)]
    assert [r.seq for r in polylines.clip(parts, ((-125, -65), (24, 50))).collect()] == [3]


def test_long_layers_are_numbered_in_blocks(spark):
    rows = [(None if k % 3 == 0 else "a", k, math.nan if k % 7 == 0 else float(k), None if k % 11 == 0 else 1.0) for k in range(200)]
    v = spark.createDataFrame(rows, "layer string, seq int, lon double, lat double")
    want, part = [], {}
    for layer, k, lon, lat in rows:
        if math.isnan(lon) or lat is None:
            part[layer] = part.get(layer, 0) + 1
        else:
            want.append((k, part.get(layer, 0)))
    for block in (8, 1 << 16):
        assert sorted((r.seq, r.part_id) for r in polylines.split_parts(v, block=block).collect()) == sorted(want)


def test_lines_are_cut_at_the_limits(spark):
    # leaves and comes back, crosses with both ends outside, touches a corner, lies on a side, a lone vertex
    lines = {0: [(1, 1), (1, 5), (2, 5), (2, 1)], 1: [(-1, 1), (4, 1)], 2: [(-1, 1), (1, -1)], 3: [(0, 0), (0, 3)], 4: [(1, 1)], 5: [(5, 5), (6, 6)], 6: [(1, 1), (3, 3), (1, 2)]}
    rows = [("a", p, i, float(x), float(y)) for p, line in lines.items() for i, (x, y) in enumerate(line)]
    got = polylines.clip_lines(spark.createDataFrame(rows, "layer string, part_id int, seq int, lon double, lat double"), ((0, 3), (0, 3))).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.part_id, r.piece, r.seq)):
        found.setdefault((r.part_id, r.piece), []).append((r.lon, r.lat))
    assert found == {(0, 0): [(1, 1), (1, 3)], (0, 1): [(2, 3), (2, 1)], (1, 0): [(0, 1), (3, 1)], (3, 0): [(0, 0), (0, 3)], (6, 0): [(1, 1), (3, 3), (1, 2)]}


def test_points_in_a_table_of_boxes(spark):
    points = [(i, float(i * 37 % 400 - 200), float(i * 53 % 200 - 100)) for i in range(300)] + [(900, math.nan, 0.0), (901, None, 0.0), (902, math.inf, 0.0)]
    table = [("all", -1e9, 1e9, -1e9, 1e9), ("small", -3.0, 4.0, -3.0, 4.0), ("none", 5.0, -5.0, 0.0, 1.0), ("nan", 0.0, math.nan, 0.0, 1.0), (None, 10.0, 30.0, -90.0, 90.0), ("open", None, 1.0, 0.0, 1.0)]
    got = points_in_boxes(spark.createDataFrame(points, "id int, LON double, LAT double"), spark.createDataFrame(table, "box string, xmin double, xmax double, ymin double, ymax double"))
    want = [(i, b) for i, x, y in points if x is not None and math.isfinite(x) for b, x0, x1, y0, y1 in table if x0 is not None and x0 <= x <= x1 and y0 <= y <= y1]
    assert sorted(((r.id, r.box) for r in got.collect()), key=str) == sorted(want, key=str)


def test_mercator(spark):
    m = spark.createDataFrame([(0.0, 0.0), (180.0, 45.0)], "lon double, lat double").select(mercator(F.col("lon"), F.col("lat")).alias("m")).collect()
    assert abs(m[0].m.x) < 1e-6 and abs(m[0].m.y) < 1e-6
    assert m[1].m.x == pytest.approx(20037508.342789244) and m[1].m.y == pytest.approx(5621521.486192066)


def test_render(spark):
    spec = region_spec(spark, "US").first().asDict(recursive=True)
    out = render.svg(spec, {"Country Borders": [[(-100, 30), (-90, 40)]]}, [{"lon": -80, "lat": 35, "name": "A & B", "halign": "right", "valign": "top"}], "T")
    assert "<polyline" in out and "A &amp; B" in out and 'text-anchor="end"' in out
    assert json.loads(render.geojson([{"lon": 1, "lat": 2, "name": "x"}]))["features"][0]["properties"] == {"name": "x"}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", -80.0, 35.0), ("2024-01-01 00:00:02", -75.0, 40.0), ("2024-01-01 00:10:00", 0.0, 0.0)], "ts string, LON double, LAT double")
    rows.select(F.to_timestamp("ts").alias("ts"), "LON", "LAT").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, LON double, LAT double").parquet(str(tmp_path / "in"))
    tagged = streaming.tag_points(stream).writeStream.format("memory").queryName("tagged").trigger(availableNow=True).start()
    tagged.awaitTermination(60)
    assert sorted(r.region for r in spark.table("tagged").collect()) == ["CUS", "CUS", "World"]
    boxes = streaming.windowed_extent(stream, "ts", "5 minutes", "1 minute").writeStream.outputMode("append").format("memory").queryName("boxes").trigger(availableNow=True).start()
    boxes.awaitTermination(60)
    assert [(r.xmin, r.xmax) for r in spark.table("boxes").collect()] == [(-80.0, -75.0)]
    seen = []
    labels = streaming.label_batches(stream.withColumns({"g": F.lit(1), "id": F.col("ts")}), lambda df, _: seen.append(df.count()), x="LON", y="LAT")
    labels.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert seen == [3]
