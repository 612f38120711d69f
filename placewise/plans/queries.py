"""The registered queries: every operator over the test tables, with equivalent SQL.

The tables hold no places, so coordinates, state symbols and populations are made from customer keys by plain
expressions that both engines evaluate alike; embeddings give point sets in general position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions import geometry as geo
from placewise.functions.codes import STATE_FIPS, fips_table, state_to_fips, states_to_fips
from placewise.operators import labels, neighbors, polylines, rollup
from placewise.operators.bbox import extent
from placewise.plans.mapspec import layer_rows, map_spec, region_spec
from placewise.sources.catalog import column_table
from placewise.sources.raw import assemble

Query = Callable[[SparkSession, str], DataFrame]
SYMBOLS = list(STATE_FIPS)
_SPARK: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f: Query) -> Query:
        _SPARK[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs, in both languages


def geo_customer(spark: SparkSession, sf_dir: str, continental: bool = False) -> DataFrame:
    """Customers as places; continental: all within the continental U.S. box."""
    return as_places(read(spark, sf_dir, "customer"), continental)


def as_places(customers: DataFrame, continental: bool = False) -> DataFrame:
    a, b, c, d = (60001, 125, 26001, 24) if continental else (360001, 180, 180001, -90)
    key = F.col("c_custkey")
    symbols = F.array(*map(F.lit, SYMBOLS))
    return customers.select(
        key.alias("id"), F.col("c_name").alias("NAME"), F.element_at(symbols, (key % len(SYMBOLS) + 1).cast("int")).alias("ST"),
        (((key * 104729) % c).cast("double") / F.lit(1e3) + F.lit(float(d))).alias("LAT"), (((key * 7919) % a).cast("double") / F.lit(1e3) - F.lit(float(b))).alias("LON"),
        F.abs(F.col("c_acctbal").cast("bigint")).alias("POP"), (key % 1000).cast("double").alias("ALAND"), (key % 10).cast("double").alias("AWATER"),
        F.col("c_nationkey").alias("nation"),
    )


def _geo(continental: bool = False) -> str:
    a, b, c, d = (60001, 125, 26001, 24) if continental else (360001, 180, 180001, -90)
    symbols = ", ".join(f"'{s}'" for s in SYMBOLS)
    return f"""geo AS (SELECT c_custkey AS id, c_name AS NAME, [{symbols}][CAST(c_custkey % {len(SYMBOLS)} AS INT) + 1] AS ST,
  CAST((c_custkey * 104729) % {c} AS DOUBLE) / 1e3 + {d}e0 AS LAT, CAST((c_custkey * 7919) % {a} AS DOUBLE) / 1e3 - {b}e0 AS LON,
  abs(CAST(trunc(c_acctbal) AS BIGINT)) AS POP, CAST(c_custkey % 1000 AS DOUBLE) AS ALAND, CAST(c_custkey % 10 AS DOUBLE) AS AWATER, c_nationkey AS nation FROM customer)"""


_FIPS = "fips(ST, STFIP) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in STATE_FIPS.items()) + ")"


def points2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two dimensions of the embeddings, grouped by label."""
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_PTS = "pts AS (SELECT label AS g, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_EDGES = """pairs AS (SELECT a.g, a.id AS i, b.id AS j, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM pts a JOIN pts b ON a.g = b.g AND a.id < b.id),
seen AS (SELECT p.g, p.i, p.j, (xj - xi) * (d.y - yi) - (yj - yi) * (d.x - xi) AS cr, (xi - d.x) * (xj - d.x) + (yi - d.y) * (yj - d.y) AS dt
  FROM pairs p LEFT JOIN pts d ON d.g = p.g AND d.id <> p.i AND d.id <> p.j),
edges AS (SELECT g, i, j FROM seen GROUP BY g, i, j
  HAVING count(*) FILTER (cr = 0 AND dt < 0) = 0
  AND coalesce(min(CASE WHEN cr > 0 THEN dt / cr END) + min(CASE WHEN cr < 0 THEN -dt / cr END) > 0, TRUE)),
near AS (SELECT e.*, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS d, degrees(atan2(q.y - p.y, q.x - p.x)) AS ang
  FROM (SELECT g, i, j FROM edges UNION ALL SELECT g, j, i FROM edges) e JOIN pts p ON p.g = e.g AND p.id = e.i JOIN pts q ON q.g = e.g AND q.id = e.j),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY d, j) AS rn FROM near),
apart AS (SELECT *, coalesce(d2 IS NULL OR d2 > 1.5e0 * d1 OR coalesce(d3 > 1.5e0 * (d1 + d2), FALSE), TRUE) AS isolated FROM
  (SELECT g, i, max(CASE WHEN rn = 1 THEN d END) AS d1, max(CASE WHEN rn = 2 THEN d END) AS d2, max(CASE WHEN rn = 3 THEN d END) AS d3, max(CASE WHEN rn = 1 THEN ang END) AS nearest FROM ranked GROUP BY g, i)),
gaps AS (SELECT g, i, ang, coalesce(lead(ang) OVER (PARTITION BY g, i ORDER BY ang, j) - ang, (min(ang) OVER (PARTITION BY g, i) + 180) + (180 - max(ang) OVER (PARTITION BY g, i))) AS gap FROM ranked),
widest AS (SELECT g, i, ang, gap FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY gap DESC, ang) AS k FROM gaps) WHERE k = 1)"""


def _sector(angle: str, d: str) -> str:
    t = f"(CASE WHEN {angle} < 0 THEN {angle} + 360 ELSE {angle} END)"
    lines = [f"WHEN ({t} >= 0 AND {t} < 22.5e0) OR ({t} >= 337.5e0 AND {t} < 360) THEN {{'h': 'left', 'v': 'center', 'x': {d} + 3e0, 'y': 0e0}}"]
    for i, (h, v, a, b) in enumerate(geo.SECTORS):
        x = "0e0" if not a else f"{'-' if a < 0 else ''}({d}{' + 3e0' if not b else ''})"
        y = "0e0" if not b else f"{'-' if b < 0 else ''}({d}{' + 2e0' if not a else ''})"
        lines.append(f"WHEN {t} >= {22.5 + 45 * i}e0 AND {t} < {67.5 + 45 * i}e0 THEN {{'h': '{h}', 'v': '{v}', 'x': {x}, 'y': {y}}}")
    return f"CASE {' '.join(lines)} ELSE {{'h': 'left', 'v': 'top', 'x': {d}, 'y': -({d})}} END"


_SPREAD = "s.h AS halign, s.v AS valign, s.x AS hoffset, s.y AS voffset"


def _boxes(xexpand: str, yexpand: str, source: str = "geo", x: str = "LON", y: str = "LAT", by: str = "nation") -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""raw AS (SELECT {key}min(CASE WHEN NOT isnan({x}) THEN {x} END) AS raw_xmin, max(CASE WHEN NOT isnan({x}) THEN {x} END) AS raw_xmax,
  min(CASE WHEN NOT isnan({y}) THEN {y} END) AS raw_ymin, max(CASE WHEN NOT isnan({y}) THEN {y} END) AS raw_ymax FROM {source} {group}),
moved AS (SELECT *, raw_xmin - (raw_xmax - raw_xmin) * {xexpand} AS w, raw_xmax + (raw_xmax - raw_xmin) * {xexpand} AS e,
  raw_ymin - (raw_ymax - raw_ymin) * {yexpand} AS s, raw_ymax + (raw_ymax - raw_ymin) * {yexpand} AS n FROM raw),
boxes AS (SELECT {key}raw_xmin, raw_xmax, raw_ymin, raw_ymax, CASE WHEN w < -180 THEN -180e0 ELSE w END AS xmin, CASE WHEN e > 180 THEN 180e0 ELSE e END AS xmax,
  CASE WHEN s <= -90 THEN greatest(-90e0 + 1.4901161193847656e-8, raw_ymin) ELSE s END AS ymin, CASE WHEN n >= 90 THEN least(90e0 - 1.4901161193847656e-8, raw_ymax) ELSE n END AS ymax FROM moved)"""


_PRESETS = "presets(region, pxmin, pxmax, pymin, pymax) AS (VALUES ('World', -180e0, 180e0, -75e0, 75e0), ('US', -180e0, -65e0, 15e0, 72e0), ('CUS', -125e0, -65e0, 24e0, 50e0))"

# ---- tables and codes


@_query(f"WITH {_geo()}, {_FIPS} SELECT STFIP, CAST(id AS INT) AS PLFIP, NAME, ST, LAT, LON, POP, ALAND, AWATER FROM geo JOIN fips USING (ST)")
def place_scan(spark, d):
    return geo_customer(spark, d).select(state_to_fips(F.col("ST")).alias("STFIP"), F.col("id").cast("int").alias("PLFIP"), "NAME", "ST", "LAT", "LON", "POP", "ALAND", "AWATER")


@_query(f"WITH {_geo()} SELECT id, NAME, ST, POP FROM geo WHERE ST = 'NC' AND POP > 1000")
def place_filter_state_pop(spark, d):
    places = geo_customer(spark, d).withColumn("STFIP", state_to_fips(F.col("ST")))
    return places.where((F.col("STFIP") == state_to_fips("NC")) & (F.col("POP") > 1000)).select("id", "NAME", "ST", "POP")


@_query(f"WITH {_geo()} SELECT LON, LAT, NAME FROM geo")
def place_project(spark, d):
    return geo_customer(spark, d).select("LON", "LAT", "NAME")


@_query("SELECT * FROM (VALUES (1, 'n_nationkey', 'int'), (2, 'n_name', 'string'), (3, 'n_regionkey', 'int')) t(position, name, type)")
def table_columns(spark, d):
    return column_table(read(spark, d, "nation"))


@_query(f"WITH {_geo()}, {_FIPS} SELECT id, ST, STFIP FROM geo JOIN fips USING (ST)")
def state_fips_lookup(spark, d):
    return geo_customer(spark, d).select("id", "ST", state_to_fips(F.col("ST")).alias("STFIP"))


@_query("SELECT c_custkey AS id, 37 AS first, CAST(NULL AS VARCHAR) AS second, 36 AS third FROM customer")
def state_fips_array(spark, d):
    codes = states_to_fips(F.array(F.lit("NC"), F.lit("XX"), F.lit("NY")))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), codes[0].alias("first"), codes[1].cast("string").alias("second"), codes[2].alias("third"))


@_query(f"WITH {_FIPS} SELECT ST, STFIP FROM fips")
def state_fips_dimension(spark, d):
    return fips_table(spark)


@_query(f"WITH {_geo()}, {_FIPS} SELECT id, g.ST FROM (SELECT id, CASE WHEN id % 10 = 0 THEN 'XX' ELSE ST END AS ST FROM geo) g WHERE NOT EXISTS (SELECT 1 FROM fips WHERE fips.ST = g.ST)")
def state_fips_unknown(spark, d):
    marked = geo_customer(spark, d).select("id", F.when(F.col("id") % 10 == 0, "XX").otherwise(F.col("ST")).alias("ST"))
    return marked.where(state_to_fips(F.col("ST"), strict=False).isNull())


# ---- boxes


@_query(f"WITH {_geo()}, {_boxes('0e0', '0e0', by='')} SELECT raw_xmin, raw_xmax, raw_ymin, raw_ymax FROM boxes")
def bbox_raw(spark, d):
    return extent(geo_customer(spark, d)).select("raw_xmin", "raw_xmax", "raw_ymin", "raw_ymax")


@_query(f"WITH {_geo(True)}, {_boxes('0.3e0', '0.1e0', by='')} SELECT * FROM boxes")
def bbox_expanded(spark, d):
    return extent(geo_customer(spark, d, True), xexpand=0.3, yexpand=0.1)


@_query(f"WITH {_geo()}, {_boxes('0.1e0', '0.1e0')} SELECT * FROM boxes")
def bbox_by_nation(spark, d):
    return extent(geo_customer(spark, d), by=["nation"], xexpand=0.1, yexpand=0.1)


@_query(f"WITH {_geo()}, holes AS (SELECT nation, CASE WHEN id % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE LON END AS LON, CASE WHEN id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE LAT END AS LAT FROM geo), {_boxes('0e0', '0e0', 'holes')} SELECT nation, raw_xmin, raw_xmax, raw_ymin, raw_ymax FROM boxes")
def bbox_nan_skip(spark, d):
    holes = geo_customer(spark, d).withColumns({"LON": F.when(F.col("id") % 10 == 0, float("nan")).otherwise(F.col("LON")), "LAT": F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("LAT"))})
    return extent(holes, by=["nation"]).select("nation", "raw_xmin", "raw_xmax", "raw_ymin", "raw_ymax")


@_query(f"WITH {_geo()}, {_boxes('0.5e0', '0e0')} SELECT nation, xmin, xmax FROM boxes")
def bbox_clamp_lon(spark, d):
    return extent(geo_customer(spark, d), by=["nation"], xexpand=0.5).select("nation", "xmin", "xmax")


@_query(f"WITH {_geo()}, {_boxes('0e0', '0.5e0')} SELECT nation, ymin, ymax FROM boxes")
def bbox_clamp_pole(spark, d):
    return extent(geo_customer(spark, d), by=["nation"], yexpand=0.5).select("nation", "ymin", "ymax")


@_query(f"WITH {_geo()} SELECT id, LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50 AS inside FROM geo")
def point_in_bbox(spark, d):
    return geo_customer(spark, d).select("id", geo.point_in_bbox(F.col("LON"), F.col("LAT"), geo.box(geo.CUS_LIMITS)).alias("inside"))


@_query(f"WITH {_geo()} SELECT id, NAME, LON, LAT FROM geo WHERE LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50")
def filter_cus(spark, d):
    return geo_customer(spark, d).where(geo.point_in_bbox(F.col("LON"), F.col("LAT"), geo.CUS_LIMITS)).select("id", "NAME", "LON", "LAT")


@_query(f"WITH {_geo()} SELECT id, LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50 AS ISCUS FROM geo")
def iscus_flag(spark, d):
    return geo_customer(spark, d).select("id", geo.is_continental(F.col("LON"), F.col("LAT")).alias("ISCUS"))


@_query(f"WITH {_geo()} SELECT id, CASE WHEN LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50 THEN 'CUS' WHEN LON BETWEEN -180 AND -65 AND LAT BETWEEN 15 AND 72 THEN 'US' WHEN LON BETWEEN -180 AND 180 AND LAT BETWEEN -75 AND 75 THEN 'World' END AS region FROM geo")
def region_tag(spark, d):
    return geo_customer(spark, d).select("id", geo.region_tag(F.col("LON"), F.col("LAT")).alias("region"))


@_query(f"WITH {_geo()}, {_PRESETS}, {_boxes('0e0', '0e0')} SELECT nation, region, xmin >= pxmin AND xmax <= pxmax AND ymin >= pymin AND ymax <= pymax AS inside FROM boxes, presets")
def bbox_in_bbox(spark, d):
    boxes = extent(geo_customer(spark, d), by=["nation"])
    inner = geo.box(**{n: F.col(n) for n in ("xmin", "xmax", "ymin", "ymax")})
    every = F.array(*[F.struct(F.lit(k).alias("region"), geo.bbox_in_bbox(inner, geo.box(v)).alias("inside")) for k, v in geo.REGIONS.items()])
    return boxes.select("nation", F.inline(every))


@_query(f"WITH {_geo()}, {_PRESETS} SELECT region, count(*) AS n FROM geo JOIN presets ON LON BETWEEN pxmin AND pxmax AND LAT BETWEEN pymin AND pymax GROUP BY region")
def points_in_boxes(spark, d):
    # three boxes: a row's regions are an array, no join
    held = F.array_compact(F.array(*[F.when(geo.point_in_bbox(F.col("LON"), F.col("LAT"), v), k) for k, v in geo.REGIONS.items()]))
    return geo_customer(spark, d).select(F.explode(held).alias("region")).groupBy("region").agg(F.count("*").alias("n"))


@_query(f"WITH {_PRESETS} SELECT region, pxmin AS xmin, pxmax AS xmax, pymin AS ymin, pymax AS ymax FROM presets")
def region_presets(spark, d):
    return geo.region_presets(spark)


# ---- map plans

_STYLES = """layer(seq0, name, color, width) AS (VALUES (1, 'NHS Roads', 'grey', 0.5e0), (2, 'US State Borders', 'blue', 0.75e0), (3, 'Country Borders', 'blue', 0.75e0)),
drawn AS (SELECT p.*, l.* FROM plan p, layer l WHERE (l.seq0 = 1 AND roads) OR (l.seq0 = 2 AND us_borders) OR (l.seq0 = 3 AND country_borders))"""
_STYLED = "row_number() OVER (PARTITION BY {key} ORDER BY seq0) AS seq, name, color, width, CASE WHEN seq0 = 1 OR (seq0 = 2 AND country_borders AND us_borders) THEN 0.5e0 ELSE 1e0 END AS alpha, CASE WHEN seq0 = 2 AND country_borders AND us_borders THEN 'dash' ELSE 'solid' END AS linestyle"


@_query(f"WITH {_PRESETS}, plan AS (SELECT region, region <> 'CUS' AS country_borders, region <> 'World' AS us_borders, abs(pymax - pymin) <= 2.5 AS roads FROM presets), {_STYLES} SELECT region, CAST(seq AS INT) AS seq, name, color, width, alpha, linestyle FROM (SELECT region, {_STYLED.format(key='region')} FROM drawn)")
def map_layers_region(spark, d):
    return layer_rows(region_spec(spark)).select("region", "seq", "name", "color", "width", "alpha", "linestyle")


_PLAN = "plan AS (SELECT b.*, NOT home AS country_borders, home AS us_borders, abs(ymax - ymin) <= 2.5 AS roads FROM (SELECT *, raw_xmin >= -125 AND raw_xmax <= -65 AND raw_ymin >= 24 AND raw_ymax <= 50 AS home FROM boxes) b)"


@_query(f"WITH {_geo(True)}, {_boxes('0.3e0', '0.1e0')}, {_PLAN}, {_STYLES} SELECT nation, xmin, xmax, ymin, ymax, CAST(seq AS INT) AS seq, name, color, width, alpha, linestyle FROM (SELECT nation, xmin, xmax, ymin, ymax, {_STYLED.format(key='nation')} FROM drawn)")
def map_layers_points(spark, d):
    return layer_rows(map_spec(geo_customer(spark, d, True), by=["nation"])).select("nation", "xmin", "xmax", "ymin", "ymax", "seq", "name", "color", "width", "alpha", "linestyle")


@_query(f"WITH {_geo()}, {_boxes('0.3e0', '0.1e0')}, {_PLAN} SELECT nation, country_borders, us_borders, roads FROM plan")
def map_flags_world(spark, d):
    return map_spec(geo_customer(spark, d), by=["nation"]).select("nation", "country_borders", "us_borders", "roads")


# ---- directions, neighbours, labels


@_query(f"WITH {_PTS} SELECT a.g, a.id AS i, b.id AS j, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM pts a JOIN pts b ON b.id = a.id + 10 AND b.g = a.g")
def planar_distance(spark, d):
    return _paired(spark, d).select("g", "i", "j", geo.planar_distance(F.col("x"), F.col("y"), F.col("xj"), F.col("yj")).alias("d"))


@_query(f"WITH {_PTS} SELECT a.g, a.id AS i, b.id AS j, round(degrees(atan2(b.y - a.y, b.x - a.x)), 9) AS ang FROM pts a JOIN pts b ON b.id = a.id + 10 AND b.g = a.g")
def bearing(spark, d):
    return _paired(spark, d).select("g", "i", "j", F.round(geo.bearing(F.col("x"), F.col("y"), F.col("xj"), F.col("yj")), 9).alias("ang"))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    a = points2d(spark, d).withColumnRenamed("id", "i")
    b = points2d(spark, d).select("g", F.col("id").alias("j"), (F.col("id") - 10).alias("i"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    return a.join(b, ["g", "i"])


@_query(f"SELECT angle, d, {_SPREAD} FROM (SELECT angle, d, {_sector('angle', 'd')} AS s FROM (SELECT CAST(r.range AS DOUBLE) * 7.5e0 - 405e0 AS angle FROM range(109) r UNION ALL SELECT -1e-20), (VALUES (1e0), (2e0)) t(d))")
def sector_placement(spark, d):
    angles = spark.range(109).select((F.col("id") * 7.5 - 405).cast("double").alias("angle")).unionByName(spark.createDataFrame([(-1e-20,)], "angle double"))
    both = angles.withColumn("d", F.explode(F.array(F.lit(1.0), F.lit(2.0))))
    return both.withColumn("_p", geo.sector_placement(F.col("angle"), F.col("d"))).select("angle", "d", "_p.*")


@_query(f"WITH {_PTS}, {_EDGES} SELECT g, i, j FROM edges")
def delaunay_edges(spark, d):
    return neighbors.delaunay_edges(points2d(spark, d))


@_query(f"WITH {_PTS}, {_EDGES} SELECT e.g, e.i, e.j, f.j AS k FROM edges e JOIN edges f ON e.g = f.g AND e.i = f.i AND e.j < f.j JOIN edges h ON h.g = e.g AND h.i = e.j AND h.j = f.j JOIN pts a ON a.id = e.i AND a.g = e.g JOIN pts b ON b.id = e.j AND b.g = e.g JOIN pts c ON c.id = f.j AND c.g = e.g WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.g = e.g AND p.id NOT IN (a.id, b.id, c.id) AND sign((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) = sign((c.x - b.x) * (p.y - b.y) - (c.y - b.y) * (p.x - b.x)) AND sign((c.x - b.x) * (p.y - b.y) - (c.y - b.y) * (p.x - b.x)) = sign((a.x - c.x) * (p.y - c.y) - (a.y - c.y) * (p.x - c.x)))")
def delaunay_triangles(spark, d):
    return neighbors.delaunay_triangles(points2d(spark, d))


@_query(f"WITH {_PTS}, {_EDGES} SELECT g, i, j, d, CAST(rn AS INT) AS rn FROM ranked")
def neighbors_ranked(spark, d):
    return neighbors.neighbours(points2d(spark, d)).select("g", "i", "j", "d", "rn")


@_query(f"WITH {_PTS}, {_EDGES} SELECT g, i, d1, d2, d3, isolated FROM apart")
def isolation_test(spark, d):
    return labels.isolation(neighbors.neighbours(points2d(spark, d))).select("g", "i", "d1", "d2", "d3", "isolated")


@_query(f"WITH {_PTS}, {_EDGES} SELECT g, i, round(ang, 6) AS ang, round(gap, 6) AS gap FROM gaps")
def angular_gaps(spark, d):
    return labels.gaps(neighbors.neighbours(points2d(spark, d))).select("g", "i", F.round("ang", 6).alias("ang"), F.round("gap", 6).alias("gap"))


@_query(f"WITH {_PTS}, {_EDGES} SELECT g, i, round(ang, 6) AS ang, round(gap, 6) AS gap FROM widest")
def widest_gap(spark, d):
    return labels.widest_gap(neighbors.neighbours(points2d(spark, d))).select("g", "i", F.round("ang", 6).alias("ang"), F.round("gap", 6).alias("gap"))


def _first(spark: SparkSession, d: str, n: int) -> DataFrame:
    from pyspark.sql import Window

    return points2d(spark, d).withColumn("_k", F.row_number().over(Window.partitionBy("g").orderBy("id"))).where(F.col("_k") <= n).drop("_k")


@_query(f"WITH {_PTS} SELECT g, min(id) AS id, 'left' AS halign, 'bottom' AS valign, 1e0 AS hoffset, 1e0 AS voffset FROM pts GROUP BY g")
def label_single(spark, d):
    return labels.place_labels(_first(spark, d, 1))


@_query(f"WITH {_PTS}, two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS k FROM pts) WHERE k <= 2), turned AS (SELECT a.g, unnest([a.id, b.id]) AS id, unnest([degrees(atan2(b.y - a.y, b.x - a.x)), degrees(atan2(b.y - a.y, b.x - a.x)) - 180]) AS angle FROM two a JOIN two b ON a.g = b.g AND a.k = 1 AND b.k = 2) SELECT g, id, {_SPREAD} FROM (SELECT g, id, {_sector('angle', '1e0')} AS s FROM turned)")
def label_pair(spark, d):
    return labels.place_labels(_first(spark, d, 2))


_LABELS = f"WITH {_PTS}, {_EDGES}, turned AS (SELECT g, a.i AS id, CASE WHEN isolated THEN nearest - 180 ELSE w.ang + w.gap / 2 END AS angle FROM apart a JOIN widest w USING (g, i)) SELECT g, id, {_SPREAD} FROM (SELECT g, id, {_sector('angle', '1e0')} AS s FROM turned)"


@_query(_LABELS)
def label_placement(spark, d):
    return labels.place_labels(points2d(spark, d))


# ---- roll-ups and assembly

_CENTRE = "round(coalesce(sum(LAT * POP) / nullif(sum(POP), 0), avg(LAT)), 6) AS LAT, round(coalesce(sum(LON * POP) / nullif(sum(POP), 0), avg(LON)), 6) AS LON"
_SUMS = "CAST(sum(POP) AS BIGINT) AS POP, sum(ALAND) AS ALAND, sum(AWATER) AS AWATER"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"LAT": F.round("LAT", 6), "LON": F.round("LON", 6)})


@_query(f"WITH {_geo()} SELECT *, LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50 AS ISCUS FROM (SELECT CAST(id // 100 AS INT) AS ZCTA3, {_CENTRE}, {_SUMS} FROM geo GROUP BY 1)")
def zcta3_rollup(spark, d):
    return _rounded(rollup.zcta3(geo_customer(spark, d).withColumnRenamed("id", "ZCTA5")))


_CBSA = f"cbsa AS (SELECT nation AS CBSA, coalesce(sum(LAT * POP) / nullif(sum(POP), 0), avg(LAT)) AS LAT, coalesce(sum(LON * POP) / nullif(sum(POP), 0), avg(LON)) AS LON, {_SUMS} FROM geo GROUP BY 1)"


def _cbsa(spark: SparkSession, d: str) -> DataFrame:
    county = geo_customer(spark, d).drop("NAME").withColumnRenamed("nation", "CBSA")
    delineation = read(spark, d, "nation").select(F.col("n_nationkey").alias("CBSA"), F.col("n_name").alias("NAME"), F.lit("Metro").alias("M_MSA"), F.col("n_regionkey").alias("CSA"))
    return rollup.cbsa(county, delineation)


@_query(f"WITH {_geo()}, {_CBSA} SELECT CBSA, n_name AS NAME, round(LAT, 6) AS LAT, round(LON, 6) AS LON, POP, ALAND, AWATER, 'Metro' AS M_MSA, n_regionkey AS CSA, LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50 AS ISCUS FROM cbsa LEFT JOIN nation ON n_nationkey = CBSA")
def cbsa_rollup(spark, d):
    return _rounded(_cbsa(spark, d)).select("CBSA", "NAME", "LAT", "LON", "POP", "ALAND", "AWATER", "M_MSA", "CSA", "ISCUS")


@_query(f"WITH {_geo()}, {_CBSA} SELECT CSA, r_name AS NAME, LAT, LON, POP, ALAND, AWATER FROM (SELECT n_regionkey AS CSA, {_CENTRE}, {_SUMS} FROM cbsa JOIN nation ON n_nationkey = CBSA GROUP BY 1) LEFT JOIN region ON r_regionkey = CSA")
def csa_rollup(spark, d):
    names = read(spark, d, "region").select(F.col("r_regionkey").alias("CSA"), F.col("r_name").alias("NAME"))
    return _rounded(rollup.csa(_cbsa(spark, d).drop("NAME"), names)).select("CSA", "NAME", "LAT", "LON", "POP", "ALAND", "AWATER")


@_query(f"WITH {_geo()}, o AS (SELECT o_custkey AS id, count(*) AS orders FROM orders GROUP BY 1) SELECT id, NAME, LAT, LON, orders, CASE WHEN nation < 20 THEN nation END AS CBSA, LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50 AS ISCUS FROM geo JOIN o USING (id)")
def county_assemble(spark, d):
    places = geo_customer(spark, d)
    population = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    members = places.where("nation < 20").select("id", F.col("nation").alias("CBSA"))
    return assemble(places.select("id", "NAME", "LAT", "LON"), population, ["id"], members, flag=True)


# ---- polylines

_LINES = "lines AS (SELECT concat('n', nation) AS layer, id AS seq, CASE WHEN id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE LON END AS lon, CASE WHEN id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE LAT END AS lat FROM geo), parts AS (SELECT * FROM (SELECT layer, seq, lon, lat, sum(CASE WHEN isnan(lon) THEN 1 ELSE 0 END) OVER (PARTITION BY layer ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part_id FROM lines) WHERE NOT isnan(lon))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    hole = lambda c: F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col(c))
    return geo_customer(spark, d).select(F.concat(F.lit("n"), F.col("nation")).alias("layer"), F.col("id").alias("seq"), hole("LON").alias("lon"), hole("LAT").alias("lat"))


@_query(f"WITH {_geo()}, {_LINES} SELECT layer, CAST(part_id AS INT) AS part_id, count(*) AS vertices FROM parts GROUP BY ALL")
def polyline_parts(spark, d):
    return polylines.split_parts(_lines(spark, d)).groupBy("layer", "part_id").agg(F.count("*").alias("vertices"))


@_query(f"WITH {_geo()}, {_LINES} SELECT layer, CAST(part_id AS INT) AS part_id, seq, lon, lat FROM parts WHERE lon BETWEEN -180 AND -65 AND lat BETWEEN 15 AND 72")
def polyline_clip(spark, d):
    return polylines.clip(polylines.split_parts(_lines(spark, d)), geo.US_LIMITS)


@_query(f"WITH {_PTS}, chosen AS (SELECT g, id, x * 10 - 95 AS x, y * 5 + 37 AS y FROM pts), {_boxes('0.3e0', '0.1e0', 'chosen', 'x', 'y', 'g')}, {_PLAN}, placed AS ({_LABELS}) SELECT g, id, halign, valign, hoffset, voffset, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, round(ymin, 6) AS ymin, round(ymax, 6) AS ymax, country_borders, us_borders, roads FROM placed JOIN plan USING (g)")
def labelled_maps(spark, d):
    """The flagship: plan a map for each group of places, and place its labels."""
    chosen = points2d(spark, d)
    spec = map_spec(chosen.select("g", (F.col("x") * 10 - 95).alias("x"), (F.col("y") * 5 + 37).alias("y")), "x", "y", by=["g"])
    plan = spec.select("g", *[F.round(c, 6).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")], "country_borders", "us_borders", "roads")
    return labels.place_labels(chosen).join(plan, "g")


from placewise.plans import more_queries as _more  # noqa: E402, F401  adds its queries to these
