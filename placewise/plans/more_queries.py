"""Further registered queries: the catalog's tables and layers, raw sources, a table of boxes, streams, large point groups, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions import geometry as geo
from placewise.functions.codes import fips_table, state_to_fips
from placewise.operators import boxes, neighbors, polylines
from placewise.operators.bbox import bbox_of, extent
from placewise.plans.mapspec import region_spec
from placewise.plans.queries import _FIPS, _LINES, _SPARK, _SQL, _boxes, _geo, _lines, _query, as_places, geo_customer, read
from placewise.sources import catalog, raw
from placewise.sources.schemas import LAYERS, TABLES
from placewise.sources.scratch import scratch_dir
from placewise.streaming import points as streaming

# ---- the catalog: tables are derived, written with the checked writer, and read through their accessors

_DERIVED = {
    "STFIP": "STFIP", "PLFIP": "cast(id AS int)", "COFIP": "cast(id % 200 AS int)", "TRFIP": "cast(id % 1000 AS int)", "BGFIP": "cast(id % 10 AS int)",
    "ZCTA5": "cast(id AS int)", "ZCTA3": "cast(id % 900 AS int)", "LSAD": "cast(id % 80 AS int)", "FUNCSTAT": "CASE WHEN id % 2 = 0 THEN 'A' ELSE 'S' END",
    "CBSA": "CASE WHEN nation < 20 THEN nation END", "CSA": "CASE WHEN nation < 10 THEN nation END", "M_MSA": "CASE WHEN id % 3 = 0 THEN 'Metro' ELSE 'Micro' END",
    "ISCUS": "LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50",
}


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(",")]


def _stored(spark: SparkSession, d: str, name: str) -> str:
    """Write the table and return its data folder."""
    places = geo_customer(spark, d).withColumn("STFIP", state_to_fips(F.col("ST")))
    where = scratch_dir(spark)
    catalog.write_table(places.select(*[F.expr(_DERIVED.get(c, c)).alias(c) for c in _columns(name)]), name, where)
    return where


def _table_sql(name: str) -> str:
    return f"WITH {_geo()}, {_FIPS} SELECT {', '.join(f'{_DERIVED.get(c, c)} AS {c}' for c in _columns(name))} FROM geo JOIN fips USING (ST)"


def _catalog(name: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return getattr(catalog, name)(spark, _stored(spark, d, name))

    _SPARK[f"catalog_{name}"], _SQL[f"catalog_{name}"] = query, _table_sql(name)


for _name in TABLES:
    _catalog(_name)


@_query(f"SELECT NAME, LON, LAT, POP FROM ({_table_sql('usplace')}) WHERE STFIP = 37 AND POP > 1000 AND ISCUS IS NOT NULL")
def catalog_sql(spark, d):
    catalog.register_views(spark, _stored(spark, d, "usplace"), ["usplace"])
    return spark.sql("SELECT NAME, LON, LAT, POP FROM usplace WHERE STFIP = 37 AND POP > 1000 AND ISCUS IS NOT NULL")


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'failed to load table {n}')" for n in [*TABLES, *LAYERS]) + ") t(name, error)")
def catalog_missing(spark, d):
    """What each accessor says of a folder without its file."""
    where, rows = scratch_dir(spark), []
    for name in [*TABLES, *LAYERS]:
        try:
            getattr(catalog, name)(spark, where)
        except FileNotFoundError as e:
            rows.append((name, str(e).partition(" from ")[0]))
    return spark.createDataFrame(rows, "name string, error string")


_LAYER = "CASE CAST(substr(layer, 2) AS INT) % 3 WHEN 0 THEN 'countries' WHEN 1 THEN 'usstates' ELSE 'nhsroads' END"
_LAYERS = f"layers AS (SELECT {_LAYER} AS layer, CAST(part_id + 1000 * CAST(substr(layer, 2) AS INT) AS INT) AS part_id, CAST(seq AS INT) AS seq, lon, lat FROM parts)"


def _layers(spark: SparkSession, d: str) -> str:
    """Split lines at their breaks, write the three layers and return their data folder."""
    parts = polylines.split_parts(_lines(spark, d))
    rows = parts.select(F.expr(_LAYER).alias("layer"), F.expr("cast(part_id + 1000 * CAST(substr(layer, 2) AS INT) AS int)").alias("part_id"), F.col("seq").cast("int").alias("seq"), "lon", "lat")
    where = scratch_dir(spark)
    for name in LAYERS:
        catalog.write_table(rows.where(F.col("layer") == name), name, where)
    return where


@_query(f"WITH {_geo()}, {_LINES}, {_LAYERS} SELECT layer, part_id, seq, lon, lat FROM layers")
def catalog_layers(spark, d):
    where = _layers(spark, d)
    return catalog.countries(spark, where).unionByName(catalog.usstates(spark, where)).unionByName(catalog.nhsroads(spark, where))


_CUT = """ways AS (SELECT *, lead(lon) OVER w AS nx, lead(lat) OVER w AS ny FROM layers WHERE layer = 'usstates' WINDOW w AS (PARTITION BY part_id ORDER BY seq)),
spans AS (SELECT *, nx - lon AS dx, ny - lat AS dy FROM ways WHERE nx IS NOT NULL),
bands AS (SELECT *, CASE WHEN dx = 0 THEN CASE WHEN lon BETWEEN -180 AND -65 THEN 0e0 ELSE 2e0 END ELSE least((-180e0 - lon) / dx, (-65e0 - lon) / dx) END AS x0,
  CASE WHEN dx = 0 THEN CASE WHEN lon BETWEEN -180 AND -65 THEN 1e0 ELSE -1e0 END ELSE greatest((-180e0 - lon) / dx, (-65e0 - lon) / dx) END AS x1,
  CASE WHEN dy = 0 THEN CASE WHEN lat BETWEEN 15 AND 72 THEN 0e0 ELSE 2e0 END ELSE least((15e0 - lat) / dy, (72e0 - lat) / dy) END AS y0,
  CASE WHEN dy = 0 THEN CASE WHEN lat BETWEEN 15 AND 72 THEN 1e0 ELSE -1e0 END ELSE greatest((15e0 - lat) / dy, (72e0 - lat) / dy) END AS y1 FROM spans),
cuts AS (SELECT *, greatest(0e0, x0, y0) AS t0, least(1e0, x1, y1) AS t1 FROM bands),
begun AS (SELECT *, NOT (t0 = 0 AND coalesce(lag(t1) OVER w = 1 AND lag(t0) OVER w < 1, FALSE)) AS starts FROM cuts WINDOW w AS (PARTITION BY part_id ORDER BY seq)),
pieces AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY part_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS piece FROM begun WHERE t0 < t1),
ends AS (SELECT layer, part_id, piece, seq, 0 AS k, t0 AS t, lon, lat, nx, ny, dx, dy FROM pieces WHERE starts UNION ALL SELECT layer, part_id, piece, seq, 1, t1, lon, lat, nx, ny, dx, dy FROM pieces)
SELECT layer, part_id, piece, CAST(row_number() OVER (PARTITION BY part_id, piece ORDER BY seq, k) - 1 AS INT) AS seq,
  least(greatest(CASE WHEN t = 0 THEN lon WHEN t = 1 THEN nx ELSE lon + t * dx END, -180e0), -65e0) AS lon,
  least(greatest(CASE WHEN t = 0 THEN lat WHEN t = 1 THEN ny ELSE lat + t * dy END, 15e0), 72e0) AS lat FROM ends"""


@_query(f"WITH {_geo()}, {_LINES}, {_LAYERS}, {_CUT}")
def layer_clip(spark, d):
    """A layer's lines cut at a region's limits."""
    return polylines.clip_lines(catalog.usstates(spark, _layers(spark, d)), geo.US_LIMITS)


# ---- joins and projections


@_query(f"WITH {_geo()}, {_FIPS} SELECT id, g.ST, STFIP FROM geo g JOIN fips USING (ST)")
def state_fips_join(spark, d):
    """The codes as a dimension table of 56 rows."""
    return geo_customer(spark, d).select("id", "ST").join(F.broadcast(fips_table(spark)), "ST").select("id", "ST", "STFIP")


@_query(f"WITH {_geo()}, home AS (SELECT nation, LON / 3 AS LON, LAT / 3 AS LAT FROM geo), {_boxes('0e0', '0e0', 'home', by='nation')} SELECT b.nation AS box, count(*) AS n, min(id) AS first FROM geo JOIN boxes b ON LON BETWEEN xmin AND xmax AND LAT BETWEEN ymin AND ymax GROUP BY 1")
def points_in_box_table(spark, d):
    places = geo_customer(spark, d)
    home = places.select("nation", (F.col("LON") / 3).alias("LON"), (F.col("LAT") / 3).alias("LAT"))
    table = extent(home, by=["nation"]).select(F.col("nation").alias("box"), "xmin", "xmax", "ymin", "ymax")
    held = boxes.points_in_boxes(places.select("id", "LON", "LAT"), table)
    return held.groupBy("box").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@_query(f"WITH {_geo()} SELECT id, round(radians(LON), 9) AS x, round(ln(tan(pi() / 4 + radians(LAT) / 2)), 9) AS y FROM geo WHERE LAT BETWEEN -89 AND 89")
def mercator(spark, d):
    places = geo_customer(spark, d).where("LAT BETWEEN -89 AND 89").withColumn("_m", geo.mercator(F.col("LON"), F.col("LAT"), 1.0))
    return places.select("id", F.round("_m.x", 9).alias("x"), F.round("_m.y", 9).alias("y"))


# ---- point groups of thousands whose edges are known: a grid, a line, a grid and a far point, a circle

GROUP, WIDE = 3000, 50


def large_groups(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    rows = read(spark, d, "orders").select(F.expr(f"cast(o_orderkey div {GROUP} AS int)").alias("g"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % GROUP).cast("double").alias("k"))
    rows = rows.join(F.broadcast(rows.groupBy("g").agg(F.count("*").alias("n"))), "g")  # a row for each group
    kind, far = F.col("g") % 4, (F.col("g") % 4 == 2) & (k == GROUP - 1)
    turn = k * F.lit(2 * 3.141592653589793) / n
    x = F.when(kind == 1, k).when(kind == 3, F.cos(turn)).when(far, -1e6).otherwise(k % WIDE)
    y = F.when(kind == 1, k * 2).when(kind == 3, F.sin(turn)).when(far, -1e6).otherwise(F.floor(k / WIDE))
    return rows.select("g", "id", x.alias("x"), y.cast("double").alias("y"))


@_query(f"""WITH p AS (SELECT CAST(o_orderkey // {GROUP} AS INT) AS g, o_orderkey AS id, o_orderkey % {GROUP} AS k, (o_orderkey // {GROUP}) % 4 AS kind FROM orders),
q AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM p), grid AS (SELECT * FROM q WHERE kind = 0 OR (kind = 2 AND k < {GROUP - 1}))
SELECT a.g, a.id AS i, b.id AS j FROM grid a JOIN grid b ON a.g = b.g AND b.k = a.k + 1 AND a.k % {WIDE} < {WIDE - 1}
UNION ALL SELECT a.g, a.id, b.id FROM grid a JOIN grid b ON a.g = b.g AND b.k = a.k + {WIDE}
UNION ALL SELECT a.g, a.id, b.id FROM grid a JOIN grid b ON a.g = b.g AND a.kind = 2 AND a.n = {GROUP} AND a.k = {GROUP - 1 - WIDE} AND b.k = {GROUP - 2}
UNION ALL SELECT a.g, a.id, b.id FROM grid a JOIN q b ON a.g = b.g AND b.kind = 2 AND b.k = {GROUP - 1} AND (a.k < {WIDE} OR a.k % {WIDE} = 0)
UNION ALL SELECT a.g, a.id, b.id FROM q a JOIN q b ON a.g = b.g AND a.kind IN (1, 3) AND b.k = a.k + 1
UNION ALL SELECT a.g, a.id, b.id FROM q a JOIN q b ON a.g = b.g AND a.kind = 3 AND a.k = 0 AND b.k = b.n - 1 AND b.n > 2""")
def delaunay_edges_large(spark, d):
    return neighbors.delaunay_edges(large_groups(spark, d))


# ---- streams, run to the end of what their folder holds


def _run(stream: DataFrame, where: str) -> DataFrame:
    started = stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/log").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/rows")


@_query(f"WITH {_geo()} SELECT id, CASE WHEN LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50 THEN 'CUS' WHEN LON BETWEEN -180 AND -65 AND LAT BETWEEN 15 AND 72 THEN 'US' WHEN LON BETWEEN -180 AND 180 AND LAT BETWEEN -75 AND 75 THEN 'World' END AS region, LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50 AS ISCUS FROM geo")
def stream_tags(spark, d):
    customers = spark.readStream.schema(read(spark, d, "customer").schema).parquet(f"{d}/customer*.parquet")
    return _run(streaming.tag_points(as_places(customers)).select("id", "region", "ISCUS"), scratch_dir(spark))


_HOURS = "SELECT date_trunc('hour', ts) AS hour, CAST((event_id * 7919) % 360001 AS DOUBLE) / 1e3 - 180e0 AS LON, CAST((event_id * 104729) % 180001 AS DOUBLE) / 1e3 - 90e0 AS LAT FROM events"


@_query(f"SELECT hour, min(LON) AS raw_xmin, max(LON) AS raw_xmax, min(LAT) AS raw_ymin, max(LAT) AS raw_ymax FROM ({_HOURS}) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1")
def stream_extent(spark, d):
    """Extents of hours that the watermark has passed."""
    events = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    lon = ((F.col("event_id") * 7919) % 360001).cast("double") / F.lit(1e3) - F.lit(180.0)
    lat = ((F.col("event_id") * 104729) % 180001).cast("double") / F.lit(1e3) - F.lit(90.0)
    points = events.select(F.col("ts").cast("timestamp").alias("ts"), lon.alias("LON"), lat.alias("LAT"))
    out = streaming.windowed_extent(points, "ts", "1 hour", "10 minutes")
    out = out.select(F.col("window.start").alias("hour"), "raw_xmin", "raw_xmax", "raw_ymin", "raw_ymax")
    return _run(out, scratch_dir(spark)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


# ---- raw sources: text files are written, read by the adapters and assembled


def _text_files(df: DataFrame, where: str, name: str, sep: str) -> str:
    df.write.csv(f"{where}/{name}", sep=sep, header=True)
    return f"{where}/{name}"


@_query(f"WITH {_geo()} SELECT id, NAME, LAT, LON, ALAND, AWATER, POP, CASE WHEN nation < 20 THEN nation END AS CBSA, LON BETWEEN -125 AND -65 AND LAT BETWEEN 24 AND 50 AS ISCUS FROM geo")
def raw_assemble(spark, d):
    places, where = geo_customer(spark, d), scratch_dir(spark)
    areas = raw.read_gazetteer(spark, _text_files(places.select("id", "NAME", "LAT", "LON", "ALAND", "AWATER"), where, "areas", "\t"), "id bigint, NAME string, LAT double, LON double, ALAND double, AWATER double")
    people = raw.read_population_centres(spark, _text_files(places.select("id", "POP"), where, "people", ","), "id bigint, POP bigint")
    members = raw.read_delineation(spark, _text_files(places.where("nation < 20").select("id", "nation"), where, "members", ","), "id bigint, CBSA int")
    return raw.assemble(areas, people, ["id"], members, flag=True)


@_query("""WITH p AS (SELECT n_nationkey AS n, k.range AS k FROM nation, LATERAL (SELECT range FROM range(CASE WHEN n_nationkey % 4 = 2 THEN 2 ELSE 1 END)) k),
numbered AS (SELECT *, row_number() OVER (ORDER BY n, k) - 1 AS part FROM p)
SELECT 'countries' AS layer, CAST(part AS INT) AS part_id, CAST(seq AS INT) AS seq, CAST(n + k + 2 * seq AS DOUBLE) AS lon, CAST(n + 1 + seq * (2 + k) AS DOUBLE) AS lat FROM numbered, (VALUES (0), (1)) t(seq)""")
def raw_geojson(spark, d):
    """Lines of every geometry kind; a nation's line goes from (n + k, n + 1) to (n + k + 2, n + 3 + k)."""
    n, line = F.col("n_nationkey"), "[[%s, %s], [%s, %s]]"
    at = lambda k: F.format_string(line, n + k, n + 1, n + k + 2, n + 3 + k)
    kind = F.element_at(F.array(*map(F.lit, ("LineString", "Polygon", "MultiLineString", "MultiPolygon"))), n % 4 + 1)
    coordinates = F.when(n % 4 == 0, at(0)).when(n % 4 == 1, F.format_string("[%s]", at(0))).when(n % 4 == 2, F.format_string("[%s, %s]", at(0), at(1))).otherwise(F.format_string("[[%s]]", at(0)))
    feature = F.format_string('{"type": "Feature", "properties": {}, "geometry": {"type": "%s", "coordinates": %s}}', kind, coordinates)
    every = read(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), feature.alias("f")))).alias("all"))
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.transform("all", lambda x: x["f"]), ",\n"), F.lit("]}"))
    where = f"{scratch_dir(spark)}/lines"
    every.select(text.alias("value")).write.text(where)
    return raw.read_geojson_lines(spark, where, "countries")


@_query("SELECT * FROM (VALUES ('layer', 'ValueError'), ('point', 'ValueError'), ('region', 'ValueError'), ('state', 'ValueError'), ('table', 'ValueError'), ('write', 'ValueError'), ('boxes', 'ValueError')) t(what, error)")
def errors(spark, d):
    """What is refused, and how."""
    places = geo_customer(spark, d)
    tried = {
        "table": lambda: catalog.table(spark, "nothing", d), "layer": lambda: catalog.table(spark, "rivers", d), "write": lambda: catalog.write_table(places, "uscsa", scratch_dir(spark)),
        "state": lambda: state_to_fips("XX"), "region": lambda: region_spec(spark, "Mars"),
        "point": lambda: geo.point_in_bbox([1.0], limits=geo.US_LIMITS), "boxes": lambda: bbox_of([1.0], [1.0, 2.0]),
    }
    rows = []
    for what, call in tried.items():
        try:
            call()
        except Exception as e:  # what kind of error it is, is the answer
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")
