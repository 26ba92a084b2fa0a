"""Grid and space."""

from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.functions.geo import HALF_DEGREE, GridSpec
from gridspark.operators import space as sp
from gridspark.queries.registry import AREA, LAT, TILE, query, rounded
from gridspark.sources import adapters as ad

K = ad.MONTHLY_KEYS
KS = ", ".join(K)

# Free coordinates derived from customers: longitude in either convention.
_POINTS = ("points AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 20.0 - 90.0 + 0.013 AS lat, "
           "(c_custkey * 101 % 7200) / 10.0 - 360.0 + 0.017 AS lon FROM customer)")


def _points(spark, sf):
    k = F.col("c_custkey")
    return ad.table(spark, sf, "customer").select(
        k, (F.pmod(k * 37, F.lit(3600)) / 20.0 - 90.0 + 0.013).alias("lat"),
        (F.pmod(k * 101, F.lit(7200)) / 10.0 - 360.0 + 0.017).alias("lon"))


_IDX = ("least(359, greatest(0, CAST(floor((lat + 89.75) / 0.5 + 0.5) AS INT)))",
        "CAST(((CAST(floor(lon / 0.5 + 0.5) AS BIGINT) % 720) + 720) % 720 AS INT)")


@query("g01_normalise_coordinates", f"""
WITH {_POINTS}, i AS (SELECT c_custkey, {_IDX[0]} AS lat_idx, {_IDX[1]} AS lon_idx FROM points)
SELECT c_custkey, lat_idx, lon_idx, {LAT} AS lat, CAST(lon_idx * 0.5 AS DOUBLE) AS lon FROM i""")
def normalise_coordinates(spark, sf):
    return sp.normalise_coordinates(_points(spark, sf), "lat", "lon").select("c_custkey", "lat_idx", "lon_idx", "lat", "lon")


@query("g02_longitude_conventions", f"""
WITH {_POINTS}
SELECT c_custkey, round(lon - 360 * floor(lon / 360), 6) AS lon360, round(lon + 180 - 360 * floor((lon + 180) / 360) - 180, 6) AS lon180 FROM points""")
def longitude_conventions(spark, sf):
    d = _points(spark, sf)
    return d.select("c_custkey", F.round(geo.lon360("lon"), 6).alias("lon360"), F.round(geo.lon180("lon"), 6).alias("lon180"))


# Source grid: 36 x 72 cells of 5 degrees filled by parts; target grid half as fine again.
_SRC = GridSpec(nlat=36, nlon=72, lat0=-87.5, lon0=0.0, dlat=5.0, dlon=5.0)
_DST = GridSpec(nlat=72, nlon=144, lat0=-88.75, lon0=0.0, dlat=2.5, dlon=2.5)


@query("g03_regrid_bilinear", """
WITH f AS (SELECT l_returnflag AS variable, CAST(l_partkey % 36 AS INT) AS i, CAST((l_partkey // 36) % 72 AS INT) AS j, avg(l_extendedprice / 365.2425) AS v
  FROM lineitem GROUP BY ALL),
ry AS (SELECT y, greatest(0.0, least(35.0, (-88.75 + y * 2.5 + 87.5) / 5.0)) AS p FROM (SELECT CAST(unnest(range(0, 72)) AS INT) AS y)),
rx AS (SELECT x, x * 2.5 / 5.0 AS p FROM (SELECT CAST(unnest(range(0, 144)) AS INT) AS x)),
wy AS (SELECT y, CAST(floor(p) AS INT) AS i, 1 - (p - floor(p)) AS w FROM ry UNION ALL SELECT y, CAST(floor(p) AS INT) + 1, p - floor(p) FROM ry),
wx AS (SELECT x, CAST(floor(p) AS INT) % 72 AS j, 1 - (p - floor(p)) AS w FROM rx UNION ALL SELECT x, (CAST(floor(p) AS INT) + 1) % 72, p - floor(p) FROM rx),
wy1 AS (SELECT *, count(*) OVER (PARTITION BY y) AS n FROM wy WHERE w > 0),
wx1 AS (SELECT *, count(*) OVER (PARTITION BY x) AS n FROM wx WHERE w > 0)
SELECT variable, y AS lat_idx, x AS lon_idx, round(CASE WHEN count(v) = max(wy1.n * wx1.n) THEN sum(v * wy1.w * wx1.w) END, 6) AS value
FROM f JOIN wy1 USING (i) JOIN wx1 USING (j) GROUP BY ALL""")
def regrid_bilinear(spark, sf):
    k = F.col("l_partkey")
    f = ad.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("variable"), F.pmod(k, F.lit(36)).cast("int").alias("lat_idx"),
        F.pmod(F.floor(k / 36), F.lit(72)).cast("int").alias("lon_idx")).agg(F.avg(F.col("l_extendedprice") / 365.2425).alias("value"))
    return rounded(sp.regrid_bilinear(f, ["variable"], _SRC, _DST), "value")


@query("g04_cell_area", f"""
WITH {ad.CELLS_SQL} SELECT lat_idx, lon_idx, round({AREA} / 1e6, 4) AS area_km2 FROM cells""")
def cell_area(spark, sf):
    d = sp.add_geometry(ad.cells(spark, sf))
    return d.select("lat_idx", "lon_idx", F.round(F.col("area_m2") / 1e6, 4).alias("area_km2"))


@query("g05_flat_index", f"""
WITH {ad.CELLS_SQL} SELECT lat_idx, lon_idx, lat_idx * 720 + lon_idx AS flat_idx, lat_idx AS row_back, lon_idx AS col_back FROM cells""")
def flat_index(spark, sf):
    d = ad.cells(spark, sf).select("lat_idx", "lon_idx", HALF_DEGREE.flat("lat_idx", "lon_idx").alias("flat_idx"))
    row, col = HALF_DEGREE.unflat("flat_idx")
    return d.withColumns({"row_back": row, "col_back": col})


@query("g06_tile_bounds", f"""
WITH {ad.CELLS_SQL}
SELECT CAST({TILE} AS INT) AS tile_id, min(lat_idx) AS lat_from, max(lat_idx) + 1 AS lat_to, min(lon_idx) AS lon_from, max(lon_idx) + 1 AS lon_to
FROM cells GROUP BY 1""")
def tile_bounds(spark, sf):
    return sp.tile_bounds(ad.cells(spark, sf))


@query("g07_ocean_tiles", f"""
WITH {ad.CELLS_SQL}
SELECT CAST({TILE} AS INT) AS tile_id, CAST(sum(land) AS BIGINT) AS land_cells, sum(land) = 0 AS ocean_only FROM cells GROUP BY 1""")
def ocean_tiles(spark, sf):
    return sp.tiles_by_land(ad.cells(spark, sf))


@query("g08_nearest_cell", f"""
WITH {_POINTS} SELECT c_custkey, {_IDX[0]} AS lat_idx, {_IDX[1]} AS lon_idx FROM points""")
def nearest_cell(spark, sf):
    return sp.nearest_cell(_points(spark, sf), "lat", "lon").select("c_custkey", "lat_idx", "lon_idx")


_LOC = f"loc AS (SELECT s_suppkey AS loc_id, {ad._cell_sql('s_suppkey')} FROM supplier WHERE s_acctbal > 0)"


@query("g09_gather_points", f"""
WITH {ad.field_month_sql()}, {_LOC}
SELECT loc_id, source, t, round(value, 6) AS value FROM field JOIN loc USING (lat_idx, lon_idx)""")
def gather_points(spark, sf):
    loc = ad.table(spark, sf, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("loc_id"), *[c.alias(n) for n, c in ad.cell_of("s_suppkey").items()])
    d = sp.gather_points(ad.field_month(spark, sf), loc)
    return rounded(d.select("loc_id", "source", "t", "value"), "value")


_ZONE = (f"CASE WHEN {LAT} >= -15 AND {LAT} < 15 THEN 1 WHEN ({LAT} >= 15 AND {LAT} < 35) OR ({LAT} >= -35 AND {LAT} < -15) THEN 2 "
         f"WHEN ({LAT} >= 35 AND {LAT} < 60) OR ({LAT} >= -60 AND {LAT} < -35) THEN 3 WHEN {LAT} >= 60 AND {LAT} < 90 THEN 4 ELSE 0 END")


@query("g10_latitude_zones", f"""
WITH {ad.CELLS_SQL} SELECT {_ZONE} AS zone, count(*) AS n_cells, CAST(sum(land) AS BIGINT) AS n_land, round(avg(value), 6) AS value FROM cells GROUP BY 1""")
def latitude_zones(spark, sf):
    d = sp.add_geometry(ad.cells(spark, sf)).groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("land").alias("n_land"), F.avg("value").alias("value"))
    return rounded(d, "value")


@query("g11_latitude_bands", f"""
WITH {_POINTS} SELECT CASE WHEN lat >= -90 AND lat < 90 THEN floor(lat) + 0.5 END AS lat_band, count(*) AS n FROM points GROUP BY 1""")
def latitude_bands(spark, sf):
    return _points(spark, sf).groupBy(geo.lat_band("lat").alias("lat_band")).agg(F.count(F.lit(1)).alias("n"))


@query("g12_cell_bounds", f"""
WITH {ad.CELLS_SQL}, a AS (SELECT DISTINCT {LAT} AS lat FROM cells),
d AS (SELECT lat, lat - lag(lat) OVER (ORDER BY lat) AS s FROM a), m AS (SELECT median(s) / 2 AS h FROM d)
SELECT lat, greatest(-90.0, lat - h) AS lower, least(90.0, lat + h) AS upper FROM a, m""")
def cell_bounds(spark, sf):
    a = ad.cells(spark, sf).select(HALF_DEGREE.lat("lat_idx").alias("lat")).distinct()
    return sp.axis_bounds(a, "lat", -90.0, 90.0)


@query("g13_vertical_mean", f"""
WITH l AS (SELECT {ad._cell_sql('l_suppkey')}, CAST(year(l_shipdate) AS INT) AS year, l_linenumber AS depth, avg(l_extendedprice / 365.2425) AS value
  FROM lineitem GROUP BY ALL), w AS (SELECT *, depth * 0.1 AS w FROM l)
SELECT lat_idx, lon_idx, year, round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) AS value FROM w GROUP BY ALL""")
def vertical_mean(spark, sf):
    layers = ad.table(spark, sf, "lineitem").groupBy(
        *[c.alias(n) for n, c in ad.cell_of("l_suppkey").items()], F.year("l_shipdate").alias("year"),
        F.col("l_linenumber").alias("depth")).agg(F.avg(F.col("l_extendedprice") / 365.2425).alias("value"))
    layers = layers.withColumn("thickness", F.col("depth") * 0.1)
    return rounded(sp.vertical_mean(layers, ["lat_idx", "lon_idx", "year"], "thickness"), "value")


@query("g14_grid_mismatches", f"""
WITH a AS (SELECT DISTINCT {ad._cell_sql('s_suppkey')} FROM supplier), b AS (SELECT DISTINCT {ad._cell_sql('p_partkey')} FROM part)
SELECT lat_idx, lon_idx, 'left' AS missing_in FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT lat_idx, lon_idx, 'right' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def grid_mismatches(spark, sf):
    a = ad.table(spark, sf, "supplier").select(*[c.alias(n) for n, c in ad.cell_of("s_suppkey").items()])
    b = ad.table(spark, sf, "part").select(*[c.alias(n) for n, c in ad.cell_of("p_partkey").items()])
    return sp.grid_mismatches(a, b, ["lat_idx", "lon_idx"])
