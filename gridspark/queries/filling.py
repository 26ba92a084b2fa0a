"""Gap filling."""

from pyspark.sql import functions as F

from gridspark.functions import noleap as nl
from gridspark.operators import aggregates as ag, fill as fi
from gridspark.queries.registry import query, rounded
from gridspark.sources import adapters as ad

CELL = ["lat_idx", "lon_idx"]


def _land(d):
    return d.withColumn("land", (F.pmod(F.col("lat_idx") + F.col("lon_idx"), F.lit(5)) != 0).cast("int"))


_LAND = "CAST((lat_idx + lon_idx) % 5 <> 0 AS INT)"

_CLIM = f"""
l AS (SELECT lat_idx, lon_idx, month, value FROM field WHERE (lat_idx + lon_idx) % 5 <> 0),
found AS (SELECT lat_idx, lon_idx, month, avg(value) AS value FROM l GROUP BY ALL),
months AS (SELECT lat_idx, lon_idx, CAST(unnest(range(1, 13)) AS INT) AS month FROM (SELECT DISTINCT lat_idx, lon_idx FROM found)),
clim AS (SELECT m.lat_idx, m.lon_idx, m.month, f.value FROM months m LEFT JOIN found f ON f.lat_idx = m.lat_idx AND f.lon_idx = m.lon_idx AND f.month = m.month)"""


@query("h01_land_climatology", f"WITH {ad.field_gaps_sql()}, {_CLIM} SELECT lat_idx, lon_idx, month, round(value, 6) AS value FROM clim")
def land_climatology(spark, sf):
    return rounded(fi.land_climatology(_land(ad.field_gaps(spark, sf))), "value")


# Part cells with a value missing where the part is small; a rim of the grid is included.
_HOLES = f"""{ad.CELLS_SQL}, g AS (SELECT lat_idx, lon_idx, land, CASE WHEN value < 2 THEN NULL ELSE value END AS value FROM cells),
o AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
w AS (SELECT lat_idx, lon_idx, least(359, greatest(0, lat_idx + i)) AS di, least(719, greatest(0, lon_idx + j)) AS dj FROM g, o WHERE value IS NULL AND land = 1),
m AS (SELECT w.lat_idx, w.lon_idx, avg(d.value) AS f, sum(d.value) / 9.0 AS c FROM w LEFT JOIN g d ON d.lat_idx = di AND d.lon_idx = dj AND d.value IS NOT NULL AND d.land = 1 GROUP BY ALL)"""


def _holes(spark, sf):
    return ad.cells(spark, sf).select(*CELL, "land", F.when(F.col("value") >= 2, F.col("value")).alias("value"))


@query("h02_spatial_fill", f"""
WITH {_HOLES} SELECT lat_idx, lon_idx, land, round(coalesce(value, f), 6) AS value FROM g LEFT JOIN m USING (lat_idx, lon_idx)""")
def spatial_fill(spark, sf):
    return rounded(fi.spatial_fill(_holes(spark, sf), []), "value")


@query("h02_spatial_fill_compat", f"""
WITH {_HOLES} SELECT lat_idx, lon_idx, land, round(coalesce(value, CASE WHEN land = 1 THEN coalesce(c, 0) END), 6) AS value FROM g LEFT JOIN m USING (lat_idx, lon_idx)""")
def spatial_fill_compat(spark, sf):
    return rounded(fi.spatial_fill(_holes(spark, sf), [], compat=True), "value")


@query("h03_neighbour_month_fill", f"""
WITH {ad.field_gaps_sql()}, {_CLIM},
j AS (SELECT c.*, p.value AS pv, n.value AS nv FROM clim c
  LEFT JOIN clim p ON p.lat_idx = c.lat_idx AND p.lon_idx = c.lon_idx AND p.month = (c.month + 10) % 12 + 1
  LEFT JOIN clim n ON n.lat_idx = c.lat_idx AND n.lon_idx = c.lon_idx AND n.month = c.month % 12 + 1)
SELECT lat_idx, lon_idx, month, round(coalesce(value, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL THEN (pv + nv) / 2 ELSE coalesce(pv, nv) END), 6) AS value FROM j""")
def neighbour_month_fill(spark, sf):
    clim = _land(fi.land_climatology(_land(ad.field_gaps(spark, sf))))
    return rounded(fi.neighbour_month_fill(clim).drop("land"), "value")


_SERIES_CLIM = f"""
g AS (SELECT *, CASE WHEN year = 1997 THEN NULL ELSE value END AS v FROM field),
c AS (SELECT source, lat_idx, lon_idx, month, avg(v) AS clim FROM g GROUP BY ALL)"""


def _series_gaps(spark, sf):
    f = ad.field_month(spark, sf)
    f = f.withColumn("value", F.when(F.col("year") != 1997, F.col("value")))
    return f, ag.monthly_climatology(f, ad.MONTHLY_KEYS)


@query("h04_climatology_fill", f"""
WITH {ad.field_month_sql()}, {_SERIES_CLIM} SELECT source, lat_idx, lon_idx, year, month, round(coalesce(v, clim), 6) AS value FROM g JOIN c USING (source, lat_idx, lon_idx, month)""")
def climatology_fill(spark, sf):
    f, c = _series_gaps(spark, sf)
    return rounded(fi.climatology_fill(f, c, ad.MONTHLY_KEYS).drop("t"), "value")


@query("h05_climatology_fill_in_years", f"""
WITH {ad.field_gaps_sql()}, c AS (SELECT source, lat_idx, month, avg(value) AS clim FROM (SELECT source, lat_idx, month, coalesce(value, 0.5) AS value FROM field) GROUP BY ALL)
SELECT source, lat_idx, lon_idx, year, month, round(CASE WHEN year BETWEEN 1996 AND 1999 THEN coalesce(value, clim) ELSE value END, 6) AS value FROM field JOIN c USING (source, lat_idx, month)""")
def climatology_fill_in_years(spark, sf):
    f = ad.field_gaps(spark, sf)
    c = ag.monthly_climatology(f.withColumn("value", F.coalesce("value", F.lit(0.5))), ["source", "lat_idx"])
    d = fi.climatology_fill(f, c, ["source", "lat_idx"], years=(1996, 1999))
    return rounded(d.select("source", "lat_idx", "lon_idx", "year", "month", "value"), "value")


@query("h06_template_overwrite", f"""
WITH {ad.field_gaps_sql()}, d AS (SELECT source, lat_idx, lon_idx, t, {ad.CUM_SQL}[month] + 1 AS doy, CASE WHEN value < 10 THEN NULL ELSE value END AS v FROM field),
tp AS (SELECT lat_idx, lon_idx, {ad.CUM_SQL}[month] + 1 AS doy, avg(coalesce(value, 1)) AS tv FROM field GROUP BY ALL),
b AS (SELECT *, count(CASE WHEN v IS NULL THEN 1 END) OVER (PARTITION BY source, lat_idx, lon_idx) AS holes FROM d)
SELECT source, lat_idx, lon_idx, t, round(CASE WHEN holes > 0 THEN tv ELSE v END, 6) AS value FROM b LEFT JOIN tp USING (lat_idx, lon_idx, doy)""")
def template_overwrite(spark, sf):
    g = ad.field_gaps(spark, sf).withColumn("doy", nl.doy_of("t"))
    template = g.groupBy(*CELL, "doy").agg(F.avg(F.coalesce("value", F.lit(1))).alias("value"))
    f = g.withColumn("value", F.when(F.col("value") >= 10, F.col("value")))
    d = fi.template_overwrite(f, template, ad.MONTHLY_KEYS)
    return rounded(d.select(*ad.MONTHLY_KEYS, "t", "value"), "value")


@query("h06_nearest_template", f"""
WITH {ad.field_month_sql()}, tp AS (SELECT lat_idx, lon_idx, {ad.CUM_SQL}[month] + 1 AS doy, avg(value) AS value FROM field GROUP BY ALL),
p AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 20.0 - 90.0 + 0.013 AS lat, (c_custkey * 11 % 8) / 10.0 - 0.4 + 0.017 AS lon FROM customer),
i AS (SELECT c_custkey, least(359, greatest(0, CAST(floor((lat + 89.75) / 0.5 + 0.5) AS INT))) AS lat_idx,
  CAST(((CAST(floor(lon / 0.5 + 0.5) AS BIGINT) % 720) + 720) % 720 AS INT) AS lon_idx FROM p)
SELECT c_custkey, lat_idx, lon_idx, doy, round(value, 6) AS value FROM i JOIN tp USING (lat_idx, lon_idx)""")
def nearest_template(spark, sf):
    f = ad.field_month(spark, sf).withColumn("doy", nl.doy_of("t"))
    template = f.groupBy(*CELL, "doy").agg(F.avg("value").alias("value"))
    k = F.col("c_custkey")
    pts = ad.table(spark, sf, "customer").select(
        k, (F.pmod(k * 37, F.lit(3600)) / 20.0 - 90.0 + 0.013).alias("lat"), (F.pmod(k * 11, F.lit(8)) / 10.0 - 0.4 + 0.017).alias("lon"))
    return rounded(fi.nearest_template(pts, template, empty="drop").drop("lat", "lon"), "value")


def _rounds_sql(n: int) -> str:
    """Rounds of the 3 x 3 fill, each on what the one before has left."""
    ctes = [f"{ad.CELLS_SQL}, o AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))",
            "f0 AS (SELECT lat_idx, lon_idx, land, CASE WHEN value < 4 THEN NULL ELSE value END AS value FROM cells)"]
    for k in range(n):
        ctes += [f"w{k} AS (SELECT lat_idx, lon_idx, least(359, greatest(0, lat_idx + i)) AS di, least(719, greatest(0, lon_idx + j)) AS dj FROM f{k}, o WHERE value IS NULL AND land = 1)",
                 f"m{k} AS (SELECT w{k}.lat_idx, w{k}.lon_idx, avg(d.value) AS f FROM w{k} JOIN f{k} d ON d.lat_idx = di AND d.lon_idx = dj AND d.value IS NOT NULL AND d.land = 1 GROUP BY ALL)",
                 f"f{k + 1} AS (SELECT lat_idx, lon_idx, land, coalesce(value, f) AS value FROM f{k} LEFT JOIN m{k} USING (lat_idx, lon_idx))"]
    return "WITH " + ", ".join(ctes) + f" SELECT lat_idx, lon_idx, land, round(value, 6) AS value FROM f{n}"


@query("h02_fill_in_rounds", _rounds_sql(4))
def fill_in_rounds(spark, sf):
    """Up to four rounds, so that wide gaps close from their rims."""
    cells = ad.cells(spark, sf).select(*CELL, "land", F.when(F.col("value") >= 4, F.col("value")).alias("value"))
    return rounded(fi.fill_all(cells, [], rounds=4), "value")


@query("h06_nearest_with_template", f"""
WITH {ad.field_month_sql()}, tp AS (SELECT lat_idx, lon_idx, {ad.CUM_SQL}[month] + 1 AS doy, avg(value) AS value FROM field GROUP BY ALL),
p AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 20.0 - 90.0 + 0.013 AS lat, (c_custkey * 11 % 3600) / 10.0 - 180 + 0.017 AS lon FROM customer),
i AS (SELECT c_custkey, least(359, greatest(0, CAST(floor((lat + 89.75) / 0.5 + 0.5) AS INT))) AS lat_idx,
  CAST(((CAST(floor(lon / 0.5 + 0.5) AS BIGINT) % 720) + 720) % 720 AS INT) AS lon_idx FROM p),
c AS (SELECT DISTINCT lat_idx AS a, lon_idx AS o FROM tp), u AS (SELECT DISTINCT lat_idx, lon_idx FROM i),
n AS (SELECT lat_idx, lon_idx, min((greatest(abs(lat_idx - a), least(abs(lon_idx - o), 720 - abs(lon_idx - o))), a, o)) AS s FROM u, c GROUP BY ALL)
SELECT c_custkey, i.lat_idx, i.lon_idx, doy, round(value, 6) AS value FROM i JOIN n USING (lat_idx, lon_idx) JOIN tp ON tp.lat_idx = struct_extract(s, 2) AND tp.lon_idx = struct_extract(s, 3)""")
def nearest_with_template(spark, sf):
    """Locations all over the grid, each with the template of the nearest cell that has one."""
    f = ad.field_month(spark, sf).withColumn("doy", nl.doy_of("t"))
    template = f.groupBy(*CELL, "doy").agg(F.avg("value").alias("value"))
    k = F.col("c_custkey")
    pts = ad.table(spark, sf, "customer").select(
        k, (F.pmod(k * 37, F.lit(3600)) / 20.0 - 90.0 + 0.013).alias("lat"), (F.pmod(k * 11, F.lit(3600)) / 10.0 - 180 + 0.017).alias("lon"))
    return rounded(fi.nearest_template(pts, template).drop("lat", "lon"), "value")
