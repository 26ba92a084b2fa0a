"""Masks and splits."""

from pyspark.sql import functions as F

from gridspark.operators import masks as mk
from gridspark.queries.registry import hash_sql, query, rounded
from gridspark.sources import adapters as ad

K = ad.MONTHLY_KEYS
KS = ", ".join(K)


@query("m01_finite_mask", f"""
WITH {ad.field_gaps_sql()}, s AS (SELECT lat_idx, lon_idx, year, month, avg(value) AS value FROM field GROUP BY ALL),
x AS (SELECT year, month, row_number() OVER (ORDER BY year, month) AS rn FROM (SELECT DISTINCT year, month FROM s)),
c AS (SELECT DISTINCT lat_idx, lon_idx FROM s),
dense AS (SELECT c.lat_idx, c.lon_idx, x.rn, s.value FROM c CROSS JOIN x LEFT JOIN s USING (lat_idx, lon_idx, year, month))
SELECT lat_idx, lon_idx, CAST(bool_and(value IS NOT NULL) AS INT) AS all_steps, CAST(bool_and(value IS NOT NULL) FILTER (rn <= 3) AS INT) AS first_steps FROM dense GROUP BY ALL""")
def finite_mask(spark, sf):
    s = ad.field_gaps(spark, sf).groupBy("lat_idx", "lon_idx", "t").agg(F.avg("value").alias("value"))
    a = mk.finite_mask(s, s).withColumnRenamed("finite_mask", "all_steps")
    b = mk.finite_mask(s, s, first_n=3).withColumnRenamed("finite_mask", "first_steps")
    return a.join(b, ["lat_idx", "lon_idx"])


@query("m02_threshold_mask", f"""
WITH {ad.field_gaps_sql()} SELECT {KS}, year, month, CAST(coalesce(value >= 100, false) AS INT) AS mask FROM field""")
def threshold_mask(spark, sf):
    return mk.threshold_mask(ad.field_gaps(spark, sf), 100.0).select(*K, "year", "month", "mask")


@query("m03_combine_masks", f"""
WITH {ad.CELLS_SQL}
SELECT lat_idx, lon_idx, CAST(land >= 0.5 AND coalesce(value >= 3, false) AND tvt <> 1 AS INT) AS mask FROM cells""")
def combine_masks(spark, sf):
    c = ad.cells(spark, sf)
    a = c.withColumn("mask", F.col("land"))
    b = mk.threshold_mask(c, 3.0)
    d = c.withColumn("mask", (F.col("tvt") != 1).cast("int"))
    return mk.combine_masks([a, b, d])


@query("m04_ocean_to_land", f"""
WITH {ad.CELLS_SQL} SELECT lat_idx, lon_idx, round(greatest(0.0, least(1.0, 1 - value / 5)), 6) AS land_fraction FROM cells""")
def ocean_to_land(spark, sf):
    c = ad.cells(spark, sf).withColumn("value", F.col("value") / 5)
    return rounded(mk.ocean_to_land(c), "land_fraction").select("lat_idx", "lon_idx", "land_fraction")


_FRACTIONS = f"""frac AS (SELECT l_linenumber AS model, {ad._cell_sql('l_suppkey')},
  CASE WHEN max(l_quantity) % 11 = 0 THEN NULL ELSE avg(l_quantity / 27.0) END AS value FROM lineitem GROUP BY ALL)"""


@query("m05_consensus_land_fraction", f"""
WITH {_FRACTIONS}, c AS (SELECT *, greatest(0.0, least(1.0, coalesce(value, 0))) AS v FROM frac),
d AS (SELECT *, CASE WHEN v > 0.9 THEN 1.0 ELSE v END AS u FROM c)
SELECT lat_idx, lon_idx, round(CASE WHEN min(u) = 0 THEN 0 ELSE avg(u) END, 6) AS land_fraction FROM d GROUP BY ALL""")
def consensus_land_fraction(spark, sf):
    """Some means are 0.9, the threshold, exactly: decimals are summed, so that no order of rows moves one across it."""
    total = F.sum(F.col("l_quantity").cast("decimal(18, 6)"))
    d = ad.table(spark, sf, "lineitem").groupBy(
        F.col("l_linenumber").alias("model"), *[c.alias(n) for n, c in ad.cell_of("l_suppkey").items()]).agg(
        F.when(F.max("l_quantity") % 11 != 0, total.cast("double") / F.count("l_quantity") / 27).alias("value"))
    return rounded(mk.consensus_land_fraction(d), "land_fraction")


@query("m06_apply_mask", f"""
WITH {ad.field_month_sql()}, {ad.CELLS_SQL}
SELECT {KS}, f.t, round(CASE WHEN tvt IN (0, 2) THEN f.value END, 6) AS value FROM field f LEFT JOIN cells c USING (lat_idx, lon_idx)""")
def apply_mask(spark, sf):
    d = mk.apply_mask(ad.field_month(spark, sf), ad.cells(spark, sf), [0, 2])
    return rounded(d.select(*K, "t", "value"), "value")


@query("m06_mask_drops_rows", f"""
WITH {ad.field_month_sql()}, {ad.CELLS_SQL}
SELECT source, year, count(*) AS n, round(avg(f.value), 6) AS value FROM field f JOIN cells c USING (lat_idx, lon_idx) WHERE tvt = 2 GROUP BY ALL""")
def mask_drops_rows(spark, sf):
    d = mk.apply_mask(ad.field_month(spark, sf), ad.cells(spark, sf), [2], keep_rows=False)
    return rounded(d.groupBy("source", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")


_RING = "least(" + ", ".join(
    f"(((lon_idx - {c}) % 720 + 720) % 720), ((({c} - lon_idx) % 720 + 720) % 720)" for c in range(0, 720, 60)) + ")"

SPLIT_SQL = f"""
r AS (SELECT *, {_RING} AS ring FROM cells),
g AS (SELECT ring, sum(land) AS n FROM r GROUP BY ring),
h AS (SELECT ring, n, coalesce(sum(n) OVER (ORDER BY ring ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(n) OVER () AS total FROM g),
i AS (SELECT *, before < floor(total * 0.2) AS is_test FROM h),
j AS (SELECT ring, CASE WHEN is_test THEN 2 WHEN before - sum(CASE WHEN is_test THEN n ELSE 0 END) OVER () < floor(total * 0.1) THEN 1 ELSE 0 END AS code FROM i),
split AS (SELECT lat_idx, lon_idx, land, CASE WHEN land = 1 THEN code ELSE -1 END AS tvt FROM r JOIN j USING (ring))"""


@query("m07_split_longitude_bands", f"WITH {ad.CELLS_SQL}, {SPLIT_SQL} SELECT * FROM split")
def split_longitude_bands(spark, sf):
    c = ad.cells(spark, sf).select("lat_idx", "lon_idx", "land")
    return mk.split_longitude_bands(c)


@query("m08_split_locations", f"""
WITH {ad.CELLS_SQL}, r AS (SELECT lat_idx, lon_idx, tvt, count(*) OVER (PARTITION BY tvt) AS n,
  row_number() OVER (PARTITION BY tvt ORDER BY {hash_sql("lat_idx", "lon_idx", seed=42)}, lat_idx, lon_idx) AS loc_id FROM cells WHERE tvt >= 0)
SELECT lat_idx, lon_idx, tvt, loc_id FROM r WHERE loc_id <= n // 70 * 70""")
def split_locations(spark, sf):
    """Seeded order, whole blocks of 70."""
    return mk.split_locations(ad.cells(spark, sf).select("lat_idx", "lon_idx", "tvt"))


@query("m08_locations_per_split", f"""
WITH {ad.CELLS_SQL}, n AS (SELECT tvt, count(*) AS n FROM cells GROUP BY tvt)
SELECT tvt, n // 70 * 70 AS n_locations, n // 70 * 70 AS last_loc_id FROM n WHERE n >= 70""")
def locations_per_split(spark, sf):
    d = mk.split_locations(ad.cells(spark, sf).select("lat_idx", "lon_idx", "tvt"))
    return d.groupBy("tvt").agg(F.count(F.lit(1)).alias("n_locations"), F.max("loc_id").alias("last_loc_id"))


SPLIT_RULES_SQL = """rules AS (SELECT * FROM (VALUES (0,'train_period',1928,2013,'train'),(0,'val_period_early',1919,1927,'val'),(0,'val_period_late',2014,2017,'val'),
  (0,'test_period_early',1901,1918,'test'),(0,'test_period_late',2018,2023,'test'),(1,'whole_period',1901,2023,'val'),(2,'whole_period',1901,2023,'test')) v(code, period, y0, y1, split))"""


# Ship years are moved to the start of the covered period, so that several periods occur.
@query("m09_assign_splits", f"""
WITH {ad.field_sql("source", "cell", "year")}, {ad.CELLS_SQL},
y AS (SELECT f.source, c.tvt, 1901 + (f.year - 1995) * 20 AS year, f.value FROM field f JOIN cells c USING (lat_idx, lon_idx)),
{SPLIT_RULES_SQL}
SELECT split, period, y.tvt, count(*) AS n, round(avg(value), 6) AS value FROM y JOIN rules ON code = y.tvt AND year BETWEEN y0 AND y1 GROUP BY ALL""")
def assign_splits(spark, sf):
    f = ad.field(spark, sf, "source", "cell", "year").withColumn("year", 1901 + (F.col("year") - 1995) * 20)
    c = ad.cells(spark, sf).select("lat_idx", "lon_idx", "tvt")
    d = mk.assign_splits(f.join(c, ["lat_idx", "lon_idx"]))
    return rounded(d.groupBy("split", "period", "tvt").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")


@query("m10_mask_code_counts", f"""
WITH {ad.CELLS_SQL}, {SPLIT_SQL}, n AS (SELECT tvt, count(*) AS n FROM split GROUP BY tvt)
SELECT tvt, n, round(CASE WHEN tvt >= 0 THEN n / (SELECT sum(n) FROM n WHERE tvt >= 0) END, 6) AS share_of_land FROM n""")
def mask_code_counts(spark, sf):
    c = mk.split_longitude_bands(ad.cells(spark, sf).select("lat_idx", "lon_idx", "land"))
    return rounded(mk.mask_code_counts(c), "share_of_land")


@query("m11_region_ids", f"""
WITH {ad.CELLS_SQL}, {SPLIT_SQL}
SELECT lat_idx, lon_idx, CASE WHEN tvt >= 0 THEN tvt ELSE -999 END AS region_id,
  CASE tvt WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' END AS region FROM split""")
def region_ids(spark, sf):
    c = mk.split_longitude_bands(ad.cells(spark, sf).select("lat_idx", "lon_idx", "land"))
    return mk.region_ids(c).select("lat_idx", "lon_idx", "region_id", "region")
