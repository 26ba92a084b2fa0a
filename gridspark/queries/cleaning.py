"""Projections, filters and value cleaning."""

from pyspark.sql import functions as F

from gridspark.operators import aggregates as ag, cleaning as cl, space as sp, time_axis as ta
from gridspark.queries.registry import LAT, query, rounded
from gridspark.schema import OUTPUT_ATTRIBUTES, TEST_WINDOWS
from gridspark.sources import adapters as ad

K = ad.MONTHLY_KEYS
KS = ", ".join(K)
VY = ["variable", "source", "lat_idx", "lon_idx", "year"]
_VY = ("source", "cell", "year")


@query("f01_rename", f"""
WITH {ad.field_vars_sql(*_VY)}
SELECT CASE variable WHEN 'ra' THEN 'respiration' WHEN 'gpp' THEN 'production' ELSE variable END AS variable, source, lat_idx AS lat, lon_idx AS lon, year,
  round(value, 6) AS value FROM field""")
def rename(spark, sf):
    d = cl.rename_variables(ad.field_vars(spark, sf, *_VY), {"ra": "respiration", "gpp": "production"}, {"lat_idx": "lat", "lon_idx": "lon"})
    return rounded(d, "value")


_ATTR = ", ".join(f"('{v}', '{a[0]}', '{a[1]}', '{a[2]}')" for v, a in OUTPUT_ATTRIBUTES.items())


@query("f02_attach_attributes", f"""
WITH {ad.field_vars_sql(*_VY)}, a AS (SELECT * FROM (VALUES {_ATTR}) v(variable, units, long_name, standard_name))
SELECT variable, units, long_name, standard_name, year, round(avg(value), 6) AS value FROM field LEFT JOIN a USING (variable) GROUP BY ALL""")
def attach_attributes(spark, sf):
    d = cl.attach_attributes(ad.field_vars(spark, sf, *_VY))
    return rounded(d.groupBy("variable", "units", "long_name", "standard_name", "year").agg(F.avg("value").alias("value")), "value")


@query("f03_date_window", f"""
WITH {ad.field_month_sql()} SELECT {KS}, t, round(value, 6) AS value FROM field
WHERE t BETWEEN (1996 - 1901) * 365 + 59 AND (1998 - 1901) * 365 + 180""")
def date_window(spark, sf):
    d = ta.date_window(ad.field_month(spark, sf), "1996-03-01", "1998-06-30")
    return rounded(d.select(*K, "t", "value"), "value")


@query("f04_test_windows", f"""
WITH {ad.field_sql("source", "cell", "year")}, y AS (SELECT {KS}, CAST(1901 + (year - 1995) * 20 AS INT) AS year, value FROM field)
SELECT {KS}, year, round(value, 6) AS value FROM y WHERE year BETWEEN 1901 AND 1918 OR year BETWEEN 2018 AND 2023""")
def test_windows(spark, sf):
    d = ad.field(spark, sf, "source", "cell", "year").withColumn("year", (1901 + (F.col("year") - 1995) * 20).cast("int"))
    return rounded(ta.test_windows(d, TEST_WINDOWS), "value")


@query("f05_sentinels_to_null", """
SELECT l_linenumber, count(*) AS n, count(CASE WHEN l_quantity IN (7, 21, 35) THEN NULL WHEN l_quantity = 50 THEN NULL ELSE 1 END) AS n_present,
  round(avg(CASE WHEN l_quantity IN (7, 21, 35) OR l_quantity = 50 THEN NULL ELSE l_extendedprice / 365.2425 END), 6) AS mean
FROM lineitem GROUP BY 1""")
def sentinels_to_null(spark, sf):
    v = (F.when(F.col("l_quantity") == 7, -99999.0).when(F.col("l_quantity") == 21, -9.969209968386869e36)
         .when(F.col("l_quantity") == 35, 1e20).when(F.col("l_quantity") == 50, float("nan")).otherwise(F.col("l_extendedprice") / 365.2425))
    d = cl.sentinels_to_null(ad.table(spark, sf, "lineitem").select("l_linenumber", v.alias("value")))
    return rounded(d.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_present"),
                                                 F.avg("value").alias("mean")), "mean")


@query("f06_clip_negative", f"""
WITH {ad.field_vars_sql(*_VY)}, a AS (SELECT *, value - 100 AS v FROM field)
SELECT variable, source, lat_idx, lon_idx, year, round(CASE WHEN variable IN ('gpp', 'ra', 'rh') AND v < 0 THEN 0 ELSE v END, 6) AS value FROM a""")
def clip_negative(spark, sf):
    d = ad.field_vars(spark, sf, *_VY).withColumn("value", F.col("value") - 100)
    return rounded(cl.clip_negative(d), "value")


@query("f07_zero_like", f"""
WITH {ad.field_gaps_sql()} SELECT 'fLuc' AS variable, {KS}, t, CAST(CASE WHEN value IS NOT NULL THEN 0 END AS DOUBLE) AS value FROM field""")
def zero_like(spark, sf):
    return cl.zero_like(ad.field_gaps(spark, sf), "fLuc").select("variable", *K, "t", "value")


@query("f08_missing_to_zero", f"""
WITH {ad.field_gaps_sql()}, v AS (SELECT CASE WHEN source = 'M1' THEN 'nfer_crop_nh4' ELSE 'gpp' END AS variable, * FROM field)
SELECT variable, {KS}, t, round(CASE WHEN variable = 'nfer_crop_nh4' THEN coalesce(value, 0) ELSE value END, 6) AS value FROM v""")
def missing_to_zero(spark, sf):
    d = ad.field_gaps(spark, sf).withColumn("variable", F.when(F.col("source") == "M1", "nfer_crop_nh4").otherwise("gpp"))
    return rounded(cl.missing_to_zero(d).select("variable", *K, "t", "value"), "value")


@query("f09_box_mean", f"""
WITH {ad.field_month_sql()}, p AS (SELECT *, {LAT} AS lat, lon_idx * 0.5 AS lon FROM field)
SELECT source, t, round(avg(value), 6) AS value FROM p WHERE lat BETWEEN -60 AND 40 AND (lon >= 350 OR lon <= 60) GROUP BY ALL""")
def box_mean(spark, sf):
    return rounded(sp.box_mean(ad.field_month(spark, sf), ["source", "t"], (-60.0, 40.0), (-10.0, 60.0)), "value")


@query("f10_finite_rows", f"""
WITH {ad.field_wide_sql(*_VY)}, p AS (SELECT *, CASE WHEN gpp > 150 THEN NULL ELSE gpp END AS a, CASE WHEN ra < 20 THEN NULL ELSE ra END AS b FROM wide)
SELECT source, lat_idx, lon_idx, year, round(a, 6) AS a, round(b, 6) AS b FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def finite_rows(spark, sf):
    d = ad.field_wide(spark, sf, *_VY).withColumns({
        "a": F.when(F.col("gpp") <= 150, F.col("gpp")).otherwise(F.lit(float("nan"))),
        "b": F.when(F.col("ra") >= 20, F.col("ra"))})
    return rounded(cl.finite_rows(d, ["a", "b"]).select("source", "lat_idx", "lon_idx", "year", "a", "b"), "a", "b")


@query("f11_complete_cell_years", f"""
WITH {ad.field_month_sql()}, c AS (SELECT {KS}, year FROM field GROUP BY ALL HAVING count(value) = 12),
s AS (SELECT {KS}, year, avg(value) AS v FROM field SEMI JOIN c USING ({KS}, year) GROUP BY ALL)
SELECT {KS}, year, round(v, 6) AS annual FROM (SELECT DISTINCT {KS}, year FROM field) LEFT JOIN s USING ({KS}, year)""")
def complete_cell_years(spark, sf):
    f = ad.field_month(spark, sf)
    ok = cl.select_complete(f, K, expected=12)
    res = ok.groupBy(*K, "year").agg(F.avg("value").alias("annual"))
    return rounded(cl.scatter_back(f, res, [*K, "year"], ["annual"]), "annual")


@query("f12_valid_variables", """
WITH m AS (SELECT event_type AS variable, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1)
SELECT variable, std > 0 AND variable <> 'view' AS valid FROM m WHERE variable <> 'click'
UNION ALL SELECT variable, false FROM (SELECT 'constant' AS variable)""")
def valid_variables(spark, sf):
    e = ad.table(spark, sf, "events").select(F.col("event_type").alias("variable"), "value")
    flat = e.limit(0).unionByName(e.select(F.lit("constant").alias("variable"), F.lit(1.0).alias("value")))
    stats = ag.finish_moments(ag.moments(e.unionByName(flat)))
    present = e.filter(F.col("variable") != "view").unionByName(flat)
    return cl.valid_variables(stats, present, exclude=["click"])


@query("f13_replace_labels", """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'label' ELSE 'forcing' END AS role, o_orderpriority AS variable,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'lai_avh15c1' ELSE o_orderpriority END AS actual_variable, count(*) AS n
FROM orders GROUP BY ALL""")
def replace_labels(spark, sf):
    d = ad.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "label").otherwise("forcing").alias("role"), F.col("o_orderpriority").alias("variable"))
    d = cl.replace_labels(d, {"5-LOW": "lai_avh15c1"}, ["label"])
    return d.groupBy("role", "variable", "actual_variable").agg(F.count(F.lit(1)).alias("n"))
