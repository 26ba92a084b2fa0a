"""Data quality."""

from pyspark.sql import functions as F

from gridspark.functions.geo import HALF_DEGREE
from gridspark.functions.sizing import one_row
from gridspark.operators import quality as qu
from gridspark.queries.registry import LAT, query, rounded
from gridspark.sources import adapters as ad

K = ad.MONTHLY_KEYS
KS = ", ".join(K)
FG = ad.field_gaps_sql()
_LAND = "(lat_idx + lon_idx) % 5 <> 0"


def _land(d):
    return d.withColumn("land", (F.pmod(F.col("lat_idx") + F.col("lon_idx"), F.lit(5)) != 0).cast("int"))


@query("c01_missing_report", f"""
WITH {FG}, l AS (SELECT source, lat_idx, lon_idx, t, CASE WHEN lat_idx % 36 = 2 OR month = 5 THEN NULL ELSE value END AS v FROM field WHERE {_LAND}),
bt AS (SELECT source, t, count(v) AS ok FROM l GROUP BY ALL), bc AS (SELECT source, lat_idx, lon_idx, count(v) AS ok FROM l GROUP BY ALL),
dn AS (SELECT c.source, l.v FROM bc c JOIN bt t ON c.source = t.source LEFT JOIN l ON l.source = c.source AND l.lat_idx = c.lat_idx AND l.lon_idx = c.lon_idx AND l.t = t.t),
m AS (SELECT source, count(*) AS n, count(*) - count(v) AS n_missing FROM dn GROUP BY source),
a AS (SELECT source, count(*) AS n_steps, count(CASE WHEN ok = 0 THEN 1 END) AS empty_steps FROM bt GROUP BY source),
b AS (SELECT source, count(*) AS n_cells, count(CASE WHEN ok = 0 THEN 1 END) AS empty_cells FROM bc GROUP BY source)
SELECT a.*, n, n_missing, n_cells, empty_cells, round(n_missing / n, 8) AS missing_share FROM a JOIN b USING (source) JOIN m USING (source)""")
def missing_report(spark, sf):
    gone = (F.pmod("lat_idx", F.lit(36)) == 2) | (F.col("month") == 5)
    f = _land(ad.field_gaps(spark, sf)).withColumn("value", F.when(~gone, F.col("value")))
    return rounded(qu.missing_report(f, ["source"]), "missing_share", n=8)


@query("c02_partial_cells", f"""
WITH {FG}, s AS (SELECT source, 1 - count(value) / (SELECT count(DISTINCT t) FROM field) AS s FROM field GROUP BY source, lat_idx, lon_idx)
SELECT source, count(*) AS partial_cells, round(avg(s), 8) AS mean_missing_share FROM s WHERE s > 0 AND s < 1 GROUP BY source""")
def partial_cells(spark, sf):
    f = ad.field_gaps(spark, sf)
    n = one_row(f.select("t").distinct().agg(F.count("t").alias("n")))["n"]
    return rounded(qu.partial_cells(f, n, ["source"]), "mean_missing_share", n=8)


_VARS = f"{ad.field_vars_sql('source', 'cell', 'year')}, g AS (SELECT variable, source, lat_idx, lon_idx, year, CASE WHEN value BETWEEN 15 AND 40 OR value > 200 THEN NULL ELSE value END AS value FROM field)"


def _vars(spark, sf):
    f = ad.field_vars(spark, sf, "source", "cell", "year")
    return f.withColumn("value", F.when(~(F.col("value").between(15, 40) | (F.col("value") > 200)), F.col("value")))


@query("c03_missing_by_variable", f"""
WITH {_VARS}, n AS (SELECT source, variable, count(*) - count(value) AS n_missing FROM g GROUP BY ALL)
SELECT source, variable, n_missing, CAST(sum(n_missing) OVER (PARTITION BY source) AS BIGINT) AS store_missing FROM n""")
def missing_by_variable(spark, sf):
    return qu.missing_by_variable(_vars(spark, sf), ["source"])


@query("c04_bad_locations", f"""
WITH {_VARS}, b AS (SELECT lat_idx, lon_idx, variable, count(*) AS n FROM g WHERE value IS NULL GROUP BY ALL)
SELECT lat_idx, lon_idx, string_agg(variable, ',' ORDER BY variable) AS arrays, count(*) AS n_arrays, CAST(sum(n) AS BIGINT) AS n_bad FROM b GROUP BY ALL""")
def bad_locations(spark, sf):
    f = _vars(spark, sf).withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    return qu.bad_locations(f, ["lat_idx", "lon_idx"])


@query("c05_empty_or_zero_locations", f"""
WITH {ad.field_sql("source", "cell", "year")}, g AS (SELECT source, lat_idx, lon_idx, CASE WHEN lat_idx % 36 = 1 THEN NULL WHEN lat_idx % 36 = 3 THEN 0 ELSE value END AS v FROM field),
s AS (SELECT source, lat_idx, lon_idx, count(v) = 0 AS all_missing, coalesce(max(abs(v)) = 0, false) AS all_zero FROM g GROUP BY ALL) SELECT * FROM s WHERE all_missing OR all_zero""")
def empty_or_zero_locations(spark, sf):
    r = F.pmod("lat_idx", F.lit(36))
    f = ad.field(spark, sf, "source", "cell", "year").withColumn("value", F.when(r == 3, 0.0).when(r != 1, F.col("value")))
    return qu.empty_or_zero_locations(f, K)


@query("c06_conformance", f"""
WITH {ad.field_month_sql()}, i AS (SELECT source, t, {LAT} AS lat, lon_idx * 0.5 + CASE WHEN source = 'M1' THEN 0.1 ELSE 0 END AS lon, CASE WHEN source = 'M2' THEN 'days since 1850-01-01' ELSE 'days since 1901-01-01 00:00' END AS units,
  CASE WHEN source = 'M3' THEN 'standard' ELSE 'NoLeap' END AS calendar FROM field),
c AS (SELECT source, count(DISTINCT t) AS n_t, count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon FROM i GROUP BY source)
SELECT source, n_t, n_lat, n_lon, concat_ws(',', 'time length', CASE WHEN source = 'M2' THEN 'time units' END, CASE WHEN source = 'M3' THEN 'calendar' END,
  CASE WHEN n_lat <> 360 THEN 'lat size' END, CASE WHEN n_lon <> 720 THEN 'lon size' END, CASE WHEN source = 'M1' THEN 'lon centres' END) AS issues FROM c""")
def conformance(spark, sf):
    s = F.col("source")
    d = ad.field_month(spark, sf).select(
        s, "t", HALF_DEGREE.lat("lat_idx").alias("lat"), (HALF_DEGREE.lon("lon_idx") + F.when(s == "M1", 0.1).otherwise(0.0)).alias("lon"),
        F.when(s == "M2", "days since 1850-01-01").otherwise("days since 1901-01-01 00:00").alias("units"),
        F.when(s == "M3", "standard").otherwise("NoLeap").alias("calendar"))
    return qu.conformance(d, ["source"]).withColumn("issues", F.array_join("issues", ","))


@query("c07_catalog_gaps", f"""
WITH {ad.CATALOG_SQL}, k AS (SELECT model, scenario, variable, year, count(*) AS n FROM catalog GROUP BY ALL),
w AS (SELECT * FROM (SELECT DISTINCT model FROM catalog), (SELECT DISTINCT scenario FROM catalog), (SELECT DISTINCT variable FROM catalog), (SELECT DISTINCT year FROM catalog))
SELECT model, scenario, variable, year, coalesce(n, 0) AS n FROM w LEFT JOIN k USING (model, scenario, variable, year) WHERE coalesce(n, 0) <> 1""")
def catalog_gaps(spark, sf):
    c = ad.catalog(spark, sf)
    wanted = c.agg(*[F.collect_set(n).alias(n) for n in ("model", "scenario", "variable", "year")])
    for n in ("model", "scenario", "variable", "year"):
        wanted = wanted.withColumn(n, F.explode(n))
    return qu.catalog_gaps(c, wanted, ["model", "scenario", "variable", "year"])


@query("c08_axis_checks", f"""
WITH {ad.field_day_sql()}, s AS (SELECT DISTINCT variable, lat_idx, lon_idx, t FROM field), d AS (SELECT variable, lat_idx, lon_idx, t - lag(t) OVER (PARTITION BY variable, lat_idx, lon_idx ORDER BY t) AS d FROM s)
SELECT variable, lat_idx, lon_idx, count(*) AS n_steps, coalesce(min(d) > 0, true) AS increasing, coalesce(min(d) = 1 AND max(d) = 1, true) AS consecutive FROM d GROUP BY ALL""")
def axis_checks(spark, sf):
    d = ad.field_day(spark, sf).withColumn("pos", F.col("t"))
    return qu.axis_checks(d, ["variable", "lat_idx", "lon_idx"])


@query("c08_slice_differences", f"""
WITH {ad.field_sql("source", "cell", "year")}, b AS (SELECT {KS}, year, CASE WHEN year = 1998 THEN value + 1 ELSE value END AS v FROM field WHERE year <> 2000)
SELECT {KS}, year, round(value, 6) AS left_value, round(v, 6) AS right_value FROM field LEFT JOIN b USING ({KS}, year) WHERE value IS DISTINCT FROM v""")
def slice_differences(spark, sf):
    a = ad.field(spark, sf, "source", "cell", "year")
    b = a.filter("year <> 2000").withColumn("value", F.when(F.col("year") == 1998, F.col("value") + 1).otherwise(F.col("value")))
    return rounded(qu.slice_differences(a, b, [*K, "year"]), "left_value", "right_value")


@query("c09_first_missing", f"""
WITH {FG} SELECT source, t, lat_idx, lon_idx FROM field WHERE value IS NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY t, lat_idx, lon_idx) = 1""")
def first_missing(spark, sf):
    return qu.first_missing(ad.field_gaps(spark, sf), ["source"])


@query("c10_nonzero_check", f"""
WITH {ad.field_vars_sql("source", "cell", "year")}, g AS (SELECT variable, source, CASE WHEN variable = 'rh' THEN 0 ELSE value END AS v FROM field)
SELECT variable, source, round(avg(v), 6) AS mean, count(CASE WHEN v <> 0 THEN 1 END) AS n_nonzero, count(CASE WHEN v <> 0 THEN 1 END) > 0 AS ok FROM g GROUP BY ALL""")
def nonzero_check(spark, sf):
    f = ad.field_vars(spark, sf, "source", "cell", "year")
    f = f.withColumn("value", F.when(F.col("variable") == "rh", 0.0).otherwise(F.col("value")))
    return rounded(qu.nonzero_check(f, ["variable", "source"]), "mean")
