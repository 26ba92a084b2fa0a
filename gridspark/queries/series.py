"""Per-series windows."""

from pyspark.sql import functions as F

from gridspark.operators import aggregates as ag, series as se
from gridspark.queries.registry import query, rounded
from gridspark.sources import adapters as ad

K = ad.MONTHLY_KEYS
KS = ", ".join(K)
FM = ad.field_month_sql()
FY = ad.field_sql("source", "cell", "year")
_Y = ("source", "cell", "year")


def _yearly(spark, sf):
    return ad.field(spark, sf, *_Y)


def _dense(step):
    """The field with a row on every step from the first to the last of each series; kept marks its own rows."""
    return f"""e AS (SELECT {KS}, min({step}) AS s0, max({step}) AS s1 FROM field GROUP BY ALL),
ax AS (SELECT {KS}, unnest(range(s0, s1 + 1)) AS step FROM e),
dense AS (SELECT ax.step, f.*, row_number() OVER (PARTITION BY {", ".join("ax." + k for k in K)} ORDER BY ax.step) AS rn, {", ".join(f"ax.{k} AS s_{k}" for k in K)}
  FROM ax LEFT JOIN (SELECT *, {step} AS at_step FROM field) f ON {" AND ".join(f"ax.{k} = f.{k}" for k in K)} AND ax.step = f.at_step)"""


_MONTHS = "year * 12 + month"
_SERIES = "PARTITION BY " + ", ".join(f"s_{k}" for k in K)
_KEPT = "at_step IS NOT NULL"


@query("w01_rolling_mean", f"""
WITH {FY}, {_dense("year")}, r AS (SELECT *, CASE WHEN count(value) OVER f = 3 THEN avg(value) OVER f END AS r FROM dense
  WINDOW f AS ({_SERIES} ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, CASE WHEN rn < 3 THEN max(CASE WHEN rn = 3 THEN r END) OVER ({_SERIES}) ELSE r END AS v FROM r)
SELECT {KS}, year, round(v, 6) AS value FROM h WHERE {_KEPT}""")
def rolling_mean(spark, sf):
    return rounded(se.rolling_mean(_yearly(spark, sf), K, window=3), "value")


@query("w01_rolling_mean_30_months", f"""
WITH {FM}, {_dense(_MONTHS)}, r AS (SELECT *, CASE WHEN count(value) OVER f = 30 THEN avg(value) OVER f END AS r FROM dense
  WINDOW f AS ({_SERIES} ORDER BY step ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, CASE WHEN rn < 30 THEN max(CASE WHEN rn = 30 THEN r END) OVER ({_SERIES}) ELSE r END AS v FROM r)
SELECT {KS}, t, round(v, 6) AS value FROM h WHERE {_KEPT}""")
def rolling_mean_30_months(spark, sf):
    return rounded(se.rolling_mean(ad.field_month(spark, sf), K, window=30, order=("year", "month")).select(*K, "t", "value"), "value")


@query("w02_first_years_mean", f"""
WITH {FM}, {_dense(_MONTHS)}, h AS (SELECT *, avg(CASE WHEN rn <= 19 THEN value END) OVER ({_SERIES}) AS v FROM dense)
SELECT {KS}, t, round(v, 6) AS value FROM h WHERE {_KEPT}""")
def first_years_mean(spark, sf):
    return rounded(se.first_years_mean(ad.field_month(spark, sf), K, 19, order=("year", "month")).select(*K, "t", "value"), "value")


@query("w03_step_difference", f"""
WITH {FY}, {_dense("year")}, h AS (SELECT *, CASE WHEN rn = 1 THEN value ELSE value - lag(value) OVER ({_SERIES} ORDER BY step) END AS d FROM dense)
SELECT {KS}, year, round(d, 6) AS delta FROM h WHERE {_KEPT}""")
def step_difference(spark, sf):
    return rounded(se.step_difference(_yearly(spark, sf), K).drop("value"), "delta")


@query("w04_previous_month_state", f"""
WITH {FM}, {_dense(_MONTHS)}, h AS (SELECT *, lag(value, 1, 0.0) OVER ({_SERIES} ORDER BY step) AS p FROM dense)
SELECT {KS}, year, month, round(p, 6) AS prev FROM h WHERE {_KEPT}""")
def previous_month_state(spark, sf):
    return rounded(se.lag_state(ad.field_month(spark, sf), K, ("year", "month")).drop("t", "value"), "prev")


@query("w05_previous_year_state", f"""
WITH {FY}, {_dense("year")}, h AS (SELECT *, lag(value, 1, 0.0) OVER ({_SERIES} ORDER BY step) AS p FROM dense)
SELECT {KS}, year, round(p, 6) AS prev FROM h WHERE {_KEPT}""")
def previous_year_state(spark, sf):
    return rounded(se.lag_state(_yearly(spark, sf), K, "year").drop("value"), "prev")


@query("w06_running_total", f"""
WITH {ad.field_sql("source", "scenario", "year")}, c AS (SELECT scenario, source, year, sum(value) OVER (PARTITION BY scenario, source ORDER BY year) AS v FROM field)
SELECT scenario, year, round(min(v), 6) AS band_min, round(max(v), 6) AS band_max, round(quantile_cont(v, 0.25), 6) AS p50_low, round(quantile_cont(v, 0.75), 6) AS p50_high,
  round(quantile_cont(v, 0.125), 6) AS p75_low, round(quantile_cont(v, 0.875), 6) AS p75_high FROM c GROUP BY ALL""")
def running_total(spark, sf):
    c = se.running_total(ad.field(spark, sf, "source", "scenario", "year"), ["scenario", "source"], ["value"])
    d = ag.ensemble_bands(c, ["scenario", "year"], "value_cum")
    return rounded(d, "band_min", "band_max", "p50_low", "p50_high", "p75_low", "p75_high")


@query("w06_running_total_of_bands", f"""
WITH {ad.field_sql("source", "year")}, b AS (SELECT year, min(value) AS band_min, max(value) AS band_max FROM field GROUP BY year)
SELECT year, round(sum(band_min) OVER (ORDER BY year), 6) AS band_min_cum, round(sum(band_max) OVER (ORDER BY year), 6) AS band_max_cum FROM b""")
def running_total_of_bands(spark, sf):
    b = ag.ensemble_bands(ad.field(spark, sf, "source", "year"), ["year"]).withColumn("report", F.lit("all"))
    d = se.running_total(b, ["report"], ["band_min", "band_max"])  # one row per year
    return rounded(d.select("year", "band_min_cum", "band_max_cum"), "band_min_cum", "band_max_cum")


_STOCK = f"""
ym AS (SELECT * FROM (SELECT DISTINCT {KS}, year FROM field) CROSS JOIN (SELECT unnest(range(1, 13)) AS month)),
f AS (SELECT {KS}, year, month, kept, value / 1e9 * {ad.LEN_SQL}[month] * 86400.0 AS a FROM ym LEFT JOIN (SELECT *, TRUE AS kept FROM field) USING ({KS}, year, month)),
s AS (SELECT {KS}, year, avg(value) AS stock FROM field GROUP BY ALL)"""


def _flux_and_stock(spark, sf):
    f = ad.field_gaps(spark, sf).drop("t")
    stock = f.groupBy(*K, "year").agg(F.avg("value").alias("stock"))
    return f.withColumn("value", F.col("value") / 1e9), stock


@query("w07_stock_from_december", f"""
WITH {ad.field_gaps_sql()}, {_STOCK}, g AS (SELECT *, CASE WHEN month < 12 THEN a ELSE 0 END AS b FROM f),
r AS (SELECT *, CASE WHEN count(CASE WHEN b IS NULL THEN 1 END) OVER w = 0 THEN coalesce(sum(b) OVER w, 0) END AS m FROM g
  WINDOW w AS (PARTITION BY {KS}, year ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {KS}, year, CAST(month AS INT) AS month, round(stock - m, 6) AS stock_monthly FROM r JOIN s USING ({KS}, year) WHERE kept""")
def stock_from_december(spark, sf):
    d = se.monthly_stock_from_december(*_flux_and_stock(spark, sf), K)
    return rounded(d.drop("value"), "stock_monthly")


@query("w08_stock_from_january", f"""
WITH {ad.field_gaps_sql()}, {_STOCK},
r AS (SELECT *, CASE WHEN count(CASE WHEN a IS NULL THEN 1 END) OVER w = (0) THEN coalesce(sum(a) OVER w, 0) END AS m FROM f
  WINDOW w AS (PARTITION BY {KS}, year ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT {KS}, year, CAST(month AS INT) AS month, round(stock + m, 6) AS stock_monthly FROM r JOIN s USING ({KS}, year) WHERE kept""")
def stock_from_january(spark, sf):
    d = se.monthly_stock_from_january(*_flux_and_stock(spark, sf), K)
    return rounded(d.drop("value"), "stock_monthly")


@query("w09_linear_trend", f"""
WITH {ad.field_gaps_sql()} SELECT {KS}, round(regr_slope(value, t), 8) AS slope, round(regr_intercept(value, t), 4) AS intercept FROM field GROUP BY ALL""")
def linear_trend(spark, sf):
    return rounded(rounded(se.linear_trend(ad.field_gaps(spark, sf), K), "slope", n=8), "intercept", n=4)


_ANNUAL_X = f"""
a AS (SELECT {KS}, year, avg(value) AS value FROM field GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY year) - 1 AS x FROM a),
tr AS (SELECT {KS}, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept FROM x GROUP BY ALL)"""


@query("w10_annual_trend", f"WITH {FM}, {_ANNUAL_X} SELECT {KS}, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM tr")
def annual_trend(spark, sf):
    return rounded(se.annual_trend(ad.field_month(spark, sf), K), "slope", "intercept")


@query("w10_mean_trend", f"WITH {FM}, {_ANNUAL_X} SELECT source, round(avg(slope), 6) AS slope, round(avg(intercept), 6) AS intercept FROM tr GROUP BY source")
def mean_trend(spark, sf):
    return rounded(se.mean_trend(ad.field_month(spark, sf), ["source"]), "slope", "intercept")


@query("w11_deseasonalised_trend", f"""
WITH {FM}, a AS (SELECT *, value - avg(value) OVER (PARTITION BY {KS}, month) AS an, t // 365 + 1901 + (t % 365) / 365.0 AS x FROM field)
SELECT {KS}, round(regr_slope(an, x), 5) AS slope_per_year FROM a GROUP BY ALL""")
def deseasonalised_trend(spark, sf):
    return rounded(se.deseasonalised_trend(ad.field_month(spark, sf), K), "slope_per_year", n=5)


@query("w11_annual_mean_trend", f"""
WITH {ad.field_gaps_sql()}, a AS (SELECT {KS}, year, avg(CASE WHEN year = 1998 AND lat_idx % 9 = 0 THEN NULL ELSE value END) AS value FROM field GROUP BY ALL)
SELECT {KS}, round(regr_slope(value, year), 6) AS slope_per_year,
  round(count(value) * covar_pop(value, CAST(year AS DOUBLE)) / (count(*) * var_pop(year)), 6) AS slope_all_steps FROM a GROUP BY ALL""")
def annual_mean_trend(spark, sf):
    gone = (F.col("year") == 1998) & (F.pmod("lat_idx", F.lit(9)) == 0)
    f = ad.field_gaps(spark, sf).withColumn("value", F.when(~gone, F.col("value")))
    a = se.annual_mean_trend(f, K)
    b = se.annual_mean_trend(f, K, gaps="all_steps").withColumnRenamed("slope_per_year", "slope_all_steps")
    return rounded(a.join(b, K), "slope_per_year", "slope_all_steps")


_DETREND = f"""
d AS (SELECT *, value - (regr_slope(value, t) OVER w * t + regr_intercept(value, t) OVER w) AS detrended FROM field WINDOW w AS (PARTITION BY {KS}))"""


@query("w12_detrend", f"WITH {FM}, {_DETREND} SELECT {KS}, t, round(detrended, 5) AS detrended FROM d")
def detrend(spark, sf):
    return rounded(se.detrend(ad.field_month(spark, sf), K).select(*K, "t", "detrended"), "detrended", n=5)


@query("w13_seasonal_component", f"""
WITH {FM}, {_DETREND} SELECT {KS}, t, round(avg(detrended) OVER (PARTITION BY {KS}, month), 5) AS seasonal FROM d""")
def seasonal_component(spark, sf):
    d = se.seasonal_component(se.detrend(ad.field_month(spark, sf), K), K, whole_years=False)
    return rounded(d.select(*K, "t", "seasonal"), "seasonal", n=5)


@query("w14_anomaly", f"WITH {FM} SELECT {KS}, t, round(value - avg(value) OVER (PARTITION BY {KS}, month), 6) AS anomaly FROM field")
def anomaly(spark, sf):
    return rounded(se.anomaly(ad.field_month(spark, sf), K).select(*K, "t", "anomaly"), "anomaly")


@query("w15_interannual_variability", f"""
WITH {FM}, {_DETREND} SELECT {KS}, t, round(detrended - avg(detrended) OVER (PARTITION BY {KS}, month), 5) AS iav FROM d""")
def interannual_variability(spark, sf):
    d = se.interannual_variability(ad.field_month(spark, sf), K, whole_years=False)
    return rounded(d.select(*K, "t", "iav"), "iav", n=5)


@query("w16_annual_anomalies", f"""
WITH {FY}, k AS (SELECT *, CASE WHEN lat_idx % 9 = 0 AND year > 1995 THEN NULL ELSE value END AS v FROM field),
d AS (SELECT *, count(v) OVER w AS n, v - avg(v) OVER w AS c, v - (regr_slope(v, year) OVER w * year + regr_intercept(v, year) OVER w) AS r FROM k WINDOW w AS (PARTITION BY {KS}))
SELECT {KS}, year, round(CASE WHEN n < 2 THEN c ELSE r END, 5) AS anomaly FROM d""")
def annual_anomalies(spark, sf):
    gone = (F.pmod("lat_idx", F.lit(9)) == 0) & (F.col("year") > 1995)
    f = _yearly(spark, sf).withColumn("value", F.when(~gone, F.col("value")))
    return rounded(se.annual_anomalies(f, K).drop("value"), "anomaly", n=5)


@query("w17_cellwise_variability", f"""
WITH {FM}, {_ANNUAL_X}, r AS (SELECT source, year, value - (slope * x + intercept) AS r FROM x JOIN tr USING ({KS}))
SELECT source, year, round(avg(r), 6) AS iav FROM r GROUP BY ALL""")
def cellwise_variability(spark, sf):
    return rounded(se.cellwise_variability(ad.field_month(spark, sf), ["source"]), "iav")


@query("w18_rebuild_series", f"""
WITH {ad.field_sql("source", "year")}, x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY year) - 1 AS x FROM field),
tr AS (SELECT source, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept FROM x GROUP BY source)
SELECT source, year, round(slope * x + intercept, 6) AS line, round(value, 6) AS rebuilt FROM x JOIN tr USING (source)""")
def rebuild_series(spark, sf):
    x = se.with_position(ad.field(spark, sf, "source", "year"), ["source"])
    trend = se.linear_trend(x, ["source"], x="x")
    res = se.detrend(x, ["source"], x="x", out="iav")
    d = se.rebuild_series(trend, res, ["source"])
    return rounded(d.select("source", "year", "line", "rebuilt"), "line", "rebuilt")


@query("w19_positions_to_years", f"""
WITH {FM}, s AS (SELECT source, t, avg(value) AS value FROM field GROUP BY ALL), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY t) - 1 + 1901 AS INT) AS year FROM s)
SELECT source, year, round(value, 6) AS value FROM p WHERE year BETWEEN 1950 AND 1970""")
def positions_to_years(spark, sf):
    s = ad.field_month(spark, sf).groupBy("source", "t").agg(F.avg("value").alias("value"))
    return rounded(se.positions_to_years(s, ["source"], 1901, 1950, 1970).drop("t"), "value")
