"""Calendar and time axis."""

from pyspark.sql import functions as F

from gridspark.functions import noleap as nl
from gridspark.operators import time_axis as ta
from gridspark.queries.registry import query, rounded
from gridspark.sources import adapters as ad

K = ad.MONTHLY_KEYS
KS = ", ".join(K)


@query("t01_noleap_axis", f"""
WITH years AS (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS year FROM lineitem),
days AS (SELECT year, unnest(range(1, 366)) AS doy FROM years),
m AS (SELECT year, doy, {ad.month_of_doy_sql("doy")} AS month FROM days)
SELECT CAST((year - 1901) * 365 + doy - 1 AS INT) AS t, year, CAST(month AS INT) AS month, CAST(doy AS INT) AS doy,
  {ad.LEN_SQL}[CAST(month AS INT)] AS days_in_month, CAST({ad.LEN_SQL}[CAST(month AS INT)] * 86400.0 AS DOUBLE) AS seconds_in_month FROM m""")
def noleap_axis(spark, sf):
    years = ad.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return ta.axis_for_years(years, "day")


@query("t01_month_and_year_axes", f"""
WITH years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders),
m AS (SELECT year, CAST(unnest(range(1, 13)) AS INT) AS month FROM years)
SELECT 'month_end' AS axis, CAST((year - 1901) * 365 + {ad.CUM_SQL}[month] + {ad.LEN_SQL}[month] - 1 AS INT) AS t, year, month FROM m
UNION ALL SELECT 'month_start', CAST((year - 1901) * 365 + {ad.CUM_SQL}[month] AS INT), year, month FROM m
UNION ALL SELECT 'year_start', CAST((year - 1901) * 365 AS INT), year, 1 FROM years
UNION ALL SELECT 'year_end', CAST((year - 1901) * 365 + 364 AS INT), year, 12 FROM years""")
def month_and_year_axes(spark, sf):
    years = ad.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    parts = [ta.axis_for_years(years, r, a).select(F.lit(f"{r}_{a}").alias("axis"), "t", "year", "month")
             for r in ("month", "year") for a in ("start", "end")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("t02_date_strings", f"""
WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS s, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT *, CAST(s[1:4] AS INT) AS y, CAST(s[6:7] AS INT) AS m, CAST(s[9:10] AS INT) AS dd FROM d)
SELECT s AS date_in, CAST((y - 1901) * 365 + {ad.CUM_SQL}[m] + dd - 1 AS INT) AS t,
  CASE WHEN m = 2 AND dd = 29 THEN printf('%04d-03-01', y) ELSE s END AS date_out, n FROM p""")
def date_strings(spark, sf):
    d = ad.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_in")).agg(
        F.count(F.lit(1)).alias("n"))
    d = d.withColumn("t", nl.date_string_to_day("date_in"))
    return d.withColumn("date_out", nl.day_to_date_string("t"))


@query("t03_rebase_origin", f"""
WITH d AS (SELECT DISTINCT CAST((year(o_orderdate) - 1850) * 365 + {ad.CUM_SQL}[month(o_orderdate)] AS INT) AS t1850 FROM orders)
SELECT t1850, CAST(t1850 - 18615 AS INT) AS t FROM d""")
def rebase_origin(spark, sf):
    old = ((F.year("o_orderdate") - 1850) * 365 + nl.month_start(F.month("o_orderdate"))).cast("int")
    d = ad.table(spark, sf, "orders").select(old.alias("t1850")).distinct()
    return d.withColumn("t", nl.rebase("t1850", 1850))


@query("t04_dates_to_noleap", f"""
WITH p AS (SELECT o_totalprice, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, day(o_orderdate) AS d FROM orders)
SELECT year, month, CAST((year - 1901) * 365 + {ad.CUM_SQL}[month] + (CASE WHEN month = 2 AND d = 29 THEN 28 ELSE d END) - 1 AS INT) AS t,
  round(avg(o_totalprice / 7.302), 6) AS value FROM p GROUP BY ALL""")
def dates_to_noleap(spark, sf):
    d = ta.to_day_numbers(ad.table(spark, sf, "orders"), "o_orderdate")
    return rounded(d.groupBy("year", "month", "t").agg(F.avg(F.col("o_totalprice") / 7.302).alias("value")), "value")


@query("t04_clamped_days", f"""
SELECT CAST((year(o_orderdate) - 1901) * 365 + {ad.CUM_SQL}[month(o_orderdate)] + least(day(o_orderdate), 28) - 1 AS INT) AS t,
  count(*) AS n FROM orders GROUP BY 1""")
def clamped_days(spark, sf):
    d = ta.to_day_numbers(ad.table(spark, sf, "orders"), "o_orderdate", leap_day="clamp28")
    return d.groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@query("t05_replace_axis", f"""
WITH {ad.field_sql("source", "year")},
p AS (SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY year) AS pos FROM field)
SELECT source, CAST((1901 + pos - 1 - 1901) * 365 AS INT) AS t, round(value, 6) AS value FROM p""")
def replace_axis(spark, sf):
    d = ad.field(spark, sf, "source", "year").withColumn("t", nl.day_number("year"))
    years = ad.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y")).distinct()
    span = years.agg((F.count(F.lit(1)) + 1900).cast("int").alias("last"))
    axis = ta.axis_for_years(span.select(F.explode(F.sequence(F.lit(1901), F.col("last"))).alias("year")), "year")
    axis = axis.withColumn("pos", F.col("year") - 1900)
    return rounded(ta.replace_axis(d, ["source"], axis).select("source", "t", "value"), "value")


@query("t06_year_file_days", f"""
WITH d AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST({ad.CUM_SQL}[month(l_shipdate)]
  + CASE WHEN month(l_shipdate) = 2 AND day(l_shipdate) = 29 THEN 28 ELSE day(l_shipdate) END - 1 AS INT) AS i, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT year, i, CAST((year - 1901) * 365 + i AS INT) AS t, n FROM d""")
def year_file_days(spark, sf):
    d = ad.table(spark, sf, "lineitem").groupBy(
        F.year("l_shipdate").alias("year"), F.pmod(nl.date_to_day("l_shipdate"), F.lit(365)).cast("int").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("t", nl.year_file_day("year", F.col("i")))


@query("t07_floor_times", """
SELECT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0) AS BIGINT) AS day, count(*) AS n
FROM events GROUP BY 1""")
def floor_times(spark, sf):
    us = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    d = ad.table(spark, sf, "events").select((us / 86400000000.0).alias("t"))
    return d.groupBy(F.floor("t").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("t08_trim", f"""
WITH {ad.field_month_sql()},
p AS (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY {KS}) AS n FROM field)
SELECT {KS}, t, round(value, 6) AS value FROM p WHERE p >= n - 24 AND p < n - 3""")
def trim(spark, sf):
    d = ta.trim(ad.field_month(spark, sf), K, -24, -3)
    return rounded(d.select(*K, "t", "value"), "value")


@query("t09_infer_cadence", f"""
WITH {ad.field_month_sql()},
y AS (SELECT 'year_' || source AS series, (year - 1901) * 365 AS t FROM field GROUP BY ALL),
m AS (SELECT 'month_' || source AS series, t FROM field GROUP BY ALL),
d AS (SELECT 'day_' || event_type AS series, CAST((year(ts) - 1901) * 365 + {ad.CUM_SQL}[month(ts)] + day(ts) - 1 AS INT) AS t FROM events GROUP BY ALL),
a AS (SELECT * FROM y UNION ALL SELECT * FROM m UNION ALL SELECT * FROM d),
s AS (SELECT series, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS step FROM a),
g AS (SELECT series, count(*) AS n_steps, CAST(trunc(median(CAST(step AS DOUBLE))) AS INT) AS median_step FROM s GROUP BY series)
SELECT series, n_steps, median_step, CASE WHEN n_steps < 3 THEN 'monthly' WHEN median_step BETWEEN 360 AND 370 THEN 'annual'
  WHEN median_step = 1 THEN 'daily' ELSE 'monthly' END AS cadence FROM g""")
def infer_cadence(spark, sf):
    f = ad.field_month(spark, sf)
    y = f.select(F.concat(F.lit("year_"), "source").alias("series"), nl.day_number("year").alias("t")).distinct()
    m = f.select(F.concat(F.lit("month_"), "source").alias("series"), "t").distinct()
    d = ad.table(spark, sf, "events").select(
        F.concat(F.lit("day_"), "event_type").alias("series"), nl.date_to_day("ts").alias("t")).distinct()
    return ta.infer_cadence(y.unionByName(m).unionByName(d), ["series"])


@query("t10_day_to_month", f"""
WITH {ad.field_day_sql()}
SELECT variable, lat_idx, lon_idx, CAST(t // 365 + 1901 AS INT) AS year,
  {ad.month_of_doy_sql("t % 365 + 1")} AS month,
  round(avg(value), 6) AS value FROM field GROUP BY ALL""")
def day_to_month(spark, sf):
    d = ad.field_day(spark, sf).withColumns({"year": nl.year_of("t"), "month": nl.month_of("t")})
    return rounded(ta.day_to_month(d, ["variable", "lat_idx", "lon_idx"]), "value")


@query("t11_annual_mean", f"""
WITH {ad.field_month_sql()} SELECT {KS}, year, round(avg(value), 6) AS value FROM field GROUP BY ALL""")
def annual_mean(spark, sf):
    return rounded(ta.to_annual(ad.field_month(spark, sf), K), "value")


@query("t12_daily_mean", """
SELECT event_type AS variable, CAST(ts AS DATE) AS date, round(avg(value / 7.302), 6) AS value FROM events GROUP BY ALL""")
def daily_mean(spark, sf):
    d = ad.table(spark, sf, "events").select(F.col("event_type").alias("variable"), "ts", (F.col("value") / 7.302).alias("value"))
    return rounded(ta.subdaily_to_daily(d, ["variable"], "ts"), "value")


@query("t13_annual_to_monthly", f"""
WITH {ad.field_sql("source", "cell", "year")}
SELECT {KS}, year, CAST(unnest(range(1, 13)) AS INT) AS month, round(value, 6) AS value FROM field""")
def annual_to_monthly(spark, sf):
    return rounded(ta.annual_to_monthly(ad.field(spark, sf, "source", "cell", "year")), "value")


@query("t14_hold_to_daily", f"""
WITH {ad.field_sql("source", "year", "month")},
m AS (SELECT source, year, month, value, unnest(range(1, 32)) AS d FROM field),
md AS (SELECT source, 'month' AS res, CAST((year - 1901) * 365 + {ad.CUM_SQL}[month] + d - 1 AS INT) AS t, value FROM m WHERE d <= {ad.LEN_SQL}[month]),
a AS (SELECT source, year, avg(value) AS value FROM field GROUP BY ALL),
yd AS (SELECT source, 'year' AS res, CAST((year - 1901) * 365 + unnest(range(0, 365)) AS INT) AS t, value FROM a)
SELECT source, res, t, round(value, 6) AS value FROM (SELECT * FROM md UNION ALL SELECT * FROM yd)""")
def hold_to_daily(spark, sf):
    f = ad.field(spark, sf, "source", "year", "month")
    m = ta.monthly_to_daily(f).select("source", F.lit("month").alias("res"), "t", "value")
    y = ta.annual_to_daily(ta.to_annual(f, ["source"])).select("source", F.lit("year").alias("res"), "t", "value")
    return rounded(m.unionByName(y), "value")


@query("t15_flat_within_year", f"""
WITH {ad.field_month_sql()}
SELECT {KS}, year, month, round(avg(value) OVER (PARTITION BY {KS}, year), 6) AS value FROM field""")
def flat_within_year(spark, sf):
    return rounded(ta.flat_within_year(ad.field_month(spark, sf), K).drop("t"), "value")


@query("t16_stretch_static", f"""
WITH {ad.CELLS_SQL} SELECT lat_idx, lon_idx, CAST(unnest(range(1901, 1911)) AS INT) AS year, round(value, 6) AS value FROM cells""")
def stretch_static(spark, sf):
    return rounded(ta.stretch_static(ad.cells(spark, sf).select("lat_idx", "lon_idx", "value"), 1901, 1910), "value")


@query("t17_repeat_last", f"""
WITH {ad.field_sql("source", "cell", "year")},
p AS (SELECT *, year - lag(year) OVER w AS step, row_number() OVER (PARTITION BY {KS} ORDER BY year DESC) AS rn
  FROM field WINDOW w AS (PARTITION BY {KS} ORDER BY year))
SELECT {KS}, year, round(value, 6) AS value FROM field
UNION ALL SELECT {KS}, CAST(year + i * coalesce(step, 1) AS INT), round(value, 6) FROM p, (SELECT unnest([1, 2, 3]) AS i) WHERE rn = 1""")
def repeat_last(spark, sf):
    d = ta.repeat_last(ad.field(spark, sf, "source", "cell", "year"), K, 3, order="year")
    return rounded(d, "value")


@query("t18_cycle_first", f"""
WITH {ad.field_sql("source", "cell", "year")}, n AS (SELECT 3 AS n),
y AS (SELECT CAST(unnest(range(1995, 2024)) AS INT) AS year)
SELECT {KS}, y.year, round(value, 6) AS value FROM y JOIN field f ON f.year - 1995 = (y.year - 1995) % 3 AND f.year BETWEEN 1995 AND 1997""")
def cycle_first(spark, sf):
    return rounded(ta.cycle_first(ad.field(spark, sf, "source", "cell", "year"), 3, 1995, 2023), "value")


@query("t19_irregular_to_annual", f"""
WITH {ad.field_month_sql()},
s AS (SELECT source, t, avg(value) AS value FROM field GROUP BY ALL),
p AS (SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS pos FROM s),
y AS (SELECT CAST(unnest(range(1901, 2024)) AS INT) AS year),
m AS (SELECT year, CASE WHEN year <= 1908 THEN 0 WHEN year <= 1948 THEN 1 + (year - 1909) // 10 ELSE year - 1949 + 5 END AS idx FROM y)
SELECT source, year, round(value, 6) AS value FROM p JOIN m ON pos = idx""")
def irregular_to_annual(spark, sf):
    s = ad.field_month(spark, sf).groupBy("source", "t").agg(F.avg("value").alias("value"))
    s = s.withColumn("year", F.lit(0))
    years = spark.range(1901, 2024).select(F.col("id").cast("int").alias("year"))
    index = years.withColumn("src_idx", ta.population_index(F.col("year")))
    return rounded(ta.irregular_to_annual(s, ["source"], index), "value")


@query("t20_year_month_key", f"""
WITH {ad.field_month_sql()} SELECT source, CAST(year * 100 + month AS INT) AS ym, round(avg(value), 6) AS value FROM field GROUP BY ALL""")
def year_month_key(spark, sf):
    return rounded(ta.average_duplicate_months(ad.field_month(spark, sf), ["source"]), "value")


@query("t21_fractional_year", f"""
WITH {ad.field_day_sql()}
SELECT t, round(t // 365 + 1901 + (t % 365) / 365.0, 9) AS frac_year, count(*) AS n FROM field GROUP BY ALL""")
def fractional_year(spark, sf):
    d = ad.field_day(spark, sf).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("frac_year", F.round(nl.fractional_year("t"), 9))
