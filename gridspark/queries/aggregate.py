"""Space, time and ensemble aggregation."""

from pyspark.sql import functions as F

from gridspark.functions.ranking import exact_quantiles, merge_sketches, quantile_sketches
from gridspark.functions.sizing import stored
from gridspark.operators import aggregates as ag, masks as mk
from gridspark.queries.registry import AREA, AREA_COS, LAT, SECONDS_MEAN_MONTH, query, rounded
from gridspark.sources import adapters as ad

K = ad.MONTHLY_KEYS
KS = ", ".join(K)
FM = ad.field_month_sql()
BANDS = ["band_min", "band_max", "p50_low", "p50_high", "p75_low", "p75_high"]


def bands_sql(v="value"):
    return (f"round(min({v}), 6) AS band_min, round(max({v}), 6) AS band_max, round(quantile_cont({v}, 0.25), 6) AS p50_low, "
            f"round(quantile_cont({v}, 0.75), 6) AS p50_high, round(quantile_cont({v}, 0.125), 6) AS p75_low, round(quantile_cont({v}, 0.875), 6) AS p75_high")


@query("a01_time_mean", f"WITH {FM} SELECT {KS}, round(avg(value), 6) AS value FROM field GROUP BY ALL")
def time_mean(spark, sf):
    return rounded(ag.time_mean(ad.field_month(spark, sf), K), "value")


@query("a02_space_mean", f"WITH {FM} SELECT source, t, round(avg(value), 6) AS value FROM field GROUP BY ALL")
def space_mean(spark, sf):
    return rounded(ag.space_mean(ad.field_month(spark, sf), ["source", "t"]), "value")


@query("a03_cos_weighted_mean", f"""
WITH {ad.field_gaps_sql()}, w AS (SELECT *, cos(radians({LAT})) AS w FROM field)
SELECT source, t, round(sum(w * value) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) AS value FROM w GROUP BY ALL""")
def cos_weighted_mean(spark, sf):
    return rounded(ag.space_mean_cos(ad.field_gaps(spark, sf), ["source", "t"]), "value")


@query("a04_annual_mean_two_stage", f"""
WITH {FM}, m AS (SELECT source, year, month, avg(value) AS value FROM field GROUP BY ALL) SELECT source, year, round(avg(value), 6) AS value FROM m GROUP BY ALL""")
def annual_mean_two_stage(spark, sf):
    return rounded(ag.annual_mean_of_space_mean(ad.field_month(spark, sf), ["source"]), "value")


@query("a05_annual_totals", f"""
WITH {ad.field_gaps_sql()}, {ad.CELLS_SQL}, m AS (SELECT f.source, f.year, lat_idx, CASE WHEN tvt IN (0, 2) THEN f.value END AS value FROM field f LEFT JOIN cells USING (lat_idx, lon_idx))
SELECT source, year, round(coalesce(sum(value * {AREA}), 0) * {SECONDS_MEAN_MONTH} / 1e12, 3) AS total FROM m GROUP BY ALL""")
def annual_totals(spark, sf):
    f = mk.apply_mask(ad.field_gaps(spark, sf), ad.cells(spark, sf), [0, 2])
    return rounded(ag.annual_totals(f, ["source"]), "total", n=3)


ENSEMBLE_REPORT_SQL = f"""
WITH {ad.field_gaps_sql()}, {ad.CELLS_SQL}, m AS (SELECT f.source, f.year, lat_idx, CASE WHEN tvt IN (0, 2) THEN f.value END AS value FROM field f LEFT JOIN cells USING (lat_idx, lon_idx)),
v AS (SELECT source, year, coalesce(sum(value * {AREA}), 0) * {SECONDS_MEAN_MONTH} / 1e12 AS value FROM m GROUP BY ALL)
SELECT year, {bands_sql().replace(', 6)', ', 3)')} FROM v GROUP BY year"""


@query("a05_budget_with_bands", ENSEMBLE_REPORT_SQL)
def budget_with_bands(spark, sf):
    """Masked annual totals per model, then the range and bands across models."""
    f = mk.apply_mask(ad.field_gaps(spark, sf), ad.cells(spark, sf), [0, 2])
    totals = ag.annual_totals(f, ["source"])
    return rounded(ag.ensemble_bands(totals, ["year"], "total"), *BANDS, n=3)


@query("a06_period_totals", f"""
WITH {FM}, y AS (SELECT source, year, sum(value * {AREA}) * {SECONDS_MEAN_MONTH} / 1e12 AS total FROM field GROUP BY ALL)
SELECT source, round(sum(total), 2) AS total, round(avg(total), 2) AS mean_per_year FROM y GROUP BY ALL""")
def period_totals(spark, sf):
    return rounded(ag.period_totals(ad.field_month(spark, sf), ["source"]), "total", "mean_per_year", n=2)


@query("a07_monthly_climatology", f"WITH {FM} SELECT {KS}, month, round(avg(value), 6) AS value FROM field GROUP BY ALL")
def monthly_climatology(spark, sf):
    return rounded(ag.monthly_climatology(ad.field_month(spark, sf), K), "value")


@query("a08_seasonal_cycle_two_stage", f"""
WITH {FM}, m AS (SELECT source, year, month, avg(value) AS value FROM field GROUP BY ALL) SELECT source, month, round(avg(value), 6) AS value FROM m GROUP BY ALL""")
def seasonal_cycle_two_stage(spark, sf):
    return rounded(ag.seasonal_cycle_two_stage(ad.field_month(spark, sf), ["source"]), "value")


@query("a08_seasonal_cycle_one_pass", f"WITH {FM} SELECT source, month, round(avg(value), 6) AS value FROM field GROUP BY ALL")
def seasonal_cycle_one_pass(spark, sf):
    return rounded(ag.seasonal_cycle_one_pass(ad.field_month(spark, sf), ["source"]), "value")


@query("a09_doy_climatology", f"""
WITH {ad.field_day_sql()} SELECT variable, lat_idx, lon_idx, CAST(t % 365 + 1 AS INT) AS doy, round(avg(value), 6) AS value FROM field GROUP BY ALL""")
def doy_climatology(spark, sf):
    return rounded(ag.doy_climatology(ad.field_day(spark, sf), ["variable", "lat_idx", "lon_idx"]), "value")


@query("a10_latitude_rows", f"WITH {FM} SELECT source, lat_idx, {LAT} AS lat, round(avg(value), 6) AS value FROM field GROUP BY ALL")
def latitude_rows(spark, sf):
    return rounded(ag.latitude_row_means(ad.field_month(spark, sf), ["source"]), "value")


@query("a10_latitude_bands", f"WITH {FM} SELECT source, CAST(floor({LAT}) + 0.5 AS DOUBLE) AS lat_band, round(avg(value), 6) AS value FROM field GROUP BY ALL")
def latitude_bands(spark, sf):
    return rounded(ag.latitude_band_means(ad.field_month(spark, sf), ["source"]), "value")


@query("a11_latitude_weights", f"""
WITH {ad.CELLS_SQL}, n AS (SELECT lat_idx, CAST(sum(CASE WHEN tvt = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_test FROM cells GROUP BY lat_idx)
SELECT lat_idx, n_test, round(n_test * {AREA_COS} / 1e6, 4) AS weight FROM n""")
def latitude_weights(spark, sf):
    d = ag.latitude_weights(ad.cells(spark, sf))
    return d.withColumn("weight", F.round(F.col("weight") / 1e6, 4))


@query("a12_global_mean_from_rows", f"""
WITH {ad.field_sql("source", "scenario", "cell", "year")}, {ad.CELLS_SQL}, r AS (SELECT source, scenario, lat_idx, avg(value) AS value FROM field GROUP BY ALL),
n AS (SELECT lat_idx, sum(CASE WHEN tvt = 2 THEN 1 ELSE 0 END) * {AREA_COS} AS w FROM cells GROUP BY lat_idx)
SELECT source, round(sum(w * value) / sum(w), 6) AS value FROM r JOIN n USING (lat_idx) WHERE w > 0 GROUP BY source""")
def global_mean_from_rows(spark, sf):
    rows = ag.latitude_row_means(ad.field(spark, sf, "source", "scenario", "cell", "year"), ["source", "scenario"])
    d = ag.global_mean_from_rows(rows, ag.latitude_weights(ad.cells(spark, sf)), ["source"])
    return rounded(d, "value")


@query("a13_ensemble_mean", f"""
WITH {ad.field_gaps_sql()} SELECT lat_idx, lon_idx, t, round(CASE WHEN count(value) = 4 THEN avg(value) END, 6) AS value FROM field GROUP BY ALL""")
def ensemble_mean(spark, sf):
    return rounded(ag.ensemble_mean(ad.field_gaps(spark, sf), ["lat_idx", "lon_idx", "t"], 4), "value")


@query("a14_scenario_mean", f"""
WITH {ad.field_vars_sql("scenario", "cell", "year")} SELECT variable, lat_idx, lon_idx, year, round(avg(value), 6) AS value FROM field GROUP BY ALL""")
def scenario_mean(spark, sf):
    return rounded(ag.scenario_mean(ad.field_vars(spark, sf, "scenario", "cell", "year"), ["variable", "lat_idx", "lon_idx", "year"]), "value")


@query("a15_ensemble_bands", f"WITH {ad.field_sql('source', 'year', 'month')} SELECT year, month, {bands_sql()} FROM field GROUP BY ALL")
def ensemble_bands(spark, sf):
    return rounded(ag.ensemble_bands(ad.field(spark, sf, "source", "year", "month"), ["year", "month"]), *BANDS)


@query("a16_box_statistics", f"""
WITH {ad.field_sql("source", "scenario", "year")}, s AS (SELECT scenario, source, sum(value) AS v FROM field GROUP BY ALL)
SELECT scenario, round(median(v), 6) AS median, {bands_sql("v")} FROM s GROUP BY scenario""")
def box_statistics(spark, sf):
    return rounded(ag.box_statistics(ad.field(spark, sf, "source", "scenario", "year"), ["scenario"]), "median", *BANDS)


@query("a17_bands_of_scenario_means", f"""
WITH {ad.field_sql("source", "scenario", "year")}, s AS (SELECT source, year, avg(value) AS value FROM field GROUP BY ALL) SELECT year, {bands_sql()} FROM s GROUP BY year""")
def bands_of_scenario_means(spark, sf):
    return rounded(ag.bands_of_scenario_means(ad.field(spark, sf, "source", "scenario", "year"), ["year"]), *BANDS)


@query("a18_scenario_means_of_bands", f"""
WITH {ad.field_sql("source", "scenario", "year")}, k AS (SELECT * FROM field WHERE NOT (scenario = 'S2' AND year = 1997)),
b AS (SELECT scenario, year, {bands_sql().replace('round(', '(').replace(', 6)', ')')} FROM k GROUP BY ALL)
SELECT year, {", ".join(f"round(avg({c}), 6) AS {c}" for c in BANDS)} FROM b GROUP BY year HAVING count(*) = 4""")
def scenario_means_of_bands(spark, sf):
    f = ad.field(spark, sf, "source", "scenario", "year").filter("NOT (scenario = 'S2' AND year = 1997)")
    return rounded(ag.scenario_means_of_bands(f, ["year"], 4), *BANDS)


_MOMENTS = ("round(sum(v), 3) AS sum, round(sum(v * v), 1) AS sumsq, round(min(v), 6) AS min, round(max(v), 6) AS max, "
            "round(avg(v), 6) AS mean, round(stddev_pop(v), 4) AS std")


def _scaled(spark, sf):
    return ad.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("variable"), "l_suppkey", (F.col("l_extendedprice") / 365.2425).alias("value"))


def _round_moments(d):
    d = rounded(rounded(rounded(d, "sum", n=3), "sumsq", n=1), "min", "max", "mean")
    return rounded(d, "std", n=4)


@query("a19_moments", f"""
WITH p AS (SELECT l_returnflag AS variable, l_extendedprice / 365.2425 AS v FROM lineitem) SELECT variable, count(*) AS n, {_MOMENTS} FROM p GROUP BY ALL""")
def moments(spark, sf):
    return _round_moments(ag.finish_moments(ag.moments(_scaled(spark, sf))))


@query("a20_merge_moments", f"""
WITH p AS (SELECT l_returnflag AS variable, l_extendedprice / 365.2425 AS v FROM lineitem) SELECT variable, count(*) AS n, {_MOMENTS} FROM p GROUP BY ALL""")
def merge_moments(spark, sf):
    shards = ag.moments(_scaled(spark, sf).withColumn("shard", F.pmod("l_suppkey", F.lit(16))), ["variable", "shard"])
    return _round_moments(ag.merge_moments(shards))


@query("a21_residual_statistics", f"""
WITH {ad.PAIRS_SQL}, r AS (SELECT variable, (yhat - y) / 365.2425 AS v FROM pairs)
SELECT variable, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(abs(v)), 6) AS mean_abs, round(avg(v * v), 4) AS mse FROM r GROUP BY ALL""")
def residual_statistics(spark, sf):
    d = ad.pairs(spark, sf).withColumn("value", (F.col("yhat") - F.col("y")) / 365.2425)
    return rounded(rounded(ag.residual_statistics(d, ["variable"]), "mean", "std", "mean_abs"), "mse", n=4)


@query("a22_weighted_shard_mean", """
WITH s AS (SELECT l_returnflag AS variable, l_suppkey, avg(l_extendedprice / 365.2425) AS mean, max(l_linenumber) - min(l_linenumber) - 5 AS weight FROM lineitem GROUP BY ALL)
SELECT variable, round(sum(mean * weight) / sum(weight), 6) AS mean FROM s WHERE weight > 0 GROUP BY ALL""")
def weighted_shard_mean(spark, sf):
    s = ad.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("variable"), "l_suppkey").agg(
        F.avg(F.col("l_extendedprice") / 365.2425).alias("mean"), (F.max("l_linenumber") - F.min("l_linenumber") - 5).alias("weight"))
    return rounded(ag.weighted_shard_mean(s, ["variable"]), "mean")


@query("a23_binned_means", """
WITH d AS (SELECT l_quantity / 7.302 AS x, l_extendedprice / 365.2425 AS gpp, l_discount AS et FROM lineitem), m AS (SELECT max(x) AS top FROM d),
b AS (SELECT CAST(floor(x * 20 / top) AS INT) AS bin, gpp, et FROM d, m WHERE x >= 0 AND x < top),
e AS (SELECT CAST(unnest(range(0, 20)) AS INT) AS bin, top FROM m),
g AS (SELECT bin, count(*) AS n, avg(gpp) AS gm, stddev_pop(gpp) AS gs, avg(et) AS em, stddev_pop(et) AS es FROM b GROUP BY bin)
SELECT bin, round((bin + 0.5) * top / 20, 6) AS center, coalesce(n, 0) AS n, round(gm, 6) AS gpp_mean, round(gs, 6) AS gpp_std, round(em, 8) AS et_mean, round(es, 8) AS et_std
FROM e LEFT JOIN g USING (bin)""")
def binned_means(spark, sf):
    d = ad.table(spark, sf, "lineitem").select(
        (F.col("l_quantity") / 7.302).alias("x"), (F.col("l_extendedprice") / 365.2425).alias("gpp"), F.col("l_discount").alias("et"))
    return rounded(rounded(ag.binned_means(d, "x", ["gpp", "et"]), "center", "gpp_mean", "gpp_std"), "et_mean", "et_std", n=8)


@query("a24_histogram", """
WITH b AS (SELECT l_returnflag AS variable, least(CAST(floor((l_quantity - 1) / 7.0) AS INT), 6) AS bin FROM lineitem WHERE l_quantity BETWEEN 1 AND 50),
n AS (SELECT variable, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT variable, bin, n, round(n / (sum(n) OVER (PARTITION BY variable) * 7.0), 8) AS density FROM n""")
def histogram(spark, sf):
    d = ad.table(spark, sf, "lineitem").withColumn("variable", F.col("l_returnflag"))
    return rounded(ag.histogram(d, ["variable"], "l_quantity", 1.0, 50.0, 7, density=True), "density", n=8)


@query("a24_point_density", f"""
WITH {ad.PAIRS_SQL}, b AS (SELECT *, greatest(0, least(49, CAST(floor(y / 2000) AS INT))) AS bx, greatest(0, least(49, CAST(floor(yhat / 2000) AS INT))) AS by2 FROM pairs)
SELECT l_orderkey, l_linenumber, y, count(*) OVER (PARTITION BY variable, bx, by2) AS density FROM b""")
def point_density(spark, sf):
    d = ag.point_density(ad.pairs(spark, sf), "y", "yhat", (0.0, 100000.0), (0.0, 100000.0), 50, key="variable")
    return d.select("l_orderkey", "l_linenumber", "y", "density")


@query("a25_robust_limits", f"""
WITH {ad.PAIRS_SQL}, v AS (SELECT variable, y / 365.2425 AS a, (yhat - y) / 365.2425 AS r FROM pairs),
q AS (SELECT variable, quantile_cont(a, 0.01) AS lo, quantile_cont(a, 0.99) AS hi, min(a) AS mn, max(a) AS mx FROM v GROUP BY ALL),
s AS (SELECT variable, quantile_cont(abs(r), 0.99) AS p FROM v GROUP BY ALL)
SELECT variable, 'range' AS mode, round(CASE WHEN lo = hi THEN mn WHEN mn >= 0 THEN 0 ELSE lo END, 6) AS vmin, round(CASE WHEN lo = hi THEN mx ELSE hi END, 6) AS vmax FROM q
UNION ALL SELECT variable, 'symmetric', round(-CASE WHEN p > 0 THEN p ELSE 1 END, 6), round(CASE WHEN p > 0 THEN p ELSE 1 END, 6) FROM s""")
def robust_limits(spark, sf):
    d = ad.pairs(spark, sf).select("variable", (F.col("y") / 365.2425).alias("a"), ((F.col("yhat") - F.col("y")) / 365.2425).alias("r"))
    a = ag.robust_limits(d, ["variable"], "a").withColumn("mode", F.lit("range"))
    b = ag.symmetric_limits(d, ["variable"], "r").withColumn("mode", F.lit("symmetric"))
    return rounded(a.unionByName(b).select("variable", "mode", "vmin", "vmax"), "vmin", "vmax")


@query("a26_quantile_clip", f"""
WITH {ad.PAIRS_SQL} SELECT round(quantile_cont((yhat - y) / 365.2425, 0.02), 6) AS clip_low, round(quantile_cont((yhat - y) / 365.2425, 0.98), 6) AS clip_high FROM pairs""")
def quantile_clip(spark, sf):
    d = ad.pairs(spark, sf).select(((F.col("yhat") - F.col("y")) / 365.2425).alias("value"))
    return rounded(ag.quantile_clip(d, []), "clip_low", "clip_high")


@query("a25_limits_from_shards", f"""
WITH {ad.PAIRS_SQL}, q AS (SELECT variable, quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.5) AS mid, quantile_cont(y, 0.99) AS hi FROM pairs GROUP BY ALL)
SELECT variable, round(lo, 4) AS lo, round(mid, 4) AS mid, round(hi, 4) AS hi FROM q""")
def limits_from_shards(spark, sf):
    """Sketches of 30 shards, merged; the ranks they bracket are exact."""
    d = ad.pairs(spark, sf).select("variable", "y", F.pmod("l_suppkey", F.lit(30)).alias("shard"))
    merged = stored(merge_sketches(quantile_sketches(d, ["variable", "shard"], "y"), ["variable"]), "merged")
    return rounded(exact_quantiles(d, ["variable"], "y", [0.01, 0.5, 0.99], ["lo", "mid", "hi"], sketches=merged), "lo", "mid", "hi", n=4)


@query("a27_distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf):
    return ag.distinct_values(ad.table(spark, sf, "events"), "event_type")
