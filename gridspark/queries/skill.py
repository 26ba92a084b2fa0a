"""Skill metrics."""

import pandas as pd
from pyspark.sql import functions as F

from gridspark.operators import evaluate as ev, skill as sk
from gridspark.queries.registry import query, rounded
from gridspark.sources import adapters as ad

P = ad.PAIRS_SQL
_R2 = "1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(y))"
_RMSE = "sqrt(avg((yhat - y) * (yhat - y)))"


def _predict_pool(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"soil": 0.6 * frame["soil"] + 0.4 * frame["value"], "gpp": frame["value"] - 0.1 * frame["soil"]})


def _by_variable(spark, sf, **aggs):
    d = ad.pairs(spark, sf).groupBy("variable").agg(*[e.alias(n) for n, e in aggs.items()])
    return rounded(d, *aggs)


@query("k01_r2", f"WITH {P} SELECT variable, round({_R2}, 6) AS r2 FROM pairs GROUP BY ALL")
def r2(spark, sf):
    return _by_variable(spark, sf, r2=sk.r2())


@query("k02_rmse", f"WITH {P} SELECT variable, round({_RMSE}, 6) AS rmse FROM pairs GROUP BY ALL")
def rmse(spark, sf):
    return _by_variable(spark, sf, rmse=sk.rmse())


@query("k03_nrmse", f"WITH {P} SELECT variable, round({_RMSE} / stddev_pop(y), 6) AS nrmse FROM pairs GROUP BY ALL")
def nrmse(spark, sf):
    return _by_variable(spark, sf, nrmse=sk.nrmse())


@query("k04_acc", f"WITH {P} SELECT variable, round(corr(y, yhat), 6) AS acc FROM pairs GROUP BY ALL")
def acc(spark, sf):
    return _by_variable(spark, sf, acc=sk.acc())


@query("k05_metric_table", f"""
WITH {P}, m AS (SELECT variable, count(*) AS n, {_R2} AS r2, {_RMSE} / stddev_pop(y) AS nr, corr(y, yhat) AS acc FROM pairs GROUP BY ALL)
SELECT variable, n, round(r2, 6) AS "R2", round(nr, 6) AS "nRMSE", round(acc, 6) AS "ACC" FROM m
UNION ALL SELECT 'GLOBAL(equal_weight)', CAST(sum(n) AS BIGINT), round(avg(r2), 6), round(avg(nr), 6), round(avg(acc), 6) FROM m""")
def metric_table(spark, sf):
    return rounded(sk.metric_table(ad.pairs(spark, sf)), "R2", "nRMSE", "ACC")


_METRICS = f"""
WITH {P}, m AS (SELECT variable, count(*) AS n, {_R2} AS r2, {_RMSE} / stddev_pop(y) AS nr, corr(y, yhat) AS acc FROM pairs GROUP BY ALL)
SELECT variable, n, round(r2, 6) AS "R2", round(nr, 6) AS "nRMSE", round(acc, 6) AS "ACC" FROM m
UNION ALL SELECT 'GLOBAL(equal_weight)', CAST(sum(n) AS BIGINT), round(avg(r2), 6), round(avg(nr), 6), round(avg(acc), 6) FROM m"""


@query("k05_metric_table_from_shards", _METRICS)
def metric_table_from_shards(spark, sf):
    shards = sk.pair_moments(ad.pairs(spark, sf).withColumn("shard", F.pmod("l_orderkey", F.lit(40))), ["variable", "shard"])
    return rounded(sk.metric_table_of_moments(sk.merge_pair_moments(shards, ["variable"])), "R2", "nRMSE", "ACC")


@query("k08_skill_from_shards", f"""
WITH {P}, o AS (SELECT variable, y + 1e9 AS y, yhat + 1e9 AS yhat, y AS y0, yhat AS p0 FROM pairs)
SELECT variable, count(*) AS n, round(1 - sum((y0 - p0) * (y0 - p0)) / (count(*) * var_pop(y0)), 6) AS r2, round(sqrt(avg((p0 - y0) * (p0 - y0))), 4) AS rmse,
  round(stddev_samp(y0), 4) AS ref_std, round(stddev_samp(p0), 4) AS std, round(corr(y0, p0), 6) AS acc FROM o GROUP BY ALL""")
def skill_from_shards(spark, sf):
    """Values near 1e9: the metrics of the deviations all the same."""
    d = ad.pairs(spark, sf).withColumns({"y": F.col("y") + 1e9, "yhat": F.col("yhat") + 1e9, "shard": F.pmod("l_suppkey", F.lit(30))})
    m = sk.skill_of_moments(sk.merge_pair_moments(sk.pair_moments(d, ["variable", "shard"]), ["variable"]), ["variable"])
    return rounded(rounded(m.select("variable", "n", "r2", "rmse", "ref_std", "std", "acc"), "r2", "acc"), "rmse", "ref_std", "std", n=4)


_KEY = "source, lat_idx, lon_idx"


@query("k05_evaluation_modes", f"""
WITH RECURSIVE {ad.field_sql("source", "cell", "year", "month", name="v")}, {ad.field_sql("source", "cell", "year", "month", measure="npp", name="l0")}, {ad.field_sql("source", "cell", "year", measure="rh", name="st")},
l AS (SELECT {_KEY}, year, month, CASE WHEN value < 255 THEN value END AS y FROM l0), ok AS (SELECT {_KEY}, year FROM l GROUP BY ALL HAVING bool_and(y IS NOT NULL)),
y AS (SELECT {_KEY}, year, row_number() OVER (PARTITION BY {_KEY} ORDER BY year) AS i, avg(v.value) AS m, any_value(st.value) AS s0 FROM v JOIN st USING ({_KEY}, year) GROUP BY {_KEY}, year),
r(source, lat_idx, lon_idx, i, year, s, o) AS (SELECT {_KEY}, i, year, s0, 0.6 * s0 + 0.4 * m FROM y WHERE i = 1
  UNION ALL SELECT {_KEY}, y.i, y.year, r.o, 0.6 * r.o + 0.4 * y.m FROM r JOIN y USING ({_KEY}) WHERE y.i = r.i + 1),
p AS (SELECT 'teacher_forced' AS mode, {_KEY}, year, s0 AS s, 0.6 * s0 + 0.4 * m AS o FROM y UNION ALL SELECT 'full_sequence', {_KEY}, year, s, o FROM r
  UNION ALL SELECT 'tail_only', {_KEY}, y.year, 0.6 * q.s0 + 0.4 * q.m, 0.6 * (0.6 * q.s0 + 0.4 * q.m) + 0.4 * y.m FROM y JOIN (SELECT {_KEY}, i + 1 AS i, s0, m FROM y) q USING ({_KEY}, i)),
pairs AS (SELECT mode, 'gpp' AS variable, y, value - 0.1 * s AS yhat FROM p JOIN v USING ({_KEY}, year) JOIN l USING ({_KEY}, year, month) JOIN ok USING ({_KEY}, year)
  UNION ALL SELECT mode, 'soil', a.y, o FROM p JOIN (SELECT {_KEY}, year, avg(y) AS y FROM l GROUP BY ALL) a USING ({_KEY}, year) JOIN ok USING ({_KEY}, year)),
m AS (SELECT mode, variable, count(*) AS n, {_R2} AS r2, {_RMSE} / stddev_pop(y) AS nr, corr(y, yhat) AS acc FROM pairs GROUP BY ALL)
SELECT mode, variable, n, round(r2, 6) AS "R2", round(nr, 6) AS "nRMSE", round(acc, 6) AS "ACC" FROM m
UNION ALL SELECT mode, 'GLOBAL(equal_weight)', CAST(sum(n) AS BIGINT), round(avg(r2), 6), round(avg(nr), 6), round(avg(acc), 6) FROM m GROUP BY mode""")
def evaluation_modes(spark, sf):
    """One predictor from given states, carried over all years, and after a run-up of one year."""
    key, by = ["source", "lat_idx", "lon_idx"], ("source", "cell", "year")
    table = ad.field(spark, sf, *by, "month").join(ad.field(spark, sf, *by, measure="rh").withColumnRenamed("value", "start_soil"), [*key, "year"])
    label = ad.field(spark, sf, *by, "month", measure="npp").withColumn("value", F.when(F.col("value") < 255, F.col("value")))
    annual = label.groupBy(*key, "year").agg(F.avg("value").alias("value")).withColumns({"variable": F.lit("soil"), "month": F.lit(None).cast("int")})
    labels = label.withColumn("variable", F.lit("gpp")).unionByName(annual)
    d = ev.evaluate_modes(table, labels, ["source"], _predict_pool, {"soil": "annual"}, ["soil", "gpp"], monthly=["gpp"], annual=["soil"], complete=["value"])
    return rounded(d, "R2", "nRMSE", "ACC")


@query("k06_cell_metrics", f"""
WITH {P} SELECT variable, lat_idx, lon_idx, round(CASE WHEN var_pop(y) > 0 THEN {_R2} END, 6) AS r2, round({_RMSE}, 6) AS rmse FROM pairs GROUP BY ALL""")
def cell_metrics(spark, sf):
    return rounded(sk.cell_metrics(ad.pairs(spark, sf), ["variable", "lat_idx", "lon_idx"]), "r2", "rmse")


@query("k07_other_r2", f"""
WITH {P} SELECT variable, round(1 - sum((y - yhat) * (y - yhat)) / (count(*) * var_pop(yhat)), 6) AS r2_prediction, round(corr(y, yhat) * corr(y, yhat), 6) AS r2_pearson FROM pairs GROUP BY ALL""")
def other_r2(spark, sf):
    return _by_variable(spark, sf, r2_prediction=sk.r2(kind="prediction"), r2_pearson=sk.r2(kind="pearson2"))


@query("k08_taylor_statistics", f"""
WITH {P} SELECT variable, round(stddev_samp(y), 5) AS ref_std, round(stddev_samp(yhat), 5) AS std, round(corr(y, yhat), 6) AS corr,
  round(stddev_samp(yhat) / stddev_samp(y), 6) AS rel_std, round(acos(corr(y, yhat)), 6) AS theta FROM pairs GROUP BY ALL""")
def taylor_statistics(spark, sf):
    d = sk.taylor_statistics(ad.pairs(spark, sf), ["variable"])
    return rounded(rounded(d, "ref_std", "std", n=5), "corr", "rel_std", "theta")


@query("k09_supervised_score", f"""
WITH {ad.field_day_sql()}, d AS (SELECT variable, lat_idx, lon_idx, CAST(t // 365 + 1901 AS INT) AS year, {ad.month_of_doy_sql('t % 365 + 1')} AS month, value FROM field),
m AS (SELECT variable, lat_idx, lon_idx, year, month, avg(value) AS p FROM d GROUP BY ALL), y AS (SELECT variable, lat_idx, lon_idx, year, avg(value) AS p FROM d GROUP BY ALL),
l AS (SELECT variable, lat_idx, lon_idx, year, month, max(value) AS label FROM d GROUP BY ALL),
s AS (SELECT variable, avg((p - label) * (p - label)) AS loss FROM m JOIN l USING (variable, lat_idx, lon_idx, year, month) WHERE variable <> 'error' GROUP BY variable
  UNION ALL SELECT variable, avg((p - label) * (p - label)) FROM y JOIN l USING (variable, lat_idx, lon_idx, year) WHERE variable = 'error' GROUP BY variable)
SELECT variable, round(loss, 5) AS loss, CAST(CASE WHEN variable = 'click' THEN 2 ELSE 1 END AS DOUBLE) AS weight, round(CASE WHEN variable = 'click' THEN 2.0 ELSE 1.0 END * loss, 5) AS weighted FROM s
UNION ALL SELECT 'TOTAL', NULL, NULL, round(sum(CASE WHEN variable = 'click' THEN 2.0 ELSE 1.0 END * loss), 5) FROM s""")
def supervised_score(spark, sf):
    from gridspark.functions import noleap as nl
    d = ad.field_day(spark, sf).withColumns({"year": nl.year_of("t"), "month": nl.month_of("t")})
    cell = ["lat_idx", "lon_idx"]
    labels = d.groupBy("variable", *cell, "year", "month").agg(F.max("value").alias("value"))
    monthly = labels.filter("variable <> 'error'")
    annual = labels.filter("variable = 'error'").drop("month")
    return rounded(sk.supervised_score(d, monthly, annual, cell, {"click": 2.0}), "loss", "weighted", n=5)


@query("k10_loss_rollup", f"""
WITH {P}, s AS (SELECT variable, l_suppkey, avg((yhat - y) * (yhat - y)) / 1e6 AS loss, count(*) AS n FROM pairs GROUP BY ALL)
SELECT variable, round(sum(loss * n) / sum(n), 6) AS loss, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY variable""")
def loss_rollup(spark, sf):
    e = F.col("yhat") - F.col("y")
    s = ad.pairs(spark, sf).groupBy("variable", "l_suppkey").agg((F.avg(e * e) / 1e6).alias("loss"), F.count(F.lit(1)).alias("n"))
    return rounded(sk.loss_rollup(s, ["variable"]), "loss")


@query("k11_complete_label_years", f"""
WITH {ad.field_vars_sql("source", "cell", "year")}, v AS (SELECT CASE variable WHEN 'rh' THEN 'lai_modis' ELSE variable END AS variable, source, lat_idx, lon_idx, year,
  CASE WHEN value BETWEEN 12 AND 60 THEN NULL ELSE value END AS value FROM field)
SELECT source, lat_idx, lon_idx, year FROM v GROUP BY ALL HAVING bool_and(value IS NOT NULL OR variable = 'lai_modis')""")
def complete_label_years(spark, sf):
    f = ad.field_vars(spark, sf, "source", "cell", "year")
    f = f.withColumns({"variable": F.when(F.col("variable") == "rh", "lai_modis").otherwise(F.col("variable")),
                       "value": F.when(~F.col("value").between(12, 60), F.col("value"))})
    return sk.complete_label_years(f, ["source", "lat_idx", "lon_idx"])
