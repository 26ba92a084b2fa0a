"""Windows, stocks, trends, rollout and offsets against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions.noleap import MONTH_LENGTHS
from gridspark.operators import aggregates as ag, physics as ph, rollout as ro, samples as sm, series as se
from gridspark.operators.apply import apply_series


@pytest.fixture(scope="module")
def years(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(10, 3, 12)
    return spark.createDataFrame([("a", 2000 + i, float(x)) for i, x in enumerate(v)], "k string, year int, value double"), v


def values(df, name, order="year"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_rolling_mean_pads_the_front(years):
    df, v = years
    got = values(se.rolling_mean(df, ["k"], 4), "value")
    full = [v[i - 3:i + 1].mean() for i in range(3, 12)]
    assert np.allclose(got, [full[0]] * 3 + full)


def test_rolling_mean_needs_every_value(spark):
    df = spark.createDataFrame([("a", y, None if y == 3 else float(y)) for y in range(6)], "k string, year int, value double")
    assert values(se.rolling_mean(df, ["k"], 2), "value") == [0.5, 0.5, 1.5, None, None, 4.5]


def test_first_difference_keeps_its_value(years):
    df, v = years
    assert np.allclose(values(se.step_difference(df, ["k"]), "delta"), np.diff(np.concatenate([[0], v])))
    assert values(se.step_difference(df, ["k"], first_is_zero=True), "delta")[0] == 0.0


def test_trend_and_rebuild(years):
    df, v = years
    x = se.with_position(df, ["k"])
    trend = se.linear_trend(x, ["k"], "x")
    slope, intercept = np.polyfit(range(12), v, 1)
    r = trend.first()
    assert np.allclose([r.slope, r.intercept], [slope, intercept])
    res = se.detrend(x, ["k"], "x", out="iav")
    assert np.allclose(values(se.rebuild_series(trend, res, ["k"]), "rebuilt"), v)


def test_trend_of_one_point_is_missing(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None)], "k string, t int, value double")
    r = se.linear_trend(df, ["k"]).first()
    assert r.slope is None and r.intercept is None
    a = se.annual_anomalies(df.withColumnRenamed("t", "year"), ["k"])
    assert values(a, "anomaly") == [0.0, None]


def test_seasonality_needs_whole_years(spark):
    df = spark.createDataFrame([("a", m % 12 + 1, m, float(m)) for m in range(13)], "k string, month int, t int, value double")
    with pytest.raises(Exception, match="multiple of 12"):
        se.interannual_variability(df, ["k"]).collect()
    assert se.interannual_variability(df.filter("t < 12"), ["k"]).count() == 12


def stock_loops(annual, flux):
    sec = [d * 86400.0 for d in MONTH_LENGTHS]
    dec = [0.0] * 12
    dec[11] = annual
    for m in range(10, -1, -1):
        dec[m] = dec[m + 1] - flux[m] * sec[m]
    jan = [annual]
    for m in range(1, 12):
        jan.append(jan[m - 1] + flux[m - 1] * sec[m - 1])
    return dec, jan


def test_monthly_stocks(spark):
    flux = [float(i - 6) * 1e-6 for i in range(12)]
    f = spark.createDataFrame([("a", 2000, i + 1, x) for i, x in enumerate(flux)], "k string, year int, month int, value double")
    s = spark.createDataFrame([("a", 2000, 50.0)], "k string, year int, stock double")
    dec, jan = stock_loops(50.0, flux)
    assert np.allclose(values(se.monthly_stock_from_december(f, s, ["k"]), "stock_monthly", "month"), dec)
    assert np.allclose(values(se.monthly_stock_from_january(f, s, ["k"]), "stock_monthly", "month"), jan)
    gap = f.withColumn("value", F.when(F.col("month") != 4, F.col("value")))
    assert [x is None for x in values(se.monthly_stock_from_december(gap, s, ["k"]), "stock_monthly", "month")] == [True] * 4 + [False] * 8
    # The rebuilt stock closes the balance with the flux it came from.
    w = se.monthly_stock_from_january(f, s, ["k"]).withColumnsRenamed({"stock_monthly": "cTotal_monthly", "value": "nbp"})
    w = w.withColumn("nbp", F.lag("nbp").over(__import__("pyspark").sql.Window.partitionBy("k").orderBy("month")))
    secs = {m: d * 86400.0 for m, d in enumerate(MONTH_LENGTHS, 1)}
    res = ph.stock_flux_residual(w, ["k"], integrate=False).collect()
    assert all(abs(r.residual + r.nbp - r.nbp * secs[r.month - 1]) < 1e-9 for r in res)


def test_residuals_vanish_on_closed_budgets(spark):
    d = spark.range(50).select((F.col("id") * 1.5).alias("gpp"), (F.col("id") * 0.5).alias("ra"), (F.col("id") * 0.25).alias("rh"),
                               F.lit(0.125).alias("fFire"), F.lit(0.5).alias("fLuc"))
    d = d.withColumn("npp", F.col("gpp") - F.col("ra"))
    d = d.withColumn("nbp", F.col("npp") - F.col("rh") - F.col("fFire") - F.col("fLuc"))
    assert ph.npp_residual(d).filter("residual <> 0").count() == 0
    assert ph.nbp_residual(d).filter("residual <> 0").count() == 0
    assert ph.balance_residuals(d.withColumn("month", F.lit(1)), []).select("balance").distinct().count() == 2


def test_merged_moments_equal_one_pass(spark):
    df = spark.range(1000).select(F.lit("v").alias("variable"), F.pmod("id", F.lit(7)).alias("shard"), F.rand(3).alias("value"))
    df = df.cache()
    a = ag.finish_moments(ag.moments(df)).first()
    empty = ag.moments(df.withColumn("value", F.lit(None).cast("double")), ["variable", "shard"])
    b = ag.merge_moments(ag.moments(df, ["variable", "shard"]).unionByName(empty)).first()
    assert np.allclose([a["n"], a["mean"], a["std"], a["min"], a["max"]], [b["n"], b["mean"], b["std"], b["min"], b["max"]])


def test_standardise_round_trip_and_failure(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "variable string, value double")
    stats = spark.createDataFrame([("a", 2.0, 1.0), ("b", 0.0, 2.0)], "variable string, mean double, std double")
    z = sm.standardise(df, stats, ["a", "b"])
    assert sorted(r.value for r in z.collect()) == [-1.0, 1.0, 2.5]
    assert sorted(r.value for r in sm.destandardise(z, stats, ["a", "b"]).collect()) == [1.0, 3.0, 5.0]
    with pytest.raises(Exception, match="no usable statistics for b"):
        sm.standardise(df, stats.filter("variable = 'a'"), ["a", "b"]).collect()


def test_strict_and_skipping_means(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("y", 2.0), ("y", 4.0)], "k string, value double")
    assert {r.k: r.value for r in ag.ensemble_mean(df, ["k"], 2).collect()} == {"x": None, "y": 3.0}
    assert {r.value for r in ag.ensemble_mean(df, ["k"], 3).collect()} == {None}  # a member without a row
    assert {r.k: r.value for r in ag.time_mean(df, ["k"]).collect()} == {"x": 1.0, "y": 3.0}


def _rollout_rows():
    rng = np.random.default_rng(2)
    rows = []
    for s in ("m0", "m1"):
        for cell in ((0, 0), (0, 1), (40, 5)):
            for y in range(2000, 2004):
                if (s, cell, y) == ("m0", (0, 1), 2002):
                    continue  # a cell may lack a year
                rows += [(s, *cell, y, m, float(rng.normal())) for m in range(1, 13)]
    return rows


def _predict(frame):
    return pd.DataFrame({"soil": 0.5 * frame["soil"] + frame["value"], "leaf": frame["leaf"] + 1.0, "flux": frame["soil"] - frame["leaf"]})


@pytest.mark.parametrize("carry", ["annual", "december"])
def test_rollout_against_a_loop(spark, carry):
    rows = _rollout_rows()
    df = spark.createDataFrame(rows, "source string, lat_idx int, lon_idx int, year int, month int, value double")
    states = {"soil": "annual", "leaf": "monthly"}
    got = ro.rollout(df.repartition(5), ["source"], _predict, states, ["soil", "leaf", "flux"], carry=carry, initial=1.0)
    got = {(r.source, r.lat_idx, r.lon_idx, r.year, r.month): (r.soil, r.leaf, r.flux) for r in got.collect()}
    series = {}
    for s, i, j, y, m, v in rows:
        series.setdefault((s, i, j), {}).setdefault(y, []).append((m, v))
    for cell, by_year in series.items():
        soil = leaf = np.ones(12)
        for y in sorted(by_year):
            out = []
            for m, v in sorted(by_year[y]):
                out.append((0.5 * soil[m - 1] + v, leaf[m - 1] + 1.0, soil[m - 1] - leaf[m - 1]))
                assert np.allclose(got[(*cell, y, m)], out[-1])
            o = np.array(out)
            soil = np.full(12, o[:, 0].mean())
            leaf = np.full(12, o[:, 1].mean()) if carry == "annual" else np.array([o[11, 1]] + [0.0] * 11)


def test_offsets(spark):
    specs = spark.createDataFrame([("daily:pre=-20%,spfh=-20%,Annual: co2 = 30 ,weekly:tmp=1,monthly:x,daily:pre=-50%",)], "spec string")
    rules = {tuple(r) for r in ro.parse_offsets(specs).collect()}
    assert rules == {("daily", "pre", "percent", -50.0), ("annual", "co2", "add", 30.0)}
    f = spark.createDataFrame([("daily", "pre", 4.0), ("monthly", "pre", 4.0), ("annual", "co2", -40.0), ("daily", "pre", None)],
                              "scope string, variable string, value double")
    got = [r.value for r in ro.apply_offsets(f, ro.parse_offsets(specs)).collect()]
    assert sorted(got, key=str) == sorted([2.0, 4.0, -10.0, None], key=str)


def test_apply_series(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 2.0), ("b", 1, 5.0)], "k string, t int, value double")
    d = apply_series(df, ["k"], lambda f: f.assign(value=f["value"].cumsum()), "k string, t int, value double")
    assert {(r.k, r.t): r.value for r in d.collect()} == {("a", 1): 2.0, ("a", 2): 3.0, ("b", 1): 5.0}


def test_apply_series_over_batches(spark):
    """Series cut by the ends of batches, whole numbers and missing keys next to others without, and few hand-overs to Python."""
    big = 2**60
    rows = [(k, t, None if k == 3 and t == 2 else big + t, float(t)) for k in (1, 2, 3, None, 0) for t in range(1, 8)] + [(4, 1, big, None)]
    df = spark.createDataFrame(rows, "k int, t int, n long, value double").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def fn(f):
        assert f["t"].is_monotonic_increasing and f["k"].nunique(dropna=False) == 1
        whole = f["n"].notna().all()
        assert (f["n"].dtype.kind == "i") == whole
        return f.assign(total=f["value"].sum(min_count=1), n=f["n"] if whole else 0, m=len(f))[["m", "n", "k", "t", "total"]]

    for batch in (3, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = apply_series(df, ["k"], fn, "k int, t int, n long, total double, m long")
            assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
            want = [(k, t, 0 if k == 3 else n, None if k == 4 else 28.0, 1 if k == 4 else 7) for k, t, n, v in rows]
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_months_carried_inside_a_year(spark):
    df = spark.createDataFrame([("a", 2000, m, 1.0, 4.0) for m in (2, 1, 3)], "k string, year int, month int, value double, start double")
    assert values(ro.carry_months(df, ["k"], 0.5), "state", "month") == [3.0, 2.5, 2.25]
