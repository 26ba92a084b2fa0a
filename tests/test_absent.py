"""Absent rows, duplicate rows and rows outside a grid: nothing is lost or replaced silently."""

import pytest
from pyspark.sql import functions as F

from gridspark.functions.geo import HALF_DEGREE
from gridspark.operators import aggregates as ag, cleaning as cl, joins as jn, masks as mk, physics as ph, quality as qu, rollout as ro, samples as sm
from gridspark.operators import scores as sc, series as se, time_axis as ta


@pytest.fixture(scope="module")
def holed(spark):
    """Years 0..5 without year 3."""
    return spark.createDataFrame([("a", y, float(y)) for y in (0, 1, 2, 4, 5)], "k string, year int, value double")


def by(df, name, order="year"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_windows_count_steps(holed):
    assert by(se.rolling_mean(holed, ["k"], 2), "value") == [0.5, 0.5, 1.5, None, 4.5]
    assert by(se.rolling_mean(holed, ["k"], 2, first=-1), "value") == [None, 0.5, 1.5, None, 4.5]
    assert by(se.first_years_mean(holed, ["k"], 4), "value") == [1.0] * 5
    assert by(se.step_difference(holed, ["k"]), "delta") == [0.0, 1.0, 1.0, None, 1.0]
    assert by(se.lag_state(holed, ["k"], "year"), "prev") == [0.0, 0.0, 1.0, None, 4.0]


def test_months_follow_over_the_year(spark):
    d = spark.createDataFrame([("a", 1, 11, 1.0), ("a", 1, 12, 2.0), ("a", 2, 1, 3.0), ("a", 2, 3, 4.0)], "k string, year int, month int, value double")
    assert by(se.lag_state(d, ["k"], ("year", "month")), "prev", ["year", "month"]) == [0.0, 1.0, 2.0, None]


def test_absent_flux_leaves_the_stock_missing(spark):
    f = spark.createDataFrame([("a", 1, m, 1.0) for m in range(1, 13) if m != 4], "k string, year int, month int, value double")
    s = spark.createDataFrame([("a", 1, 50.0)], "k string, year int, stock double")
    dec = by(se.monthly_stock_from_december(f, s, ["k"]), "stock_monthly", "month")
    jan = by(se.monthly_stock_from_january(f, s, ["k"]), "stock_monthly", "month")
    assert [x is None for x in dec] == [True] * 3 + [False] * 8
    assert [x is None for x in jan] == [False] * 3 + [True] * 8


def test_change_across_a_gap_is_missing(spark):
    w = spark.createDataFrame([("a", 1, m, 10.0 * m, 0.0) for m in (1, 2, 4, 5)], "k string, year int, month int, cTotal_monthly double, nbp double")
    assert by(ph.stock_flux_residual(w, ["k"]), "residual", "month") == [10.0, None, 10.0]


def test_reports_over_the_whole_grid(spark):
    d = spark.createDataFrame([(0, 0, 1, 1.0), (0, 0, 2, 1.0), (0, 1, 1, 1.0)], "lat_idx int, lon_idx int, t int, value double")
    assert {r.lon_idx: r.finite_mask for r in mk.finite_mask(d, d).collect()} == {0: 1, 1: 0}
    assert {r.lon_idx: r.finite_mask for r in mk.finite_mask(d, d, first_n=1).collect()} == {0: 1, 1: 1}
    r = qu.missing_report(d, land=None).first()
    assert (r.n, r.n_missing, r.empty_steps, r.empty_cells) == (4, 1, 0, 0)
    r = qu.missing_report(d, land=None, n_cells=3, n_steps=3).first()
    assert (r.n, r.n_missing, r.empty_steps, r.empty_cells) == (9, 6, 1, 1)
    r = qu.partial_cells(d, 2).first()
    assert (r.partial_cells, r.mean_missing_share) == (1, 0.5)


def test_no_row_lost_for_a_bound(spark):
    p = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), (None, 1.0, 1.0), ("z", 9.0, 9.0)], "k string, x double, y double")
    assert sorted(r.density for r in ag.point_density(p, "x", "y", (0.0, 10.0), (0.0, 10.0), 5, key="k").collect()) == [1, 1, 2, 2]
    tiles = spark.createDataFrame([(999,), (1,)], "tile_id int")
    assert jn.skip_tiles(tiles, tiles.filter("tile_id = 999")).count() == 1
    df = spark.createDataFrame([("a", t, 1.0) for t in range(5)], "k string, t int, value double")
    axis = spark.createDataFrame([(1, 100), (2, 200)], "pos int, t int")
    with pytest.raises(Exception, match="series has 5 steps, the axis 2"):
        ta.replace_axis(df, ["k"], axis).collect()


def test_odd_mask_and_statistics_rows_fail(spark):
    f = spark.createDataFrame([(1, 1, 5.0)], "lat_idx int, lon_idx int, value double")
    mask = lambda *rows: spark.createDataFrame(rows, "lat_idx int, lon_idx int, tvt int")
    assert mk.apply_mask(f, mask((1, 1, 2), (1, 1, 2)), [2]).first().value == 5.0
    with pytest.raises(Exception, match="outside the grid"):
        mk.apply_mask(f, mask((400, 1, 2)), [2], grid=HALF_DEGREE).collect()
    with pytest.raises(Exception, match="rows of one cell differ"):
        mk.apply_mask(f, mask((1, 1, 2), (1, 1, 0)), [2]).collect()
    stats = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0)], "variable string, mean double, std double")
    with pytest.raises(Exception, match="two statistics rows of a"):
        sm.stats_of(stats, ["a"]).collect()


def test_sentinels_in_single_precision(spark):
    d = spark.createDataFrame([(1e20,), (-1e20,), (-99999.0,), (9.969209968386869e36 * -1,), (2.5,)], "value float")
    for kind in ("float", "double"):
        got = [r.value for r in cl.sentinels_to_null(d.withColumn("value", F.col("value").cast(kind))).collect()]
        assert got == [None] * 4 + [2.5]
    assert cl.sentinels_to_null(spark.createDataFrame([(-99999.001,)], "value double")).first().value == -99999.001


def test_limits_of_an_empty_group(spark):
    d = spark.createDataFrame([("a", -1.0), ("a", 3.0), ("b", None), (None, 2.0)], "k string, value double")
    assert {r.k: (r.vmin, r.vmax) for r in ag.symmetric_limits(d, ["k"], pct=1.0, default=7.0).collect()} == {"a": (-3.0, 3.0), "b": (-7.0, 7.0), None: (-2.0, 2.0)}
    assert {r.k: (r.vmin, r.vmax) for r in ag.robust_limits(d, ["k"], low=0.0, high=1.0).collect()} == {"a": (-1.0, 3.0), "b": (None, None), None: (2.0, 2.0)}
    assert ag.robust_limits(d, [], low=0.0, high=1.0).first().vmax == 3.0


def test_benchmark_order_and_bare_offset(spark):
    rows = [(e, m, "Benchmark Period Mean (intersection)", "gpp", "g", v) for e, m, v in (("co2", "co2_10pct", 1.0), ("tmp", "tmp_2", 2.0))]
    rows.append(("tmp", "tmp_2", "Model Period Mean (intersection)", "gpp", "g", 3.0))
    d = spark.createDataFrame(rows, "experiment string, model string, scalar_name string, variable string, region string, data double")
    got = {r.type: (r.experiment, r.x) for r in sc.counterfactual_table(d, None).collect()}
    assert got == {"Benchmark": ("tmp", 0.0), "Model": ("tmp", 2.0)}


def test_rollout_with_a_missing_key(spark):
    import pandas as pd
    d = spark.createDataFrame([(None, 0, 0, y, 1) for y in range(3)], "source string, lat_idx int, lon_idx int, year int, month int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        out = ro.rollout(d, ["source"], lambda f: pd.DataFrame({"s": f["s"] + 1}), {"s": "annual"}, ["s"])
        assert by(out, "s") == [1.0, 2.0, 3.0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_two_values_in_one_cell_of_a_wide_table_fail(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0)], "k int, variable string, value double")
    assert jn.merge_variables(d.filter("value <> 2"), ["k"], ["a", "b"]).first().asDict() == {"k": 1, "a": 1.0, "b": 3.0}
    for wide in (jn.merge_variables(d, ["k"], ["a", "b"]), ag.report_table(d, "k", "variable", ["a", "b"])):
        with pytest.raises(Exception, match="two values where one is expected"):
            wide.collect()
