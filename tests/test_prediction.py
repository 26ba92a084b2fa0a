"""Forcing of rows against forcing of means, and how often a prediction run reads its input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import resume as rs, rollout as ro
from gridspark.plans import budgets, prediction as pr
from gridspark.schema import CELL
from gridspark.session import own_writers

DAILY = pr.Emulator(lambda z: z[:, :2], ("gpp", "cTotal"), daily=("tmp", "pre"), monthly=("dep", "nfer_crop_nh4"), monthly_states=("lai",), annual=("co2",), annual_states=("cTotal",))
MONTHLY = pr.Emulator(lambda z: z[:, :2], ("gpp", "cTotal"), monthly=("tmp", "pre"), annual=("co2",), annual_states=("cTotal",))
STATS = [(n, 3.0, 2.0) for n in ("tmp", "pre", "dep", "nfer_crop_nh4", "lai", "co2", "cTotal", "gpp")]


def raw(spark):
    r = random.Random(5)
    value = lambda missing: None if r.random() < missing else round(r.uniform(-9, 9), 3)
    rows = [(s, i, 40 * i, y, m, r.choice((1, 2)), value(0.1), value(0.1), value(0.6)) for s in ("a", "b") for i in range(4) for y in (1901, 1902, 1904)
            for m in (1, 2, 12) for _ in range(r.randint(0, 5))]
    return spark.createDataFrame(rows, "source string, lat_idx int, lon_idx int, year int, month int, day int, u double, v double, w double")


def columns(model):
    return {n: F.col("uvw"[i % 3]) * (i + 1) for i, n in enumerate(model.inputs)}


def long_fields(rows, model):
    fields = None
    for scope, names, by in (("daily", model.daily, ("month", "day")), ("monthly", model.monthly + model.monthly_states, ("month",)), ("annual", model.annual + model.annual_states, ())):
        for n in names:
            d = rows.groupBy("source", *CELL, "year", *by).agg(F.avg(columns(model)[n]).alias("value")).withColumns({"scope": F.lit(scope), "variable": F.lit(n)})
            fields = d if fields is None else fields.unionByName(d, allowMissingColumns=True)
    return fields if model.daily else fields.withColumn("day", F.lit(None).cast("int"))


def table(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=repr), names


@pytest.mark.parametrize("model", [DAILY, MONTHLY])
def test_forcing_of_rows_is_that_of_their_means(spark, model):
    rows = raw(spark)
    offsets = ro.parse_offsets(spark.createDataFrame([("daily:tmp=2.5,monthly:pre=-3,daily:pre=-50%,monthly:dep=-10%,annual:co2=4,annual:cTotal=9,monthly:lai=1",)], "spec string"))
    for rules in (None, offsets):
        want = table(pr.forcing_table(long_fields(rows, model), model, offsets=rules))
        got = pr.forcing_of_rows(rows, model, columns(model), offsets=rules)
        assert table(got) == want and len(want[0]) > 50
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_prediction_run_reads_its_rows_once(spark, tmp_path):
    rows, read = raw(spark).cache(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    run = dict(stats=spark.createDataFrame(STATS, "variable string, mean double, std double"), model=MONTHLY, nudge=(0.2, "z_shrink"))
    got = pr.prediction_run(rows.mapInArrow(counted, rows.schema), path=str(tmp_path / "run"), block_years=1, columns=columns(MONTHLY), **run)
    assert table(got) == table(pr.prediction_run(long_fields(rows, MONTHLY), **run))
    assert read.value == rows.count()


def test_rollout_spreads_its_units_over_tasks(spark, tmp_path, monkeypatch):
    """A few bytes are much work for Python: units are not gathered in one task for being small."""
    df, tasks = raw(spark).withColumn("start", F.lit(1.0)), []
    plain = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda d, *a, **k: (tasks.append(d.rdd.getNumPartitions()), plain(d, *a, **k))[1])
    rs.rollout_resumable(df, str(tmp_path / "run"), ["source"], lambda f: f.assign(s=f["s"] + 1), {"s": "annual"}, ["s"], steps=("year", "month"))
    units = ro.in_tiles(df, "tile", CELL, pr.HALF_DEGREE).select("source", "tile").distinct().count()
    assert units > 4 and tasks == [min(units, int(spark.conf.get("spark.sql.shuffle.partitions")))]


def test_predicted_budget_is_that_of_long_fluxes(spark):
    model = pr.Emulator(None, ("gpp", "ra", "rh", "cTotal"), daily=("tmp",))
    predicted = raw(spark).withColumnsRenamed({"u": "gpp", "v": "ra", "w": "rh"}).withColumn("cTotal", F.lit(1.0))
    mask = spark.createDataFrame([(i, 40 * i, i % 3) for i in range(3)], "lat_idx int, lon_idx int, tvt int")
    got = pr.predicted_budget(predicted, model, mask, [0, 1])
    want = budgets.budget_from_fluxes(pr.step_means(predicted, model), mask, [0, 1])
    rows = [sorted(map(tuple, d.collect())) for d in (got, want)]
    assert got.columns == want.columns and len(rows[0]) == 3 and np.allclose(rows[0], rows[1], rtol=1e-12)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()  # rows are not multiplied by the outputs and gathered again


def test_own_writers_are_given_back(spark):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError):
        with own_writers(spark, 2):
            assert spark.conf.get(name) == "2"
            raise RuntimeError
    assert spark.conf.get(name) == before
