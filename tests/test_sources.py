"""Stores, text, logs, JSON, streaming and quality reports."""

import gzip

import pytest
from pyspark.sql import functions as F

from gridspark.operators import quality as qu, scores as sc, skill as sk
from gridspark.schema import FIELD, as_field
from gridspark.sources import catalog as ct, fields as fd, text as tx
from gridspark.streaming import ingest


@pytest.fixture()
def field(spark):
    return spark.range(4000).select(
        F.when(F.col("id") < 2500, "gpp").otherwise("ra").alias("variable"), F.lit("m").alias("source"),
        F.concat(F.lit("S"), F.pmod("id", F.lit(2)).cast("string")).alias("scenario"),
        F.pmod("id", F.lit(90)).cast("int").alias("lat_idx"), F.pmod("id", F.lit(70)).cast("int").alias("lon_idx"),
        F.col("id").cast("int").alias("t"), (1901 + F.pmod("id", F.lit(5))).cast("int").alias("year"),
        F.lit(1).alias("month"), F.col("id").cast("double").alias("value"))


def test_store_prunes_and_upserts(spark, field, tmp_path):
    path = str(tmp_path / "field")
    fd.write_field(field, path)
    with pytest.raises(Exception, match="(?i)already exists"):
        fd.write_field(field, path)
    d = fd.read_field(spark, path, ["gpp"], ["S1"], (1902, 1903))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(year,1902)" in plan
    assert d.count() == field.filter("variable = 'gpp' AND scenario = 'S1' AND year BETWEEN 1902 AND 1903").count()
    fd.upsert_variable(field.filter("variable = 'ra'").withColumn("value", F.lit(0.0)), path)
    got = {r.variable: (r.n, r.s) for r in spark.read.parquet(path).groupBy("variable").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert got["ra"] == (1500, 0.0) and got["gpp"] == (2500, sum(range(2500)))


def test_materialise_reads_back(spark, field, tmp_path):
    path = str(tmp_path / "m")
    a = fd.materialise(field, path)
    b = fd.materialise(field.limit(1), path)
    assert a.count() == b.count() == 4000
    assert fd.materialise(field.limit(1), path, overwrite=True).count() == 1


def test_aliases_first_source_wins(spark):
    df = spark.createDataFrame([("lai_modis", 1), ("lai_avh15c1", 2), ("cTotal_monthly", 3), ("gpp", 4)], "variable string, x int")
    assert {(r.variable, r.x) for r in fd.with_aliases(df).collect()} == {("lai", 2), ("cTotal", 3), ("gpp", 4)}


def test_catalog(spark):
    c = spark.createDataFrame([("m", "S0", "cTotal_monthly", "p1"), ("m", "S0", "cTotal", "p0"), ("m", "S1", "cTotal", "a"), ("m", "S1", "cTotal", "b")],
                              "model string, scenario string, variable string, path string")
    keys = ["model", "scenario", "variable"]
    aliases = {"cTotal": ("cTotal", 0), "cTotal_monthly": ("cTotal", 1)}
    s0 = c.filter("scenario = 'S0'")
    assert [r.path for r in ct.resolve_catalog(s0, keys, aliases, strict=False).collect()] == ["p0"]
    assert ct.resolve_catalog(s0, keys).count() == 2
    with pytest.raises(Exception, match="several inputs for m S0 cTotal"):
        ct.resolve_catalog(s0, keys, aliases).collect()
    with pytest.raises(Exception, match="several inputs for m S1 cTotal"):
        ct.resolve_catalog(c.filter("scenario = 'S1'"), keys).collect()
    files = spark.createDataFrame([("x_2001.nc",), ("x_1990-1999.nc",), ("x_2005-2010.nc",), ("mask.nc",)], "path string")
    assert [r.path for r in ct.prune_by_year(files, 1999, 2001).collect()] == ["x_1990-1999.nc", "x_2001.nc"]
    assert ct.prune_by_year(files, 1999, 2001, keep_undated=True).count() == 3


def test_catalog_from_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("variable,model,scenario,path,time_res\ngpp,m,S0,/x/gpp.nc,monthly\n")
    c = ct.read_catalog(spark, str(tmp_path / "c.csv"))
    assert c.first().asDict() == {"model": "m", "scenario": "S0", "variable": "gpp", "time_res": "monthly", "path": "/x/gpp.nc"}
    f = as_field(spark.createDataFrame([(1, 2, 3, "4.5")], "lat_idx long, lon_idx long, t long, value string"), variable="gpp")
    assert f.dtypes == [(x.name, x.dataType.simpleString()) for x in FIELD] and f.first().value == 4.5 and f.first().variable == "gpp"


def test_year_blocks(spark):
    df = spark.createDataFrame([("a", y) for y in (1, 2, 3, 4, 5, 9, 10)], "k string, year int")
    d = ct.year_blocks(df, ["k"], 2).select("block_start", "block_end").distinct().orderBy("block_start")
    assert [tuple(r) for r in d.collect()] == [(1, 2), (3, 4), (5, 5), (9, 10)]


def test_annual_text(spark, tmp_path):
    p = tmp_path / "co2.txt"
    p.write_text("year ppm\n1700 276.5\n 1701   277.0\nbad\n1702 278\n")
    s = tx.read_annual_series(spark, str(p), keep=2)
    assert {(r.year, r.value) for r in s.collect()} == {(1701, 277.0), (1702, 278.0)}


LOG = """Dataloader batches per GPU — train=10, val=2, test=2
[Epoch 3/9] start
now Progress bar — epoch 3/9, batch 4/10, avg_batch_loss=0.5
avg_batch_loss=2e-1
[Validation @ batch 99] avg_loss=0.7
[Pre-flight validation] avg_loss=0.9
2025-10-28 10:00:01,123 [INFO] Epoch average train loss=0.4, val loss=0.3 (val_cnt=7)
[Epoch 4/9] start
[Validation @ batch 2] avg_loss=0.6
2025-10-28 11:00:01,123 [INFO] Epoch average train loss=0.2, val loss=0.1
"""


@pytest.mark.parametrize("packed", [False, True])
def test_training_log(spark, tmp_path, packed):
    if packed:
        with gzip.open(tmp_path / "a.log.gz", "wt", encoding="utf-8") as f:
            f.write(LOG)
    else:
        (tmp_path / "a.log").write_text(LOG, encoding="utf-8")
    ev = sc.parse_log(tx.read_log_lines(spark, str(tmp_path)))
    got = [(r.kind, r.epoch, r.step, r.loss, r.val_loss) for r in ev.orderBy("line_no").collect()]
    assert got == [("batch", 3, 4, 0.5, None), ("batch", 3, 1, 0.2, None), ("probe", 3, 10, None, 0.7), ("preflight", None, 0, None, 0.9),
                   ("summary", None, None, 0.4, 0.3), ("probe", 4, 12, None, 0.6), ("summary", None, None, 0.2, 0.1)]
    ep = sc.epoch_table(ev).orderBy("epoch").collect()
    assert [(r.epoch, r.train_loss, r.val_cnt) for r in ep] == [(3, 0.4, 7), (4, 0.2, None)]


def test_carry_forward_across_blocks(spark):
    df = spark.range(1000).select(F.lit("f").alias("k"), "id", F.when(F.col("id").isin(3, 40, 777), F.col("id")).alias("x"))
    got = {r.id: r.x for r in sc.carry_forward(df.repartition(7), ["k"], "id", ["x"], block=10).collect()}
    assert got == {i: (None if i < 3 else 3 if i < 40 else 40 if i < 777 else 777) for i in range(1000)}


def test_stats_json_skips_bad_texts(spark):
    df = spark.createDataFrame([('{"a": {"count": 2, "sum": 3.0, "sumsq": 5.0, "min": 1.0, "max": 2.0}, "b": null}',), ("{oops",), (None,), ('{"a": {"count": 0}}',)], "json string")
    assert [(r.variable, r.n, r["sum"]) for r in sc.parse_stats_json(df).collect()] == [("a", 2, 3.0)]


def test_stream_picks_up_new_pieces_and_is_idempotent(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))

    def piece(y, n):
        d = spark.range(n).select(F.lit("gpp").alias("variable"), F.lit(y).alias("year"), (F.col("id") + y).cast("double").alias("value"))
        d.coalesce(1).write.mode("append").parquet(src)

    def run():
        s = spark.readStream.schema("variable string, year int, value double").option("maxFilesPerTrigger", 1).parquet(src)
        ingest.ingest_pieces(spark, s, out, chk)

    piece(1901, 10)
    piece(1902, 20)
    run()
    run()
    assert ingest.read_ingested(spark, out).count() == 30
    piece(1903, 5)
    run()
    r = ingest.running_moments(spark, out).first()
    vals = [1901.0 + i for i in range(10)] + [1902.0 + i for i in range(20)] + [1903.0 + i for i in range(5)]
    assert r["n"] == 35 and abs(r["mean"] - sum(vals) / 35) < 1e-9 and r["max"] == max(vals)


def test_stream_replaces_a_year_that_comes_again(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    for value, year in ((1.0, 1901), (2.0, 1902), (5.0, 1901)):
        d = spark.createDataFrame([("gpp", year, value)] * 3, "variable string, year int, value double")
        d.coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("variable string, year int, value double").parquet(src)
        ingest.ingest_pieces(spark, s, out, chk, whole_years=True)
    got = sorted((r.year, r.value) for r in ingest.read_ingested(spark, out).collect())
    assert got == [(1901, 5.0)] * 3 + [(1902, 2.0)] * 3
    r = ingest.running_moments(spark, out).first()
    assert (r["n"], r["mean"]) == (6, 3.5)


def test_metrics_skip_unpaired_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 3.0, 2.0), ("a", None, 9.0), ("a", 4.0, float("nan")), ("b", 1.0, 2.0)], "variable string, y double, yhat double")
    t = {r.variable: r for r in sk.metric_table(df).collect()}
    assert t["a"].n == 3 and abs(t["a"].R2 - (1 - 1.25 / 2)) < 1e-12
    assert t["b"].R2 is None and t["b"].n == 1
    assert t[sk.GLOBAL_ROW].n == 4 and t[sk.GLOBAL_ROW].R2 == t["a"].R2


def test_conformance_finds_each_fault(spark):
    good = [("ok", t, lat, lon, "days since 1901-01-01 00:00:00", "365_day") for t in range(123) for lat in (0.25, -0.25) for lon in (0.0, 0.5)]
    bad = [("bad", t, 0.1, 0.2, "hours since 1901-01-01", "standard") for t in range(5)]
    d = spark.createDataFrame(good + bad, "source string, t int, lat double, lon double, units string, calendar string")
    got = {r.source: r.issues for r in qu.conformance(d, ["source"], nlat=2, nlon=2).collect()}
    assert got["ok"] == []
    assert got["bad"] == ["time length", "time units", "calendar", "lat size", "lon size", "lat centres", "lon centres"]


def test_labels_resolve_whatever_the_case(spark):
    tokens = spark.createDataFrame([("GPP",), ("LeafAreaIndex",), ("lai",), ("rh",)], "token string")
    known = spark.createDataFrame([("GrossPrimaryProduction",), ("LeafAreaIndex",)], "variable string")
    got = {r.token: r.label for r in sc.resolve_labels(tokens, known).collect()}
    assert got == {"GPP": "GrossPrimaryProduction", "LeafAreaIndex": "LeafAreaIndex", "lai": "LeafAreaIndex", "rh": None}


def test_log_lines_keep_their_order_across_splits(spark, tmp_path):
    for name, n in (("a.log", 3000), ("b.log", 1700), ("c.log", 40)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = tx.read_log_lines(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() > 8
        rows = d.orderBy("file", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = [r.line for r in rows]
    assert got == [f"{n} {i}" for n, k in (("a.log", 3000), ("b.log", 1700), ("c.log", 40)) for i in range(k)]


def test_editions_are_not_sorted_in_memory(spark, tmp_path):
    """One file an edition, and tasks that hold no more than their writers do."""
    from gridspark.queries.streams import _editions
    d = spark.range(4000).selectExpr("CAST(id % 6 AS INT) AS piece", "id % 2 AS version", "CAST(id AS DOUBLE) AS value")
    _editions(d, str(tmp_path / "in"))
    assert len(list(tmp_path.glob("in/*/*/*.parquet"))) == 6
    store = spark._jsc.sc().statusStore()
    stages = store.jobsList(None).head().stageIds()
    tasks = [store.taskList(stages.apply(i), 0, 100) for i in range(stages.size())]
    peaks = [t.apply(i).taskMetrics().get().peakExecutionMemory() for t in tasks for i in range(t.size()) if t.apply(i).taskMetrics().isDefined()]
    assert peaks and max(peaks) == 0
    assert spark.read.parquet(str(tmp_path / "in")).count() == 4000
