"""Resumed rollouts, keyed state, sketches, shards, as-of joins, layouts: against whole runs and brute force."""

import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions import ranking as rk
from gridspark.functions.geo import GridSpec
from gridspark.operators import aggregates as ag, evaluate as ev, fill as fi, joins as jn, resume as rs, rollout as ro, sampling as sa, series as se, skill as sk
from gridspark.operators.asof import asof_join, hold_last, nearest_step
from gridspark.sources import layout
from gridspark.streaming import pieces

# ---- resumable rollouts


def predict(frame):
    return pd.DataFrame({"soil": 0.6 * frame["soil"] + 0.4 * frame["value"], "leaf": 0.5 * frame["leaf"] + 0.5 * frame["value"], "gpp": frame["value"] - 0.1 * frame["soil"]})


def predict_until(year):
    def run(frame):
        if (frame["year"] > year).any():
            raise RuntimeError("broken off")
        return predict(frame)
    return run


def predict_from(year):
    def run(frame):
        assert (frame["year"] >= year).all()
        return predict(frame)
    return run


def forcing(spark):
    rows = [(s, i, 7 * i, y, m, None if (i, y) == (3, 1904) else float((i * 31 + y * 7 + m * 3) % 50)) for s in ("a", "b") for i in range(12)
            for y in range(1901, 1911) for m in range(1, 13) if not (i == 5 and y in (1903, 1906)) and not (i == 8 and y < 1905)]
    return spark.createDataFrame(rows, "source string, lat_idx int, lon_idx int, year int, month int, value double")


RUN = dict(keys=["source"], states={"soil": "annual", "leaf": "monthly"}, outputs=["soil", "leaf", "gpp"], initial=2.0, complete=["value"],
           nudging=ro.Nudging({"soil": (20.0, 5.0)}, 0.2), carry="december")


def table(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).na.fill(-1e9).collect()))


def test_broken_run_goes_on(spark, tmp_path):
    df, path = forcing(spark), str(tmp_path / "run")
    whole = table(ro.rollout(df, predict=predict, **RUN))
    with pytest.raises(Exception, match="broken off"):
        rs.rollout_resumable(df, path, predict=predict_until(1905), block_years=2, **RUN)
    kept = rs.predictions(spark, path).agg(F.max("year")).first()[0]
    assert kept == 1904
    assert table(rs.rollout_resumable(df, path, predict=predict_from(1905), block_years=3, **RUN)) == whole
    # Nothing is left to do.
    assert table(rs.rollout_resumable(df, path, predict=predict_from(1999), **RUN)) == whole


def test_units_taken_back_and_new_ones(spark, tmp_path):
    df, path = forcing(spark), str(tmp_path / "run")
    rs.rollout_resumable(df.filter("source = 'a'"), path, predict=predict, block_years=4, **RUN)
    rs.forget(spark, path, spark.createDataFrame([("a",)], "source string"), 1906)
    assert rs.predictions(spark, path).agg(F.max("year")).first()[0] == 1905

    def only_needed(frame):
        assert ((frame["source"] == "b") | (frame["year"] >= 1906)).all()
        return predict(frame)

    assert table(rs.rollout_resumable(df, path, predict=only_needed, block_years=4, **RUN)) == table(ro.rollout(df, predict=predict, **RUN))


def test_attempt_that_missed_the_log_is_not_read(spark, tmp_path, monkeypatch):
    df, path = forcing(spark), str(tmp_path / "run")
    with monkeypatch.context() as m:
        m.setattr(rs, "_append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            rs.rollout_resumable(df, path, predict=predict, block_years=20, **RUN)
    assert table(rs.rollout_resumable(df, path, predict=predict, block_years=20, **RUN)) == table(ro.rollout(df, predict=predict, **RUN))
    empty = rs.rollout_resumable(df.limit(0), str(tmp_path / "none"), predict=predict, **RUN)
    assert empty.collect() == [] and empty.columns == ["source", "lat_idx", "lon_idx", "year", "month", "soil", "leaf", "gpp"]


def test_states_travel_as_numbers(spark, tmp_path, monkeypatch):
    """A column of missing arrays costs Arrow a walk over the whole batch for each row."""
    df, path, fed = forcing(spark), str(tmp_path / "run"), []
    plain = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda d, run, schema, *a, **k: (fed.append((d.dtypes, schema)), plain(d, run, schema, *a, **k))[1])
    rs.rollout_resumable(df, path, predict=predict, block_years=20, **RUN)
    assert len(fed) == 1 and all("array" not in kind for _, kind in fed[0][0]) and "array" not in fed[0][1]
    kept = dict(spark.read.parquet(f"{path}/blocks").dtypes)
    assert kept["states"] == kept["decembers"] == "array<double>"


def test_resumed_query_makes_its_forcing_once(spark, monkeypatch):
    from gridspark.queries import rollout as rq
    made, sf = spark.sparkContext.accumulator(0), "/root/testdata/sf0.001"
    f = rq._pinned_forcing(spark, sf)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    monkeypatch.setattr(rq, "_pinned_forcing", lambda *a: f.mapInArrow(counted, f.schema))
    assert rq.rollout_resumed(spark, sf).count() == made.value == f.count()


@pytest.mark.parametrize("mode", ["none", "original", "z_shrink", "z_mirror", "z_adaptive"])
@pytest.mark.parametrize("lam", [0.0, 0.3, 1.4])
def test_nudging_of_arrays_and_columns_is_one(spark, mode, lam):
    values = [-80.0, -3.0, 0.0, 7.5, 200.0]
    for mean, std in ((5.0, 4.0), (1.0, 0.0)):
        d = spark.createDataFrame([(v, mean, std) for v in values], "v double, m double, s double")
        got = [r[0] for r in d.select(ro.nudge(F.col("v"), F.col("m"), F.col("s"), lam, mode)).collect()]
        assert np.allclose(got, ro.Nudging({"x": (mean, std)}, lam, mode).of("x", np.array(values)), rtol=1e-12)


# ---- keyed state

def test_pieces_in_any_order_twice_and_replaced(spark, tmp_path):
    r = random.Random(3)
    editions = {(p, v): [(k, y, r.uniform(-9, 9) + 1e6) for k in ("x", "y", None) for y in (1901, 1902) for _ in range(r.randint(0, 6))] for p in range(4) for v in (1, 2)}
    editions[0, 2] = [t for t in editions[0, 1] if t[1] == 1901]
    order = [(2, 1), (0, 2), (0, 1), (1, 1), (3, 2), (1, 1), (1, 2), (3, 1), (2, 1)]
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    for i, (p, v) in enumerate(order):
        rows = [(str(p), v, k, y, x) for k, y, x in editions[p, v]] + [(str(p), v, "x", 1901, None)]
        spark.createDataFrame(rows, "piece string, version long, variable string, year int, value double").coalesce(1).write.mode("append").parquet(src)
        if i in (2, 5, 8):
            s = spark.readStream.schema("piece string, version long, variable string, year int, value double").option("maxFilesPerTrigger", 2).parquet(src)
            pieces.keyed_moments(s, out, chk)
    want = {}
    for p, v in ((0, 2), (1, 2), (2, 1), (3, 2)):
        for k, y, x in editions[p, v]:
            want.setdefault((k, y), []).append(x)
    got = {(x.variable, x.year): x for x in pieces.current_moments(spark, out).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].n == len(v) and np.allclose([got[k]["mean"], got[k].std, got[k].min, got[k].max], [np.mean(v), np.std(v), min(v), max(v)], rtol=1e-9, atol=1e-9)


# ---- sketches, shards, samples

@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(6)
    n = 30_000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n))
    value = np.where(rng.random(n) < 0.3, 7.0, np.round(np.exp(rng.normal(0, 4, n)), 3))
    rows = [(int(i), None if k is None else str(k), float(v)) for i, (k, v) in enumerate(zip(key, value))]
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(16).cache(), rows


@pytest.mark.parametrize("slack", [0.004, 1e-7])
def test_quantiles_from_merged_sketches(spark, skewed, monkeypatch, slack):
    """With brackets far too narrow the pass is run again and the ranks are the same."""
    monkeypatch.setattr(rk, "SKETCH_SLACK", slack)
    df, rows = skewed
    probs = [0.0, 0.01, 0.33, 0.5, 0.98, 1.0]
    empty = df.limit(1).select(F.lit("none").alias("k"), F.lit(9).alias("s"), F.lit(None).cast("double").alias("v"))
    shards = rk.quantile_sketches(df.select("k", F.pmod("id", F.lit(7)).cast("int").alias("s"), "v").unionByName(empty), ["k", "s"], "v")
    merged = rk.merge_sketches(shards, ["k"])
    got = {r.k: list(r)[1:] for r in rk.exact_quantiles(df, ["k"], "v", probs, list("abcdef"), sketches=merged).collect()}
    for key in {k for _, k, _ in rows}:
        assert np.allclose(got[key], np.quantile([v for _, k, v in rows if k == key], probs), rtol=1e-12)
    assert "none" not in got


def test_limits_of_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, value double")
    assert {r.k: (r.vmin, r.vmax) for r in ag.robust_limits(df, ["k"]).collect()} == {"a": (1.0, 1.0), "b": (None, None)}
    assert {r.k: r.vmax for r in ag.symmetric_limits(df, ["k"]).collect()} == {"a": 1.0, "b": 1.0}


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_skill_and_moments_from_any_shards(spark, shift):
    rng = np.random.default_rng(8)
    y = rng.normal(0, 1, 3000)
    p = 0.7 * y + rng.normal(0.2, 0.5, 3000)
    rows = [("v", float(a + shift), float(b + shift), int(s)) for a, b, s in zip(y, p, rng.integers(0, 40, 3000) ** 2 // 60)]
    rows += [("v", None, 1.0, 3), ("v", 1.0, None, 77), ("w", None, None, 1)]
    df = spark.createDataFrame(rows, "variable string, y double, yhat double, shard int").cache()
    m = sk.merge_pair_moments(sk.pair_moments(df, ["variable", "shard"]), ["variable"])
    got = {r.variable: r for r in sk.skill_of_moments(m, ["variable"]).collect()}
    v = got["v"]
    want = [1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), np.sqrt(((y - p) ** 2).mean()) / y.std(), np.corrcoef(y, p)[0, 1], y.std(ddof=1), p.std(ddof=1), p.std(ddof=1) / y.std(ddof=1)]
    assert v.n == 3000 and np.allclose([v.r2, v.nrmse, v.acc, v.ref_std, v.std, v.rel_std], want, rtol=1e-6)
    assert got["w"].n == 0 and got["w"].r2 is None and got["w"].acc is None
    a = ag.finish_moments(ag.moments(df, ["variable"], "y")).filter("variable = 'v'").first()
    b = ag.merge_moments(ag.moments(df, ["variable", "shard"], "y")).filter("variable = 'v'").first()
    y = np.append(y, 1.0 - shift)  # the label without a prediction
    assert np.allclose([a.std, b.std], y.std(), rtol=1e-6) and np.allclose([a["mean"], b["mean"]], y.mean() + shift)


def test_samples_of_shards_merge(skewed):
    df, rows = skewed
    for k in (1, 40, 3_000):
        whole = {(r.k, r.id) for r in rk.hash_smallest(df, ["k"], ["id"], lambda n: F.lit(k), seed=2).collect()}
        parts = None
        for s in range(3):
            part = rk.hash_smallest(df.filter(F.pmod("id", F.lit(3)) == s), ["k"], ["id"], lambda n: F.lit(k), seed=2, keep_hash="h")
            parts = part if parts is None else parts.unionByName(part)
        assert {(r.k, r.id) for r in rk.merge_smallest(parts, ["k"], ["id"], k, "h").collect()} == whole


def test_sample_in_small_buckets_and_a_threshold_too_low(skewed, monkeypatch):
    df, rows = skewed
    want = {r.id for r in rk.hash_smallest(df, [], ["id"], lambda n: F.lit(5_000), seed=4).collect()}
    monkeypatch.setattr(rk, "BUCKET_ROWS", 100)
    assert {r.id for r in rk.hash_smallest(df, [], ["id"], lambda n: F.lit(5_000), seed=4).collect()} == want
    real = rk.hash_key
    # Hashes crowded at the upper end: the first thresholds let too few through.
    monkeypatch.setattr(rk, "hash_key", lambda *c, seed=0: F.lit((1 << 60) - 1) - (F.lit((1 << 60) - 1) - real(*c, seed=seed)) / 64)
    assert {r.id for r in rk.hash_smallest(df, [], ["id"], lambda n: F.lit(5_000), seed=4).collect()} == want
    assert sa.uniform_sample(df.limit(0), ["k"], ["id"], 5).collect() == []


# ---- as-of joins

def brute_asof(left, right, direction, tolerance):
    best = {}
    for k, t, v in right:
        if t is not None:
            best[k, t] = max(best.get((k, t), (False, None)), (v is not None, v))
    out = []
    for i, k, t in left:
        near = [(abs(t - u), u > t, u, v[1]) for (q, u), v in best.items() if t is not None and q == k and (direction == "nearest" or (u <= t if direction == "backward" else u >= t))]
        hit = min(near, default=None, key=lambda x: x[:3])
        if hit and tolerance is not None and hit[0] > tolerance:
            hit = None
        out.append((i, k, t, hit and hit[2], hit and hit[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_asof_against_brute_force(spark, direction, tolerance):
    r = random.Random(5)
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), r.choice([None, *range(0, 200)])) for i in range(600)] + [(1000 + i, "hot", 50) for i in range(300)] + [(2000, "alone", 3)]
    right = [(key(), r.choice([None, *range(-10, 215, 3)]), r.choice([None, *[float(x) for x in range(9)]])) for _ in range(120)] + [("other", 3, 1.0)]
    a = spark.createDataFrame(left, "id int, k string, t int").repartition(5)
    b = spark.createDataFrame(right, "k string, t int, v double").repartition(3)
    for ranges in (1, 40):
        got = asof_join(a, b, "t", ["k"], direction, tolerance, ranges=ranges)
        assert got.columns == ["id", "k", "t", "t_right", "v"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_asof(left, right, direction, tolerance)


def test_nearest_summarises_its_ranges_once(spark, monkeypatch):
    from gridspark.operators import asof
    kept, plain = [], asof.stored
    monkeypatch.setattr(asof, "stored", lambda df, name: (kept.append((name, df)), plain(df, name))[1])
    a, b = spark.range(40).selectExpr("id", "cast(id as int) AS t"), spark.createDataFrame([(3, "x"), (30, "y")], "t int, c string")
    got = asof_join(a, b, "t", direction="nearest", ranges=8)
    assert [n for n, _ in kept] == ["asof", "borders"] and kept[1][1].count() == 8
    assert [r.c for r in got.orderBy("id").collect()] == ["x"] * 17 + ["y"] * 23


def test_asof_without_keys_and_rows(spark):
    a = spark.createDataFrame([(1, 1.5), (2, None)], "id int, t double")
    b = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "t double, c string")
    assert [tuple(r) for r in asof_join(a, b, "t", direction="nearest").orderBy("id").collect()] == [(1, 1.5, 1.0, "x"), (2, None, None, None)]
    assert [tuple(r) for r in asof_join(a, b.limit(0), "t").orderBy("id").collect()] == [(1, 1.5, None, None), (2, None, None, None)]
    assert asof_join(a.limit(0), b, "t").collect() == []
    with pytest.raises(ValueError):
        asof_join(a, b, "t", direction="sideways")


@pytest.mark.parametrize("direction", ["forward", "nearest"])
def test_asof_reads_each_row_once(spark, direction):
    """A frame that begins at its row is summed up anew for every row of a range."""
    a, b = spark.range(3000).selectExpr("id", "id * 2 AS t"), spark.range(1000).selectExpr("id * 6 + 1 AS t", "id AS v")
    got = asof_join(a, b, "t", direction=direction, ranges=1)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    for i, t, at, v in got.collect():
        after = next((x for x in range(t, t + 7) if x % 6 == 1 and x < 6000), None)
        before = next((x for x in range(t, t - 7, -1) if x % 6 == 1 and x >= 0), None)
        want = after if direction == "forward" else min((x for x in (before, after) if x is not None), key=lambda x: (abs(x - t), x))
        assert (at, v) == ((want, want // 6) if want is not None else (None, None))


def test_evaluation_predicts_once(spark, tmp_path):
    """One call of the predictor for each year of a window, however many tables its rows go into."""
    def counted(frame):
        (tmp_path / uuid.uuid4().hex).touch()
        return pd.DataFrame({"soil": 0.6 * frame["soil"] + 0.4 * frame["value"], "gpp": frame["value"]})

    rows = [("M0", 0, 0, y, m, float(y % 7 + m), 5.0) for y in (2001, 2002, 2003) for m in (1, 2)]
    table = spark.createDataFrame(rows, "source string, lat_idx int, lon_idx int, year int, month int, value double, start_soil double")
    labels = table.select("source", "lat_idx", "lon_idx", "year", "month", F.lit("gpp").alias("variable"), (F.col("value") + F.col("month")).alias("value"))
    labels = labels.unionByName(labels.filter("month = 1").withColumns({"variable": F.lit("soil"), "month": F.lit(None).cast("int")}))
    d = ev.evaluate_modes(table, labels, ["source"], counted, {"soil": "annual"}, ["soil", "gpp"], monthly=["gpp"], annual=["soil"], complete=["value"])
    got = {(r["mode"], r["variable"]): r["n"] for r in d.collect()}
    want = {"teacher_forced": (6, 3), "full_sequence": (6, 3), "tail_only": (4, 2)}
    assert got == {(m, v): n for m, (g, a) in want.items() for v, n in (("gpp", g), ("soil", a), (sk.GLOBAL_ROW, g + a))}
    assert len(list(tmp_path.iterdir())) == 3 + 3 + 2 * 2


def test_series_on_an_irregular_axis(spark):
    f = spark.createDataFrame([("s", 3, 1.0), ("s", 10, None), ("s", 12, 5.0)], "k string, t int, value double")
    axis = spark.createDataFrame([("s", t) for t in (1, 3, 11, 40)], "k string, t int")
    assert [r.value for r in hold_last(f, axis, ["k"], tolerance=10).orderBy("t").collect()] == [None, 1.0, 1.0, None]
    assert [r.value for r in nearest_step(f, axis, ["k"]).orderBy("t").collect()] == [1.0, 1.0, 5.0, 5.0]


# ---- filling

def test_nearest_source_against_brute_force(spark):
    grid = GridSpec(nlat=12, nlon=20)
    have = [(0, 0), (0, 19), (5, 7), (5, 9), (11, 3), (40, 1)]
    got = {(r.lat_idx, r.lon_idx): (r.src_lat, r.src_lon, r.steps) for r in fi.nearest_source(spark.createDataFrame(have, "lat_idx int, lon_idx int"), grid).collect()}
    assert len(got) == grid.nlat * grid.nlon
    for (y, x), (sy, sx, steps) in got.items():
        far = min((max(abs(y - a), min(abs(x - o), grid.nlon - abs(x - o))), a, o) for a, o in have if a < grid.nlat)
        assert (steps, sy, sx) == far
    assert fi.nearest_source(spark.createDataFrame([], "lat_idx int, lon_idx int"), grid).collect() == []


def test_no_location_is_lost(spark):
    template = spark.createDataFrame([(100, 5, d, float(d)) for d in (1, 32)] + [(300, 700, 1, 9.0)], "lat_idx int, lon_idx int, doy int, value double")
    places = spark.createDataFrame([(i, -80.0 + 7 * i, 20.0 * i) for i in range(20)] + [(99, None, 1.0)], "id int, lat double, lon double")
    got = fi.nearest_template(places, template)
    assert got.select("id").distinct().count() == 21
    assert got.filter("id < 99 and value is null").count() == 0 and got.filter("id = 99 and value is null").count() == 1
    assert fi.nearest_template(places, template, empty="drop").count() == 0
    with pytest.raises(Exception, match="no template"):
        fi.nearest_template(places, template, empty="fail").collect()


def test_fill_in_rounds_equals_the_fill_again_and_again(spark):
    r = random.Random(2)
    rows = [(k, y, x, int(r.random() < 0.9), float(r.randint(0, 9)) if r.random() < 0.15 else None) for k in (1, 2) for y in range(0, 10) for x in range(0, 10)]
    df = spark.createDataFrame(rows, "k int, lat_idx int, lon_idx int, land int, value double").cache()
    once = df
    for n in (1, 2):
        once = fi.spatial_fill(once, ["k"])
        got = {(a.k, a.lat_idx, a.lon_idx): a.value for a in fi.fill_all(df, ["k"], rounds=n).collect()}
        assert got == pytest.approx({(a.k, a.lat_idx, a.lon_idx): a.value for a in once.collect()})
    done = fi.fill_all(df, ["k"])
    assert done.filter("land = 1 and value is null").count() == 0
    assert done.filter("land = 0").exceptAll(df.filter("land = 0")).count() == 0


# ---- layouts

def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_work_by_cell_on_a_layout_shuffles_nothing(spark):
    key = ["source", "lat_idx", "lon_idx"]
    d = spark.range(4000).select(F.concat(F.lit("m"), F.pmod("id", F.lit(2)).cast("string")).alias("source"), (F.pmod("id", F.lit(40))).cast("int").alias("lat_idx"),
                                 F.lit(3).alias("lon_idx"), (1901 + F.floor(F.col("id") / 40)).cast("int").alias("year"), (F.rand(1) * 50).alias("value"))
    d = d.cache()
    label = d.withColumnRenamed("value", "y")
    predicted = d.withColumn("yhat", F.col("value") * 2).drop("value")
    held = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(held, "false")
    tables = [layout.read_layout(spark, layout.write_layout(x, ["source", "year"], buckets=4)) for x in (d, label, predicted)]
    plans = {
        "trend": lambda f, a, b: se.linear_trend(f.withColumn("t", F.col("year")), key),
        "join": lambda f, a, b: jn.align_inner(a, b, [*key, "year"]),
        "skill": lambda f, a, b: sk.cell_metrics(jn.align_inner(a, b, [*key, "year"]), key),
    }
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, plan in plans.items():
            on_layout = plan(*tables)
            assert exchanges(on_layout) == 0, name
            a, b = (on_layout.orderBy(*on_layout.columns[:4]).toPandas(), plan(d, label, predicted).orderBy(*on_layout.columns[:4]).toPandas())
            pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-9)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert layout.buckets_for(0) == 1 and layout.buckets_for(10 * layout.BUCKET_ROWS) == 16


def test_samples_from_wide_tables_made_once(spark, monkeypatch):
    from gridspark.functions.sizing import stored
    from gridspark.operators import samples as sm
    from gridspark.queries import samples as sq
    sf, made = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0)
    tables = [stored(d, "samples") for d in sq._sample_tables(spark, sf)]
    stats = stored(sq._sample_stats(*tables), "stats")
    by = [[c for c in d.columns if c in ("scenario", "loc_id", "year", "month", "t")] for d in tables]
    names = [[c for c in d.columns if c not in b] for d, b in zip(tables, by)]
    # A missing value of a state stays one in the next month.
    tables[1] = tables[1].withColumn("lai", F.when(F.col("month") != 5, F.col("lai")))
    long = [d.unpivot(b, n, "variable", "value") for d, b, n in zip(tables, by, names)]
    rows = lambda given: sorted(map(tuple, sm.assemble_samples(*given, stats, *names, monthly_states=["lai"], annual_states=["cVeg"]).na.fill(-1e9).collect()))
    assert rows(tables) == rows(long) and len(rows(long)) > 100
    with pytest.raises(Exception, match="no usable statistics"):
        sm.standardise_columns(tables[2], stats.filter("variable <> 'co2'"), ["co2", "cVeg"]).collect()

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    given = [d.mapInArrow(counted, d.schema) for d in tables]
    monkeypatch.setattr(sq, "_sample_tables", lambda *a: given)
    sq.assemble_samples(spark, sf).collect()
    assert made.value == sum(d.count() for d in tables)
