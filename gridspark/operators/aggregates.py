"""Space, time and ensemble aggregation.

Plain and weighted means are algebraic, so Spark combines them before the shuffle and
a hot key costs one partial row per task.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridspark.functions import noleap as nl
from gridspark.functions.geo import GridSpec, HALF_DEGREE, lat_band
from gridspark.functions.nulls import only_value, sum0, weighted_avg
from gridspark.functions.ranking import exact_quantiles, quantile_sketches
from gridspark.functions.sizing import broadcast_bounded, one_row, stored

# Seconds of a mean month, and kilograms per Gt, used for budgets.
SECONDS_PER_MEAN_MONTH = 365.0 / 12.0 * 86400.0
KG_PER_GT = 1e12
BAND_PROBS = {"p50_low": 0.25, "p50_high": 0.75, "p75_low": 0.125, "p75_high": 0.875}


def time_mean(df: DataFrame, keys, value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def space_mean(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Unweighted mean over cells per key and time step."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def space_mean_cos(df: DataFrame, keys, grid: GridSpec = HALF_DEGREE, value: str = "value") -> DataFrame:
    """Mean over cells weighted by the cosine of latitude."""
    w = F.cos(F.radians(grid.lat("lat_idx")))
    return df.groupBy(*keys).agg(weighted_avg(F.col(value), w).alias(value))


def annual_mean_of_space_mean(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Space first, then the months of a year; the order matters when cells are missing."""
    monthly = space_mean(df, [*keys, "year", "month"], value)
    return monthly.groupBy(*keys, "year").agg(F.avg(value).alias(value))


def annual_totals(df: DataFrame, keys, grid: GridSpec = HALF_DEGREE, value: str = "value",
                  scale: float = KG_PER_GT) -> DataFrame:
    """Area- and time-integrated total per year, a month counting 365/12 days."""
    v = F.col(value) * grid.area("lat_idx")
    return df.groupBy(*keys, "year").agg(
        (sum0(v) * SECONDS_PER_MEAN_MONTH / scale).alias("total"))


def period_totals(df: DataFrame, keys, grid: GridSpec = HALF_DEGREE, value: str = "value",
                  scale: float = KG_PER_GT) -> DataFrame:
    """Total of the whole period and its mean per year present."""
    years = annual_totals(df, keys, grid, value, scale)
    return years.groupBy(*keys).agg(F.sum("total").alias("total"),
                                    F.avg("total").alias("mean_per_year"))


def monthly_climatology(df: DataFrame, keys, value: str = "value") -> DataFrame:
    return df.groupBy(*keys, "month").agg(F.avg(value).alias(value))


def seasonal_cycle_two_stage(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Space mean per step, then the mean of each month over the years."""
    monthly = space_mean(df, [*keys, "year", "month"], value)
    return monthly.groupBy(*keys, "month").agg(F.avg(value).alias(value))


def seasonal_cycle_one_pass(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Mean of each month over time and space at once."""
    return df.groupBy(*keys, "month").agg(F.avg(value).alias(value))


def doy_climatology(df: DataFrame, keys, t: str = "t", value: str = "value") -> DataFrame:
    return df.groupBy(*keys, nl.doy_of(t).alias("doy")).agg(F.avg(value).alias(value))


def latitude_row_means(df: DataFrame, keys, grid: GridSpec = HALF_DEGREE, value: str = "value") -> DataFrame:
    """Mean over longitude and time for every native latitude row."""
    d = df.groupBy(*keys, "lat_idx").agg(F.avg(value).alias(value))
    return d.withColumn("lat", grid.lat("lat_idx"))


def latitude_band_means(df: DataFrame, keys, grid: GridSpec = HALF_DEGREE, value: str = "value") -> DataFrame:
    """Mean per 1-degree latitude band."""
    band = lat_band(grid.lat("lat_idx"))
    return (df.groupBy(*keys, band.alias("lat_band")).agg(F.avg(value).alias(value))
            .filter(F.col("lat_band").isNotNull()))


def latitude_weights(cells: DataFrame, code: str = "tvt", test_code: int = 2,
                     grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Area of the test cells of each latitude row, with the cosine formula."""
    n = F.sum(F.when(F.col(code) == test_code, 1).otherwise(0))
    return (cells.groupBy("lat_idx").agg(n.alias("n_test"))
            .withColumn("weight", F.col("n_test") * grid.area_cos("lat_idx")))


def global_mean_from_rows(rows: DataFrame, weights: DataFrame, keys, value: str = "value",
                          grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Weighted mean of latitude rows; only positive weights and present values count."""
    w = weights.select("lat_idx", "weight").filter(F.col("weight") > 0)
    d = rows.join(F.broadcast(w) if grid.nlat <= 10_000 else w, "lat_idx")
    return d.groupBy(*keys).agg(weighted_avg(F.col(value), F.col("weight")).alias(value))


def ensemble_mean(df: DataFrame, keys, n_members: int, value: str = "value") -> DataFrame:
    """Mean over members, missing as soon as one of ``n_members`` is missing or has no row."""
    return df.groupBy(*keys).agg(F.when(F.count(value) == n_members, F.avg(value)).alias(value))


def scenario_mean(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Mean over scenarios; ``keys`` leave the scenario out."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def _band_aggs(value):
    """Ranges and quantiles of a small group: one value per model."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in BAND_PROBS.values()]))
    return [F.min(value).alias("band_min"), F.max(value).alias("band_max"), q.alias("__q")]


def _unpack_bands(df):
    cols = {n: F.col("__q")[i] for i, n in enumerate(BAND_PROBS)}
    return df.withColumns(cols).drop("__q")


def ensemble_bands(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Range, 50 % band and 75 % band across models per key.

    ``df`` has one value per model and key, so a group is as large as the model list.
    """
    return _unpack_bands(df.groupBy(*keys).agg(*_band_aggs(value)))


def box_statistics(df: DataFrame, keys, model: str = "source", value: str = "value") -> DataFrame:
    """Median and bands of the per-model totals."""
    totals = df.groupBy(*keys, model).agg(F.sum(value).alias("__total"))
    out = totals.groupBy(*keys).agg(F.median("__total").alias("median"), *_band_aggs("__total"))
    return _unpack_bands(out)


def bands_of_scenario_means(df: DataFrame, keys, model: str = "source", value: str = "value") -> DataFrame:
    """Scenario mean per model first, bands across models second."""
    means = df.groupBy(*keys, model).agg(F.avg(value).alias(value))
    return ensemble_bands(means, keys, value)


def scenario_means_of_bands(df: DataFrame, keys, n_scenarios: int, scenario: str = "scenario",
                            value: str = "value") -> DataFrame:
    """Bands per scenario first, then their mean on keys every scenario has."""
    names = ["band_min", "band_max", *BAND_PROBS]
    bands = ensemble_bands(df, [*keys, scenario], value)
    return (bands.groupBy(*keys)
            .agg(*[F.avg(n).alias(n) for n in names], F.count(scenario).alias("__n"))
            .filter(F.col("__n") == n_scenarios).drop("__n"))


def moments(df: DataFrame, keys=("variable",), value: str = "value") -> DataFrame:
    """n, sum, sum of squares, min, max and the sum of squared deviations ``m2`` of present values in one pass."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"),
        F.min(v).alias("min"), F.max(v).alias("max"), (F.var_pop(v) * F.count(v)).alias("m2"))


def _spread(m: DataFrame):
    """Sum of squared deviations; from the sum of squares, which loses digits far from 0, only where a
    stored entry has nothing better."""
    plain = F.greatest(F.col("sumsq") - F.try_divide(F.col("sum") * F.col("sum"), F.col("n")), F.lit(0.0))
    return F.coalesce("m2", plain) if "m2" in m.columns else plain


def finish_moments(m: DataFrame) -> DataFrame:
    """Mean and population standard deviation."""
    return m.withColumns({"mean": F.try_divide("sum", "n"), "std": F.sqrt(F.try_divide(_spread(m), F.col("n")))}).drop("m2")


def merge_moments(shards: DataFrame, keys=("variable",)) -> DataFrame:
    """Merge partial moments; empty shards drop out. Deviations meet pairwise, about the means, so far
    from 0 no digit is lost."""
    one = F.struct(F.col("n").cast("double").alias("n"), F.array(F.try_divide("sum", "n")).alias("mean"), F.array(_spread(shards)).alias("m2"), F.lit(None).cast("double").alias("c"))
    d = shards.filter(F.col("n") > 0).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq"),
        F.min("min").alias("min"), F.max("max").alias("max"), merged_deviations(one).alias("__m"))
    return finish_moments(d.withColumn("m2", F.col("__m.m2")[0]).drop("__m"))


def merged_deviations(shard: Column) -> Column:
    """Aggregate over shards, each a struct of n, mean (of one or two series), m2 (their squared
    deviations) and c (their product of deviations), to the same of all rows. A group has as many
    entries as shards; their order does not matter."""
    def step(a, b):
        n = a["n"] + b["n"]
        gap = F.zip_with(a["mean"], b["mean"], lambda x, y: y - x)
        share = b["n"] / n
        m2 = F.zip_with(F.zip_with(a["m2"], b["m2"], lambda x, y: x + y), gap, lambda x, d: x + d * d * a["n"] * share)
        return F.struct(n.alias("n"), F.zip_with(a["mean"], gap, lambda x, d: x + d * share).alias("mean"), m2.alias("m2"),
                        (a["c"] + b["c"] + F.get(gap, F.lit(0)) * F.get(gap, F.lit(1)) * a["n"] * share).alias("c"))

    every = F.sort_array(F.collect_list(shard))
    return F.aggregate(F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0))), F.get(every, F.lit(0)), step)


def residual_statistics(df: DataFrame, keys, value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg(F.abs(v)).alias("mean_abs"), F.avg(v * v).alias("mse"))


def weighted_shard_mean(shards: DataFrame, keys, mean: str = "mean", weight: str = "weight") -> DataFrame:
    """Combine shard means; a missing mean or a weight of 0 or less is left out."""
    ok = F.col(mean).isNotNull() & (F.col(weight) > 0)
    return shards.filter(ok).groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(mean) * F.col(weight)), F.sum(weight)).alias(mean))


def binned_means(df: DataFrame, x: str, ys, bins: int = 20) -> DataFrame:
    """Mean and population std of ``ys`` in equal bins of [0, max x); empty bins stay.

    Rows must be present in every column. x equal to the maximum falls outside the last,
    half-open bin.
    """
    df = df.dropna(subset=[x, *ys])
    top = df.agg(F.max(x).alias("__max"))
    d = df.withColumn("__max", one_row(top)["__max"])
    d = d.withColumn("bin", F.floor(F.try_divide(F.col(x) * bins, F.col("__max"))).cast("int"))
    aggs = []
    for y in ys:
        aggs += [F.avg(y).alias(f"{y}_mean"), F.stddev_pop(y).alias(f"{y}_std")]
    found = (d.filter((F.col(x) >= 0) & (F.col(x) < F.col("__max")))
             .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *aggs))
    every = (top.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
             .withColumn("center", (F.col("bin") + 0.5) * F.col("__max") / bins).drop("__max"))
    return every.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def histogram(df: DataFrame, keys, value: str, lo: float, hi: float, bins: int,
              density: bool = False) -> DataFrame:
    """Counts in equal bins of [lo, hi], the last one closed; optionally as density."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    d = (df.filter(F.col(value).between(lo, hi)).groupBy(*keys, b.alias("bin"))
         .agg(F.count(F.lit(1)).alias("n")))
    if density:
        total = F.sum("n").over(W.partitionBy(*keys))
        d = d.withColumn("density", F.col("n") / (total * width))
    return d


def point_density(df: DataFrame, x: str, y: str, x_range, y_range, bins: int = 50,
                  key: str | None = None) -> DataFrame:
    """Number of points sharing the 2-D bin of each point, optionally per key value."""
    def bucket(c, lo, hi):
        return F.greatest(F.lit(0), F.least(
            F.lit(bins - 1), F.floor((F.col(c) - lo) / ((hi - lo) / bins)))).cast("int")
    keys = [key] if key else []
    d = df.withColumns({"__bx": bucket(x, *x_range), "__by": bucket(y, *y_range)})
    counts = d.groupBy(*keys, "__bx", "__by").agg(F.count(F.lit(1)).alias("density"))
    if not key:
        return d.join(broadcast_bounded(counts, bins * bins), ["__bx", "__by"]).drop("__bx", "__by")
    c = counts.withColumnsRenamed({key: "__k", "__bx": "__cx", "__by": "__cy"})
    on = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__bx") == F.col("__cx")) & (F.col("__by") == F.col("__cy"))
    return d.join(c, on).drop("__bx", "__by", "__k", "__cx", "__cy")


def _beside(groups: DataFrame, found: DataFrame, keys, names) -> DataFrame:
    """Every group with its row of ``found``, missing where it has none; missing keys meet."""
    right = found.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], *names)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__{i}"))
    if not keys:  # one row on either side
        row = one_row(right)
        return groups.withColumns({n: row[n] for n in names})
    return groups.join(right, on, "left").drop(*[f"__{i}" for i in range(len(keys))])


def robust_limits(df: DataFrame, keys, value: str = "value", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Percentile range, starting at 0 when no value is negative; a flat range gives the
    data range and a group without values none. Quantiles are exact and groups may be of any size."""
    ends = stored(quantile_sketches(df, keys, value), "sketches")
    q = _beside(ends.select(*keys, F.col("min").alias("__min"), F.col("max").alias("__max")),
                exact_quantiles(df, keys, value, [low, high], ["__lo", "__hi"], sketches=ends), keys, ["__lo", "__hi"])
    flat = F.col("__lo") == F.col("__hi")
    vmin = F.when(flat, F.col("__min")).when(F.col("__min") >= 0, 0.0).otherwise(F.col("__lo"))
    vmax = F.when(flat, F.col("__max")).otherwise(F.col("__hi"))
    return q.select(*keys, vmin.alias("vmin"), vmax.alias("vmax"))


def symmetric_limits(df: DataFrame, keys, value: str = "value", pct: float = 0.99,
                     default: float = 1.0) -> DataFrame:
    """Plus and minus a percentile of the absolute values; ``default`` when it is 0 or the
    group has no value."""
    d = df.select(*keys, F.abs(value).alias("__abs"))
    every = stored(quantile_sketches(d, keys, "__abs"), "sketches")
    q = _beside(every.select(*keys), exact_quantiles(d, keys, "__abs", [pct], ["__a"], sketches=every), keys, ["__a"])
    a = F.when(F.col("__a") > 0, F.col("__a")).otherwise(F.lit(default))
    return q.select(*keys, (-a).alias("vmin"), a.alias("vmax"))


def quantile_clip(df: DataFrame, keys, value: str = "value", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Clip range of a map from two quantiles."""
    return exact_quantiles(df, keys, value, [low, high], ["clip_low", "clip_high"])


def report_table(df: DataFrame, key, column: str, values, value: str = "value") -> DataFrame:
    """Wide report: rows are keys, one column per listed model; keys of any model appear."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).pivot(column, list(values)).agg(only_value(value))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
