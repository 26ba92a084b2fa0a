"""Standardisation and training-sample assembly."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridspark.functions.nulls import finite
from gridspark.functions.sizing import broadcast_bounded, one_row
from gridspark.operators.series import lag_state
from gridspark.schema import INPUT_GROUPS, OUTPUT_GROUPS


def stats_of(stats: DataFrame, variables) -> DataFrame:
    """mean and std of the listed variables; two rows of one variable fail the job."""
    twice = F.raise_error(F.concat(F.lit("two statistics rows of "), F.col("variable"))).cast("double")
    d = (stats.filter(F.col("variable").isin(*variables)).groupBy("variable")
         .agg(F.first("mean").alias("mean"), F.first("std").alias("std"), F.count(F.lit(1)).alias("__n")))
    return d.select("variable", *[F.when(F.col("__n") == 1, F.col(c)).otherwise(twice).alias(c) for c in ("mean", "std")])


def standardise(df: DataFrame, stats: DataFrame, variables, value: str = "value") -> DataFrame:
    """z = (x - mean) / std; absent statistics or std <= 0 fail the job."""
    s = broadcast_bounded(stats_of(stats, variables), len(variables))
    d = df.filter(F.col("variable").isin(*variables)).join(s, "variable", "left")
    ok = finite("mean") & finite("std") & (F.coalesce(F.col("std"), F.lit(0.0)) > 0)
    bad = F.raise_error(F.concat(F.lit("no usable statistics for "), F.col("variable"))).cast("double")
    z = F.when(ok, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(bad)
    return d.withColumn(value, z).drop("mean", "std")


def standardise_columns(df: DataFrame, stats: DataFrame, names) -> DataFrame:
    """:func:`standardise` of a wide table, which has a column for each variable."""
    s = stats_of(stats, names)
    row = one_row(s.agg(*[F.max(F.when(F.col("variable") == n, F.struct("mean", "std"))).alias(f"s{i}") for i, n in enumerate(names)]))
    z = {}
    for i, n in enumerate(names):
        mean, std = row[f"s{i}"]["mean"], row[f"s{i}"]["std"]
        ok = finite(mean) & finite(std) & (F.coalesce(std, F.lit(0.0)) > 0)
        z[n] = F.when(ok, (F.col(n) - mean) / std).otherwise(F.raise_error(F.lit(f"no usable statistics for {n}")).cast("double"))
    return df.withColumns(z)


def destandardise(df: DataFrame, stats: DataFrame, variables, value: str = "value") -> DataFrame:
    """x = z * std + mean, with mean 0 and std 1 where none is known."""
    s = broadcast_bounded(stats_of(stats, variables), len(variables))
    d = df.join(s, "variable", "left")
    x = F.col(value) * F.coalesce("std", F.lit(1.0)) + F.coalesce("mean", F.lit(0.0))
    return d.withColumn(value, x).drop("mean", "std")


def stats_vectors(stats: DataFrame, names) -> DataFrame:
    """Mean and std arrays in the order of ``names``; 0 and 1 replace non-finite means,
    non-finite or zero stds and unknown variables."""
    s = stats_of(stats, names)
    mean = F.when(finite("mean"), F.col("mean")).otherwise(0.0)
    std = F.when(finite("std") & (F.col("std") != 0), F.col("std")).otherwise(1.0)
    m = s.agg(F.map_from_entries(F.collect_list(F.struct("variable", F.struct(mean.alias("m"), std.alias("s"))))).alias("__m"))
    order = F.array(*[F.lit(n) for n in names])
    pick = lambda field, default: F.transform(
        order, lambda v: F.coalesce(F.try_element_at("__m", v)[field], F.lit(default)))
    return m.select(pick("m", 0.0).alias("mean"), pick("s", 1.0).alias("std"))


def channel_table(spark: SparkSession, present=None) -> DataFrame:
    """Ordered channels: role input/output, group, name, index; sorted inside a group."""
    rows = []
    for role, groups in (("input", INPUT_GROUPS), ("output", OUTPUT_GROUPS)):
        i = 0
        for group, names in groups:
            for n in sorted(names):
                if present is None or n in present:
                    rows.append((role, group, n, i))
                    i += 1
    return spark.createDataFrame(rows, "role string, channel_group string, variable string, channel_idx int")


def order_channels(df: DataFrame, role: str = "input") -> DataFrame:
    """Channel index of the variables present in ``df``, dense over those present."""
    names = df.select("variable").distinct()
    c = channel_table(df.sparkSession).filter(F.col("role") == role)
    d = c.join(names, "variable", "left_semi")
    rank = F.row_number().over(W.partitionBy("role").orderBy("channel_idx")) - 1
    return d.withColumn("channel_idx", rank.cast("int"))


def _columns(df: DataFrame, stats: DataFrame, names, by) -> DataFrame:
    """Standardised values, one column per variable; there is one row per key and variable, or per key where ``df`` is wide."""
    if "variable" not in df.columns:
        return standardise_columns(df.select(*by, *names), stats, names)
    z = standardise(df, stats, names)
    return z.groupBy(*by).agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names])


def _without_first_year(df: DataFrame, keys) -> DataFrame:
    first = F.min("year").over(W.partitionBy(*keys))
    return df.withColumn("__first", first).filter(F.col("year") > F.col("__first")).drop("__first")


def assemble_samples(daily: DataFrame, monthly: DataFrame, annual: DataFrame, stats: DataFrame,
                     daily_vars, monthly_vars, annual_vars, monthly_states=(), annual_states=(),
                     keys=("scenario", "loc_id")) -> DataFrame:
    """Daily sample rows, one column per input channel. The tables are long, or wide with a column for each
    variable, where a row stands for its step in all of them.

    States are lagged by one month or one year, every value is standardised, monthly and
    annual values are held over their days, and the first year of a location, whose lag
    is a dummy, is dropped. Monthly and annual columns meet first, at monthly resolution;
    the daily rows are shuffled once, by location and month, for both their own grouping
    and that join.
    """
    keys = list(keys)

    def lagged(df, states, order):
        if not states:
            return df
        if "variable" not in df.columns:
            for n in states:
                df = lag_state(df, keys, order, n, f"__{n}")
            return df.withColumns({n: F.col(f"__{n}") for n in states})
        s = lag_state(df, [*keys, "variable"], order, out="__p")
        state = F.col("variable").isin(*states)
        return s.withColumn("value", F.when(state, F.col("__p")).otherwise(F.col("value"))).drop("__p")

    m = _columns(lagged(monthly, monthly_states, ["year", "month"]), stats, monthly_vars, [*keys, "year", "month"])
    a = _columns(lagged(annual, annual_states, "year"), stats, annual_vars, [*keys, "year"])
    slow = m.join(_without_first_year(a, keys), [*keys, "year"])
    spread = daily.repartition(*keys, "year", "month") if "variable" in daily.columns else daily
    d = _columns(spread, stats, daily_vars, [*keys, "year", "month", "t"])
    order = [*daily_vars, *monthly_vars, *annual_vars]
    return d.join(slow, [*keys, "year", "month"]).select(*keys, "year", "month", "t", *order)


def assemble_labels(monthly: DataFrame, annual: DataFrame, stats: DataFrame, monthly_vars, annual_vars,
                    keys=("scenario", "loc_id")) -> tuple[DataFrame, DataFrame]:
    """Standardised monthly and annual labels, without the first year of a location."""
    keys = list(keys)
    m = _columns(monthly, stats, monthly_vars, [*keys, "year", "month"])
    a = _columns(annual, stats, annual_vars, [*keys, "year"])
    return _without_first_year(m, keys), _without_first_year(a, keys)


def location_blocks(locations: DataFrame, block: int = 70, loc: str = "loc_id", keys=()) -> DataFrame:
    """Block of each location; an incomplete last block is dropped. loc counts from 1."""
    b = locations.withColumn("block_id", F.floor((F.col(loc) - 1) / block).cast("int"))
    full = (b.groupBy(*keys, "block_id").agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") == block).drop("__n"))
    return b.join(full, [*keys, "block_id"], "left_semi")


def resolution_checks(counts: DataFrame, min_years: int = 2) -> DataFrame:
    """Per store: daily = 365 Y, monthly = 12 Y, Y at least ``min_years``."""
    y = F.col("n_years")
    issues = F.array(
        F.when(F.col("n_days") != 365 * y, "daily length is not 365 Y"),
        F.when(F.col("n_months") != 12 * y, "monthly length is not 12 Y"),
        F.when(y < min_years, "too few years"))
    return counts.withColumn("issues", F.array_compact(issues))


def transfer_window(df: DataFrame, store, y0: int, y1: int, scenario: str = "S3", min_years: int = 2) -> DataFrame:
    """One scenario inside a window of years, stores with enough years only."""
    d = df.filter((F.col("scenario") == scenario) & F.col("year").between(y0, y1))
    long_enough = (d.groupBy(*store).agg(F.countDistinct("year").alias("__y"))
                   .filter(F.col("__y") >= min_years).drop("__y"))
    return d.join(long_enough, list(store), "left_semi")


def window_counts(batches: DataFrame, split: str = "split", accum_steps: int = 1) -> DataFrame:
    """Batches, windows = L * (Y - 1) summed over batches, and steps per epoch.

    ``batches`` has one row per batch with n_locations and n_years.
    """
    windows = F.sum(F.col("n_locations") * F.greatest(F.col("n_years") - 1, F.lit(0)))
    return (batches.groupBy(split).agg(F.count(F.lit(1)).alias("batches"), windows.alias("windows"))
            .withColumn("steps_per_epoch", F.ceil(F.col("windows") / max(1, accum_steps))))


def carry_windows(locations: DataFrame, n_years: str, carry: int, min_target: int = 0) -> DataFrame:
    """(location, target year) with the carry+1 consecutive year positions it reads.

    Targets run from max(carry, min_target, 1) to n_years - 1.
    """
    first = max(carry, min_target, 1)
    d = locations.filter(F.col(n_years) > first)
    d = d.withColumn("target_year", F.explode(F.sequence(F.lit(first), (F.col(n_years) - 1).cast("int"))))
    return d.withColumn("year_pos", F.explode(F.sequence(F.col("target_year") - carry, F.col("target_year"))))

