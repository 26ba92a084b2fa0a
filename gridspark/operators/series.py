"""Per-series windows: rolling means, lags, stocks, trends, anomalies.

A series is one cell of one variable, source and scenario. It has at most one row per
calendar step, so a window over a series sorts at most 44,895 rows. Steps are counted, not
rows: a step without a row is a step whose value is missing.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions import noleap as nl


def _step(order):
    """Number of a step: a column that counts steps, or (year, month) counted in months."""
    step = F.col(order) if isinstance(order, str) else F.col(order[0]) * 12 + F.col(order[1])
    return step.cast("long")


def _before(value: str, step, w):
    """Value of the step before, missing where that step has no row."""
    return F.when(F.lag(step).over(w) == step - 1, F.lag(value).over(w))


def rolling_mean(df: DataFrame, keys, window: int = 30, order="year", value: str = "value",
                 out: str | None = None, first: int | None = None) -> DataFrame:
    """Trailing mean of ``window`` steps, missing when one of them is; the window-1 steps from
    ``first`` (the series' own first step by default) take the first full result."""
    series = W.partitionBy(*keys)
    trail = series.orderBy("__step").rangeBetween(-(window - 1), 0)
    d = df.withColumn("__step", _step(order))
    full = (F.min("__step").over(series) if first is None else F.lit(first)) + (window - 1)
    d = d.withColumns({"__full": full, "__r": F.when(F.count(value).over(trail) == window, F.avg(value).over(trail))})
    head = F.max(F.when(F.col("__step") == F.col("__full"), F.col("__r"))).over(series)
    res = F.when(F.col("__step") < F.col("__full"), head).otherwise(F.col("__r"))
    return d.withColumn(out or value, res).drop("__step", "__full", "__r")


def first_years_mean(df: DataFrame, keys, n: int = 19, order="year", value: str = "value",
                     first: int | None = None) -> DataFrame:
    """Mean of the present values of n steps from ``first`` (the series' own first step by
    default) on every step."""
    series = W.partitionBy(*keys)
    d = df.withColumn("__step", _step(order))
    d = d.withColumn("__first", F.min("__step").over(series) if first is None else F.lit(first))
    early = F.when(F.col("__step") < F.col("__first") + n, F.col(value))
    return d.withColumn(value, F.avg(early).over(series)).drop("__step", "__first")


def step_difference(df: DataFrame, keys, order="year", value: str = "value",
                    first_is_zero: bool = False) -> DataFrame:
    """Difference to the step before, missing where that has no row. The first step keeps its
    own value, as if 0 came before it; ``first_is_zero=True`` sets it to 0 instead."""
    step = _step(order)
    w = W.partitionBy(*keys).orderBy(step)
    first = F.row_number().over(w) == 1
    head = F.lit(0.0) if first_is_zero else F.col(value)
    return df.withColumn("delta", F.when(first, head).otherwise(F.col(value) - _before(value, step, w)))


def lag_state(df: DataFrame, keys, order, value: str = "value", out: str = "prev") -> DataFrame:
    """State of the step before, 0 on the first step and missing where the step before has no
    row. With (year, month) January takes last December; with year it is the last year's state."""
    step = _step(order)
    w = W.partitionBy(*keys).orderBy(step)
    return df.withColumn(out, F.when(F.row_number().over(w) == 1, 0.0).otherwise(_before(value, step, w)))


def running_total(df: DataFrame, keys, columns, order: str = "year") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({f"{c}_cum": F.sum(c).over(w) for c in columns})


def monthly_stock_from_december(flux: DataFrame, stock: DataFrame, keys, value: str = "value",
                                stock_value: str = "stock") -> DataFrame:
    """Monthly stock that meets the annual stock in December and steps back by the flux
    of each month times its seconds; a missing or absent flux makes the months up to it missing."""
    amount = F.when(F.col("month") < 12, F.col(value) * nl.seconds_in_month("month"))
    return _stock(flux, stock, keys, amount, stock_value, sign=-1,
                  frame=(0, W.unboundedFollowing), months=12 - F.col("month"))


def monthly_stock_from_january(flux: DataFrame, stock: DataFrame, keys, value: str = "value",
                               stock_value: str = "stock") -> DataFrame:
    """Monthly stock that starts at the annual stock in January and adds each month's
    flux times its seconds to the next; a missing or absent flux makes the later months missing."""
    amount = F.col(value) * nl.seconds_in_month("month")
    return _stock(flux, stock, keys, amount, stock_value, sign=1,
                  frame=(W.unboundedPreceding, -1), months=F.col("month") - 1)


def _stock(flux, stock, keys, amount, stock_value, sign, frame, months):
    """``months``: how many months the frame must hold with a flux."""
    w = W.partitionBy(*keys, "year").orderBy("month").rowsBetween(*frame)
    moved = F.when(F.count("__a").over(w) == months, F.coalesce(F.sum("__a").over(w), F.lit(0.0)))
    d = flux.withColumn("__a", amount).withColumn("__m", moved)
    d = d.join(stock.select(*keys, "year", F.col(stock_value).alias("__s")), [*keys, "year"])
    return d.withColumn("stock_monthly", F.col("__s") + sign * F.col("__m")).drop("__a", "__m", "__s")


def with_position(df: DataFrame, keys, order: str = "year", out: str = "x") -> DataFrame:
    """0-based position of each row in its series."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)


def linear_trend(df: DataFrame, keys, x: str = "t", value: str = "value") -> DataFrame:
    """Least-squares slope and intercept per series on present pairs; missing when x does
    not vary."""
    return df.groupBy(*keys).agg(F.regr_slope(value, x).alias("slope"),
                                 F.regr_intercept(value, x).alias("intercept"))


def annual_trend(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Trend of annual means against 0..n-1 per series."""
    annual = df.groupBy(*keys, "year").agg(F.avg(value).alias(value))
    return linear_trend(with_position(annual, keys, out="__x"), keys, "__x", value)


def mean_trend(df: DataFrame, keys, cell=("lat_idx", "lon_idx"), value: str = "value") -> DataFrame:
    """Space mean of the per-cell annual trends."""
    t = annual_trend(df, [*keys, *cell], value)
    return t.groupBy(*keys).agg(F.avg("slope").alias("slope"), F.avg("intercept").alias("intercept"))


def _yearly_slope(x: str, value: str, gaps: str):
    """Slope over present pairs, or, with gaps='all_steps', with the spread of x taken over
    all steps, missing values included."""
    if gaps == "pairs":
        return F.regr_slope(value, x)
    if gaps != "all_steps":
        raise ValueError(f"unknown treatment of gaps {gaps!r}")
    spread = F.var_pop(x) * F.count(x)
    return F.when(spread > 0, F.regr_count(value, x) * F.covar_pop(value, x) / spread)


def deseasonalised_trend(df: DataFrame, keys, t: str = "t", value: str = "value", gaps: str = "pairs") -> DataFrame:
    """Slope per year on fractional years after taking out the monthly climatology."""
    together = df.repartition(*keys)  # serves the monthly window and the fit
    a = anomaly(together, keys, value).withColumn("__x", nl.fractional_year(t))
    return a.groupBy(*keys).agg(_yearly_slope("__x", "anomaly", gaps).alias("slope_per_year"))


def annual_mean_trend(df: DataFrame, keys, value: str = "value", gaps: str = "pairs") -> DataFrame:
    """Slope per year of the annual means against the year itself."""
    annual = df.groupBy(*keys, "year").agg(F.avg(value).alias(value))
    annual = annual.withColumn("year", F.col("year").cast("double"))
    return annual.groupBy(*keys).agg(_yearly_slope("year", value, gaps).alias("slope_per_year"))


def detrend(df: DataFrame, keys, x: str = "t", value: str = "value", out: str = "detrended") -> DataFrame:
    """value - (slope*x + intercept), the line fitted per series in the same window."""
    w = W.partitionBy(*keys)
    line = F.regr_slope(value, x).over(w) * F.col(x) + F.regr_intercept(value, x).over(w)
    return df.withColumn(out, F.col(value) - line)


def seasonal_component(df: DataFrame, keys, value: str = "detrended", out: str = "seasonal",
                       whole_years: bool = True) -> DataFrame:
    """Mean of each month of the detrended series on every step; whole years required."""
    d = df.withColumn(out, F.avg(value).over(W.partitionBy(*keys, "month")))
    if whole_years:
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        bad = F.raise_error(F.lit("series length is not a multiple of 12")).cast("double")
        d = d.withColumn(out, F.when(F.pmod(n, F.lit(12)) == 0, F.col(out)).otherwise(bad))
    return d


def anomaly(df: DataFrame, keys, value: str = "value", out: str = "anomaly") -> DataFrame:
    """Value minus its month's climatology."""
    return df.withColumn(out, F.col(value) - F.avg(value).over(W.partitionBy(*keys, "month")))


def interannual_variability(df: DataFrame, keys, x: str = "t", value: str = "value",
                            whole_years: bool = True) -> DataFrame:
    """Detrended value minus its seasonal component."""
    d = seasonal_component(detrend(df, keys, x, value), keys, whole_years=whole_years)
    return d.withColumn("iav", F.col("detrended") - F.col("seasonal"))


def annual_anomalies(df: DataFrame, keys, x: str = "year", value: str = "value") -> DataFrame:
    """Detrended annual series; below two present points the mean is taken off instead."""
    w = W.partitionBy(*keys)
    d = detrend(df, keys, x, value, out="__d")
    short = F.count(value).over(w) < 2
    return d.withColumn("anomaly", F.when(short, F.col(value) - F.avg(value).over(w))
                        .otherwise(F.col("__d"))).drop("__d")


def cellwise_variability(df: DataFrame, keys, cell=("lat_idx", "lon_idx"), value: str = "value") -> DataFrame:
    """Detrended annual anomalies per cell, then their space mean per year."""
    per_cell = [*keys, *cell]
    annual = df.groupBy(*per_cell, "year").agg(F.avg(value).alias(value))
    d = detrend(with_position(annual, per_cell, out="__x"), per_cell, "__x", value, out="__r")
    return d.groupBy(*keys, "year").agg(F.avg("__r").alias("iav"))


def trend_line(axis: DataFrame, trend: DataFrame, keys, x: str = "x") -> DataFrame:
    """Line of each series on every step of its axis."""
    d = axis.join(trend.select(*keys, "slope", "intercept"), list(keys))
    return d.withColumn("line", F.col("slope") * F.col(x) + F.col("intercept")).drop("slope", "intercept")


def rebuild_series(trend: DataFrame, variability: DataFrame, keys, x: str = "x") -> DataFrame:
    """Annual series = trend line + interannual variability."""
    d = trend_line(variability, trend, keys, x)
    return d.withColumn("rebuilt", F.col("line") + F.col("iav"))


def positions_to_years(df: DataFrame, keys, first_year: int, y0: int, y1: int, order: str = "t") -> DataFrame:
    """Relabel positions 0..n-1 as years from ``first_year`` and crop to y0..y1."""
    pos = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return (df.withColumn("year", (pos + first_year).cast("int"))
            .filter(F.col("year").between(y0, y1)))
