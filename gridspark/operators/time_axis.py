"""Calendar axes, resampling and time-axis repair (365-day calendar)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridspark.functions import noleap as nl
from gridspark.functions.sizing import broadcast_bounded, one_row


def axis_for_years(years: DataFrame, res: str = "day", anchor: str = "start") -> DataFrame:
    """Calendar rows for every ``year`` in the input.

    ``res`` is day, month or year; ``anchor`` puts a month or a year at its first or
    last day.
    """
    y = years.select(F.col("year").cast("int").alias("year"))
    if res == "day":
        d = y.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(365))))
        d = d.withColumn("month", nl.month_of_doy("doy"))
    elif res == "month":
        d = y.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
        first = nl.month_start("month") + 1
        last = nl.month_start("month") + nl.days_in_month("month")
        d = d.withColumn("doy", first if anchor == "start" else last)
    elif res == "year":
        d = y.withColumn("doy", F.lit(1 if anchor == "start" else 365))
        d = d.withColumn("month", F.lit(1 if anchor == "start" else 12))
    else:
        raise ValueError(f"unknown resolution {res!r}")
    return d.select(
        nl.year_file_day("year", F.col("doy") - 1).alias("t"), "year",
        F.col("month").cast("int").alias("month"), F.col("doy").cast("int").alias("doy"),
        nl.days_in_month("month").alias("days_in_month"),
        nl.seconds_in_month("month").alias("seconds_in_month"))


def noleap_calendar(spark: SparkSession, y0: int, y1: int, res: str = "day",
                    anchor: str = "start") -> DataFrame:
    """Calendar from year ``y0`` to ``y1`` inclusive."""
    years = spark.range(y0, y1 + 1).withColumnRenamed("id", "year")
    return axis_for_years(years, res, anchor)


def to_day_numbers(df: DataFrame, ts_col: str, leap_day: str = "feb28") -> DataFrame:
    """Add t, year and month of the 365-day calendar; 28 and 29 February share a day."""
    t = nl.date_to_day(ts_col, leap_day)
    return df.withColumns({"t": t, "year": F.year(ts_col), "month": F.month(ts_col)})


def replace_axis(df: DataFrame, keys, axis: DataFrame, order: str = "t", axis_len: int | None = None,
                 axis_bound: int = 44_895) -> DataFrame:
    """Put the rows of each series, by position, on the time steps of ``axis``.

    ``axis`` has the columns pos (from 1) and t, at most ``axis_bound`` rows. A series
    whose length differs from ``axis_len``, by default that of the axis, fails the job.
    """
    series = W.partitionBy(*keys)
    d = (df.withColumn("pos", F.row_number().over(series.orderBy(order)))
         .withColumn("__n", F.count(F.lit(1)).over(series)))
    n = F.lit(axis_len) if axis_len is not None else one_row(axis.agg(F.count(F.lit(1)).alias("n")))["n"]
    wrong = F.raise_error(F.format_string("series has %d steps, the axis %d", F.col("__n"), n))
    d = d.withColumn("pos", F.when(F.col("__n") == n, F.col("pos")).otherwise(wrong.cast("int")))
    d = d.drop("__n", "t")
    return d.join(broadcast_bounded(axis.select("pos", "t"), axis_bound), "pos").drop("pos")


def trim(df: DataFrame, keys, start: int, end: int | None, order: str = "t") -> DataFrame:
    """Half-open slice of positions per series; negative bounds count from the end."""
    series = W.partitionBy(*keys)
    n, p = F.col("__n"), F.col("__p")
    lo = n + start if start < 0 else F.lit(start)
    hi = n if end is None else (n + end if end < 0 else F.lit(end))
    return (df.withColumn("__p", F.row_number().over(series.orderBy(order)) - 1)
            .withColumn("__n", F.count(F.lit(1)).over(series))
            .filter((p >= lo) & (p < hi)).drop("__p", "__n"))


def infer_cadence(df: DataFrame, keys, t: str = "t") -> DataFrame:
    """annual, daily or monthly from the whole part of the median step; monthly below
    three points."""
    step = F.col(t) - F.lag(t).over(W.partitionBy(*keys).orderBy(t))
    d = df.withColumn("__step", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), F.median("__step").cast("int").alias("median_step"))
    m = F.col("median_step")
    cadence = (F.when(F.col("n_steps") < 3, "monthly").when(m.between(360, 370), "annual")
               .when(m == 1, "daily").otherwise("monthly"))
    return d.withColumn("cadence", cadence)


def day_to_month(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Mean over the days of each month."""
    return df.groupBy(*keys, "year", "month").agg(F.avg(value).alias(value))


def to_annual(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Plain mean of a year's entries, whatever their resolution."""
    return df.groupBy(*keys, "year").agg(F.avg(value).alias(value))


def subdaily_to_daily(df: DataFrame, keys, ts: str, value: str = "value") -> DataFrame:
    return (df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.avg(value).alias(value)))


def annual_to_monthly(df: DataFrame) -> DataFrame:
    """Every annual row twelve times."""
    return df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


def monthly_to_daily(df: DataFrame) -> DataFrame:
    """Hold a monthly value on each day of its month; no join, each row opens up."""
    first = nl.month_start("month") + 1
    last = nl.month_start("month") + nl.days_in_month("month")
    d = df.withColumn("doy", F.explode(F.sequence(first, last)))
    return d.withColumn("t", nl.year_file_day("year", F.col("doy") - 1))


def annual_to_daily(df: DataFrame) -> DataFrame:
    """Hold an annual value on all 365 days."""
    d = df.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(365))))
    return d.withColumn("t", nl.year_file_day("year", F.col("doy") - 1))


def flat_within_year(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Each step takes its year's mean."""
    return df.withColumn(value, F.avg(value).over(W.partitionBy(*keys, "year")))


def stretch_static(df: DataFrame, y0: int, y1: int) -> DataFrame:
    """Repeat a static field on every year."""
    return df.withColumn("year", F.explode(F.sequence(F.lit(y0), F.lit(y1))))


def repeat_last(df: DataFrame, keys, n: int, order: str = "t") -> DataFrame:
    """Append ``n`` copies of the last step, going on with the last time step."""
    series = W.partitionBy(*keys).orderBy(F.col(order).desc())
    tail = (df.withColumn("__step", F.col(order) - F.lead(order).over(series))
            .withColumn("__rn", F.row_number().over(series)).filter("__rn = 1")
            .withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(n))))
            .withColumn(order, F.col(order) + F.col("__i") * F.coalesce("__step", F.lit(1))))
    return df.unionByName(tail.select(*df.columns))


def cycle_first(df: DataFrame, n_years: int, y0: int, y1: int) -> DataFrame:
    """Cycle the first ``n_years`` from ``y0`` over ``y0..y1``; each source row is copied
    to the years it serves, so no join is needed."""
    src = df.filter(F.col("year").between(y0, y0 + n_years - 1) & (F.col("year") <= y1))
    return src.withColumn("year", F.explode(F.sequence(
        F.col("year").cast("int"), F.lit(y1), F.lit(n_years))))


def irregular_to_annual(df: DataFrame, keys, index_map: DataFrame, order: str = "t",
                        map_rows: int = 123) -> DataFrame:
    """Annual series from an irregular one: ``index_map(year, src_idx)`` names the
    0-based source position of every year."""
    pos = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    d = df.withColumn("src_idx", pos).drop("year", order)
    return d.join(broadcast_bounded(index_map, map_rows), "src_idx").drop("src_idx")


def population_index(year: Column) -> Column:
    """Source position of a year: one value for 1901-1908, decades to 1948, then years."""
    return (F.when(year <= 1908, 0)
            .when(year <= 1948, 1 + F.floor((year - 1909) / 10))
            .otherwise(year - 1949 + 5)).cast("int")


def average_duplicate_months(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """One row per year*100+month, duplicates averaged."""
    return (df.groupBy(*keys, nl.year_month_key("year", "month").alias("ym"))
            .agg(F.avg(value).alias(value)))


def date_window(df: DataFrame, start: str, end: str, t: str = "t") -> DataFrame:
    """Inclusive window given by two date strings."""
    return df.filter(F.col(t).between(nl.day_literal(start), nl.day_literal(end)))


def test_windows(df: DataFrame, windows, year: str = "year") -> DataFrame:
    """Union of inclusive year windows as one predicate over one scan."""
    keep = F.lit(False)
    for y0, y1 in windows:
        keep = keep | F.col(year).between(y0, y1)
    return df.filter(keep)
