"""Data-quality reports as aggregates."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridspark.functions.nulls import finite
from gridspark.schema import CELL

# Allowed axis lengths, time units and calendars.
AXIS_LENGTHS = (123, 1476, 44895)
UNITS_PATTERN = r"(?i)^\s*days\s+since\s+1901-01-01(?:[ T]00(?::00(?::00)?)?)?\s*$"
CALENDARS = ("noleap", "365_day")


def missing_report(df: DataFrame, keys=(), cell=CELL, t: str = "t", land: str | None = "land",
                   value: str = "value", n_cells: int | None = None, n_steps: int | None = None) -> DataFrame:
    """Missing share over land cells x steps, steps without any value and cells without any
    value. A cell and step without a row is missing; ``n_cells`` and ``n_steps`` are the sizes of
    the grid and axis where some cell or step has no row at all."""
    d = df.filter(F.col(land) == 1) if land else df
    d = d.select(*keys, *cell, t, F.col(value).isNotNull().cast("int").alias("__ok"))
    # One read gives the sums per step and per cell.
    sums = d.groupingSets([[*keys, t], [*keys, *cell]], *keys, t, *cell).agg(F.sum("__ok").alias("ok"), F.grouping(t).alias("__cells"))
    steps, cells = F.col("__cells") == 0, F.col("__cells") == 1

    def size(of, n):
        return F.count(F.when(of, 1)) if n is None else F.lit(n).cast("long")

    aggs = [F.sum(F.when(steps, F.col("ok"))).alias("__ok")]
    for name, of, n in (("steps", steps, n_steps), ("cells", cells, n_cells)):
        aggs += [size(of, n).alias(f"n_{name}"), (size(of, n) - F.count(F.when(of & (F.col("ok") > 0), 1))).alias(f"empty_{name}")]
    out = sums.groupBy(*keys).agg(*aggs) if keys else sums.agg(*aggs)
    out = out.withColumn("n", F.col("n_cells") * F.col("n_steps"))
    out = out.withColumn("n_missing", F.col("n") - F.coalesce("__ok", F.lit(0))).drop("__ok")
    return out.withColumn("missing_share", F.try_divide("n_missing", "n"))


def partial_cells(df: DataFrame, n_steps, keys=(), cell=CELL, value: str = "value") -> DataFrame:
    """Cells with some but not all of ``n_steps`` (a number or column) missing, and their mean
    missing share; a step without a row is missing."""
    n = n_steps if isinstance(n_steps, Column) else F.lit(n_steps)
    d = df.groupBy(*keys, *cell).agg(F.count(value).alias("__ok")).withColumn("__s", 1 - F.col("__ok") / n)
    d = d.filter((F.col("__s") > 0) & (F.col("__s") < 1))
    aggs = [F.count(F.lit(1)).alias("partial_cells"), F.avg("__s").alias("mean_missing_share")]
    return d.groupBy(*keys).agg(*aggs) if keys else d.agg(*aggs)


def missing_by_variable(df: DataFrame, store=(), value: str = "value") -> DataFrame:
    """Missing values per store and variable, and the total of the store."""
    d = df.groupBy(*store, "variable").agg(F.count_if(F.col(value).isNull()).alias("n_missing"))
    w = W.partitionBy(*store) if store else W.partitionBy(F.lit(0))
    return d.withColumn("store_missing", F.sum("n_missing").over(w))


def bad_locations(df: DataFrame, location, array: str = "variable", value: str = "value") -> DataFrame:
    """Locations with a missing or non-finite value, the arrays they occur in, and how
    many rows are bad."""
    bad = df.filter(~finite(value))
    per = bad.groupBy(*location, array).agg(F.count(F.lit(1)).alias("__n"))
    return per.groupBy(*location).agg(
        F.array_join(F.array_sort(F.collect_list(array)), ",").alias("arrays"),
        F.count(F.lit(1)).alias("n_arrays"), F.sum("__n").alias("n_bad"))


def empty_or_zero_locations(df: DataFrame, location, value: str = "value") -> DataFrame:
    """Locations whose values are all missing, or all zero among the present ones."""
    d = df.groupBy(*location).agg(F.count(value).alias("__n"), F.max(F.abs(value)).alias("__m"))
    d = d.withColumns({"all_missing": F.col("__n") == 0, "all_zero": F.coalesce(F.col("__m") == 0, F.lit(False))})
    return d.filter("all_missing OR all_zero").drop("__n", "__m")


def conformance(df: DataFrame, source, nlat: int = 360, nlon: int = 720) -> DataFrame:
    """Issues per input: axis length, time units, calendar, grid size, centre positions.

    ``df`` has t, lat, lon, units and calendar per row. Distinct steps and coordinates
    are counted by a two-level aggregate, so no set is held per input.
    """
    source = list(source)

    def n_distinct(col, out):
        return df.select(*source, col).distinct().groupBy(*source).agg(F.count(col).alias(out))

    def off_centre(c, a, b):
        f = F.pmod(F.col(c), F.lit(1.0))
        return F.count_if((F.abs(f - a) > 1e-9) & (F.abs(f - b) > 1e-9))

    checks = df.groupBy(*source).agg(
        F.count_if(~F.coalesce(F.col("units").rlike(UNITS_PATTERN), F.lit(False))).alias("__u"),
        F.count_if(~F.coalesce(F.lower("calendar").isin(*CALENDARS), F.lit(False))).alias("__c"),
        off_centre("lon", 0.0, 0.5).alias("__lo"), off_centre("lat", 0.25, 0.75).alias("__la"))
    d = (checks.join(n_distinct("t", "n_t"), source).join(n_distinct("lat", "n_lat"), source)
         .join(n_distinct("lon", "n_lon"), source))
    issues = F.array(
        F.when(~F.col("n_t").isin(*AXIS_LENGTHS), "time length"),
        F.when(F.col("__u") > 0, "time units"), F.when(F.col("__c") > 0, "calendar"),
        F.when(F.col("n_lat") != nlat, "lat size"), F.when(F.col("n_lon") != nlon, "lon size"),
        F.when(F.col("__la") > 0, "lat centres"), F.when(F.col("__lo") > 0, "lon centres"))
    return d.select(*source, "n_t", "n_lat", "n_lon", F.array_compact(issues).alias("issues"))


def catalog_gaps(catalog: DataFrame, wanted: DataFrame, keys=("model", "scenario", "variable")) -> DataFrame:
    """Wanted keys that do not occur exactly once in the catalog."""
    n = catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    d = wanted.join(n, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.filter(F.col("n") != 1)


def axis_checks(df: DataFrame, keys, t: str = "t", step: int = 1) -> DataFrame:
    """Per series: length, whether strictly increasing in stored order ``pos``, and
    whether consecutive steps are ``step`` apart."""
    w = W.partitionBy(*keys).orderBy("pos")
    d = df.withColumn("__d", F.col(t) - F.lag(t).over(w))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.coalesce(F.min("__d") > 0, F.lit(True)).alias("increasing"),
        F.coalesce((F.min("__d") == step) & (F.max("__d") == step), F.lit(True)).alias("consecutive"))


def slice_differences(a: DataFrame, b: DataFrame, on, value: str = "value") -> DataFrame:
    """Keys at which two slices differ, a missing row counting as a difference."""
    x = a.select(*on, F.col(value).alias("left_value"), F.lit(1).alias("__a"))
    y = b.select(*on, F.col(value).alias("right_value"), F.lit(1).alias("__b"))
    d = x.join(y, list(on), "full_outer")
    same = (F.col("__a").eqNullSafe(F.col("__b")) & F.col("left_value").eqNullSafe(F.col("right_value")))
    return d.filter(~same).drop("__a", "__b")


def first_missing(df: DataFrame, keys, t: str = "t", cell=CELL, value: str = "value") -> DataFrame:
    """First (time, cell) of a missing value per key."""
    where = F.struct(t, *cell)
    d = df.filter(F.col(value).isNull())
    d = d.groupBy(*keys).agg(F.min(where).alias("__w")) if keys else d.agg(F.min(where).alias("__w"))
    return d.select(*keys, "__w.*")


def nonzero_check(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Mean, non-zero count and verdict per key; a field of zeros is suspicious."""
    d = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count_if(F.col(value) != 0).alias("n_nonzero"))
    return d.withColumn("ok", F.col("n_nonzero") > 0)
