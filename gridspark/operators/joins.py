"""Label alignment between fields."""

from pyspark.sql import DataFrame, functions as F

from gridspark.functions.nulls import only_value
from gridspark.functions.sizing import broadcast_bounded, one_row, per_cell


def align_inner(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, list(on), "inner")


def align_exact(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Inner alignment that fails the job when a coordinate is on one side only."""
    x = a.withColumn("__a", F.lit(1))
    y = b.withColumn("__b", F.lit(1))
    d = x.join(y, list(on), "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    bad = F.raise_error(F.lit("coordinates differ")).cast("boolean")
    return d.filter(F.when(both, F.lit(True)).otherwise(bad)).drop("__a", "__b")


def merge_variables(df: DataFrame, keys, names, name: str = "variable", value: str = "value") -> DataFrame:
    """Outer merge of variables into columns: one shuffle, however many variables. Two values of a
    variable at one key fail the job."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(only_value(value))


def reindex(target: DataFrame, src: DataFrame, on) -> DataFrame:
    """Source on the target's axis, missing where the source has no row."""
    return target.join(src, list(on), "left")


def overwrite_shared(prior: DataFrame, src: DataFrame, on, value: str = "value") -> DataFrame:
    """Take the source on shared steps, even when it is missing there; keep the prior
    elsewhere."""
    s = src.select(*on, F.col(value).alias("__v"), F.lit(True).alias("__hit"))
    d = prior.join(s, list(on), "left")
    v = F.when(F.col("__hit"), F.col("__v")).otherwise(F.col(value))
    return d.withColumn(value, v).drop("__v", "__hit")


def common_time_range(df: DataFrame, source: str = "source", t: str = "t", keys=()) -> DataFrame:
    """Latest start and earliest end over sources; it must hold more than one step, or the
    job fails."""
    r = df.groupBy(*keys, source).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    aggs = [F.max("__lo").alias("t_from"), F.min("__hi").alias("t_to")]
    d = r.groupBy(*keys).agg(*aggs) if keys else r.agg(*aggs)
    bad = F.raise_error(F.lit("sources share no time range")).cast("int")
    return d.withColumn("t_to", F.when(F.col("t_from") < F.col("t_to"), F.col("t_to")).otherwise(bad))


def crop_to_common(df: DataFrame, source: str = "source", t: str = "t") -> DataFrame:
    """Rows inside the time range common to all sources."""
    r = one_row(common_time_range(df, source, t))
    return df.filter(F.col(t).between(r["t_from"], r["t_to"]))


def complete_groups(df: DataFrame, keys, members, member: str = "variable") -> DataFrame:
    """Groups that hold each listed member exactly once."""
    ok = F.lit(True)
    for m in members:
        ok = ok & (F.count(F.when(F.col(member) == m, 1)) == 1)
    return df.groupBy(*keys).agg(ok.alias("__ok")).filter("__ok").drop("__ok")


def member_columns(df: DataFrame, keys, members, value: str, member: str = "variable") -> DataFrame:
    """One row per complete group with a column per member."""
    aggs = [F.max(F.when(F.col(member) == m, F.col(value))).alias(m) for m in members]
    ok = F.lit(True)
    for m in members:
        ok = ok & (F.count(F.when(F.col(member) == m, 1)) == 1)
    return df.groupBy(*keys).agg(*aggs, ok.alias("__ok")).filter("__ok").drop("__ok")


def broadcast_climatology(df: DataFrame, clim: DataFrame, cell, value: str = "climatology") -> DataFrame:
    """Month-of-year climatology on every time step."""
    return df.join(clim.select(*cell, "month", value), [*cell, "month"], "left")


def insert_external(df: DataFrame, external: DataFrame, on, column: str) -> DataFrame:
    """External series on the index values both have."""
    return df.join(external.select(*on, column), list(on), "left")


def skip_tiles(df: DataFrame, done: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Rows of tiles not listed."""
    return df.join(done.select(tile).distinct(), tile, "left_anti")


def nearest_mask(df: DataFrame, mask: DataFrame, lat: str, lon: str, grid, code: str = "mask") -> DataFrame:
    """Mask code of the nearest grid cell for rows with free coordinates."""
    m = broadcast_bounded(per_cell(mask.select("lat_idx", "lon_idx", code), grid), grid.n_cells)
    d = df.withColumns({"lat_idx": grid.lat_index(lat), "lon_idx": grid.lon_index(lon)})
    return d.join(m, ["lat_idx", "lon_idx"], "left")
