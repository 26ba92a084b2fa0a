"""Reading and writing gridded fields as partitioned Parquet."""

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridspark.functions.geo import GridSpec, HALF_DEGREE
from gridspark.functions.sizing import one_row
from gridspark.schema import ANNUAL_EXPORTS, CELL, EXPORT_ALIASES, TEST_WINDOWS

PARTITIONS = ["variable", "scenario"]


def read_field(spark: SparkSession, root: str, variables=None, scenarios=None, years=None) -> DataFrame:
    """Field rows of the wanted variables and scenarios (directory pruning) and years
    (Parquet row-group pruning)."""
    d = spark.read.parquet(root)
    if variables:
        d = d.filter(F.col("variable").isin(*variables))
    if scenarios:
        d = d.filter(F.col("scenario").isin(*scenarios))
    if years:
        d = d.filter(F.col("year").between(*years))
    return d


def _layout(df: DataFrame, grid: GridSpec, parts) -> DataFrame:
    """Rows grouped by variable, scenario and tile, with oversized groups split and tiny
    ones joined at run time, and ordered so that year and cell statistics prune."""
    d = df.withColumn("tile_id", grid.tile_id("lat_idx", "lon_idx"))
    order = [c for c in ("year", "lat_idx", "lon_idx", "t") if c in d.columns]
    by = [F.col(c) for c in (*parts, "tile_id")]
    return d.hint("rebalance", *by).sortWithinPartitions(*parts, *order)


def write_field(df: DataFrame, path: str, mode: str = "errorifexists", float32: bool = False,
                grid: GridSpec = HALF_DEGREE, parts=PARTITIONS) -> None:
    """Write a field; fails if it exists unless ``mode='overwrite'``."""
    d = df.withColumn("value", F.col("value").cast("float")) if float32 else df
    w = _layout(d, grid, parts).write.partitionBy(*parts).mode(mode)
    w.option("partitionOverwriteMode", "static").parquet(path)


def materialise(df: DataFrame, path: str, overwrite: bool = False, parts=()) -> DataFrame:
    """Store a derived table once and read it back; also cuts its lineage durably."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if overwrite or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (w.partitionBy(*parts) if parts else w).parquet(path)
    return spark.read.parquet(path)


def upsert_variable(df: DataFrame, path: str, grid: GridSpec = HALF_DEGREE, parts=PARTITIONS) -> None:
    """Add or replace the variables in ``df``; other variables stay. A variable is replaced whole: scenarios
    that ``df`` lacks are gone afterwards. Each variable is one write of its own folder."""
    first, *rest = parts
    names = [r[0] for r in df.select(first).distinct().collect()]  # variables of one store
    for name in names:
        if name is None or not re.fullmatch(r"[\w.\-]+", str(name)):
            raise ValueError(f"{name!r} cannot name a folder")
    laid = _layout(df, grid, parts)
    for name in names:
        w = laid.filter(F.col(first) == name).drop(first).write.mode("overwrite").option("partitionOverwriteMode", "static")
        (w.partitionBy(*rest) if rest else w).parquet(f"{path}/{first}={name}")


def with_aliases(df: DataFrame, aliases=EXPORT_ALIASES, order=()) -> DataFrame:
    """Export names; where several sources share a name, the first in ``order`` wins, then the first in
    name order among those it does not list."""
    lookup = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    d = df.withColumn("target", F.coalesce(F.try_element_at(lookup, F.col("variable")), F.col("variable")))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in order]).cast("array<string>"), F.col("variable")), F.lit(0)), F.lit(len(order) + 1))
    first = d.groupBy("target").agg(F.min_by("variable", F.struct(rank, "variable")).alias("variable"))
    keep = first.groupBy().agg(F.collect_list("variable").alias("__keep"))  # one name per target
    d = d.filter(F.array_contains(one_row(keep)["__keep"], F.col("variable")))
    return d.withColumn("variable", F.col("target")).drop("target")


def export_sets(df: DataFrame, windows=TEST_WINDOWS, annual_vars=ANNUAL_EXPORTS, keys=("source", "scenario", *CELL), order=()) -> DataFrame:
    """Full, early and late sets of every export name, tagged ``period``. In a monthly
    field the variables of ``annual_vars`` take their year's mean in every month. ``order`` lists
    which of several sources of one name comes first."""
    d = with_aliases(df, order=order)
    if annual_vars and "month" in d.columns:
        w = W.partitionBy("variable", *[k for k in keys if k in d.columns], "year")
        flat = F.avg("value").over(w)
        d = d.withColumn("value", F.when(F.col("variable").isin(*annual_vars), flat).otherwise(F.col("value")))
    (e0, e1), (l0, l1) = windows
    periods = F.array_compact(F.array(
        F.lit("full"), F.when(F.col("year").between(e0, e1), "early"),
        F.when(F.col("year").between(l0, l1), "late")))
    return d.withColumn("period", F.explode(periods))


def write_export(df: DataFrame, path: str, windows=TEST_WINDOWS, grid: GridSpec = HALF_DEGREE) -> None:
    write_field(export_sets(df, windows), path, "overwrite", grid=grid, parts=["variable", "period"])


def write_report_csv(table: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """Report table (already one row per year, month or latitude) as one CSV file; with more than
    ``max_rows`` rows as several."""
    small = table.limit(max_rows + 1).count() <= max_rows
    (table.coalesce(1) if small else table).write.mode("overwrite").csv(path, header=True)
