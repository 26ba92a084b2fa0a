"""Broadcast only sides whose size is proven or measured."""

from pyspark.sql import DataFrame, functions as F

from gridspark.session import scratch_path

# A row of a dimension table here is a few numbers: 500k rows stay below about 40 MB.
MAX_BROADCAST_ROWS = 500_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when ``max_rows``, a bound that holds by construction, is small."""
    return F.broadcast(df) if max_rows <= MAX_BROADCAST_ROWS else df


def broadcast_counted(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting; a larger side is left to a shuffled join.

    Meant for stored dimension tables (statistics, rules): the count reads them once.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a summary table to the shared scratch folder and read it back.

    The summary is computed once however often it is joined, its lineage ends there, and
    its size can be measured before it is broadcast. Shuffle files of the write go with its end:
    nothing else reads them, and the driver's garbage may not be collected for long.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_row(df: DataFrame):
    """The single row of a summary as a struct column (a scalar subquery), so that meeting
    it needs no join."""
    return df.select(F.struct(*df.columns)).scalar()


def per_cell(df: DataFrame, grid) -> DataFrame:
    """One row per cell of ``grid``, so the result has at most ``grid.n_cells`` rows. A row outside
    the grid, or rows of one cell that differ, fail the job."""
    inside = F.col("lat_idx").between(0, grid.nlat - 1) & F.col("lon_idx").between(0, grid.nlon - 1)
    outside = F.raise_error(F.lit("a cell lies outside the grid")).cast(df.schema["lat_idx"].dataType)
    d = df.withColumn("lat_idx", F.when(inside, F.col("lat_idx")).otherwise(outside))
    rest = [c for c in df.columns if c not in ("lat_idx", "lon_idx")]
    if not rest:
        return d.distinct()
    row = F.struct(*rest)
    d = d.groupBy("lat_idx", "lon_idx").agg(F.min(row).alias("__a"), F.max(row).alias("__b"))
    differ = F.raise_error(F.lit("rows of one cell differ")).cast(d.schema["__a"].dataType)
    d = d.withColumn("__a", F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(differ))
    return d.select("lat_idx", "lon_idx", "__a.*").select(*df.columns)
