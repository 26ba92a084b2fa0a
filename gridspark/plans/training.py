"""Fields to split training samples."""

from pyspark.sql import DataFrame, functions as F

from gridspark.functions.geo import GridSpec, HALF_DEGREE
from gridspark.functions.sizing import broadcast_bounded, per_cell, stored
from gridspark.operators import aggregates as ag, masks as mk, samples as sm
from gridspark.schema import CELL
from gridspark.sources.catalog import route_sources


def location_table(cells: DataFrame, block: int = 70, seed: int = 42, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Land cells with split code, seeded location number and block; whole blocks only."""
    coded = mk.split_longitude_bands(per_cell(cells, grid), grid=grid)
    loc = mk.split_locations(coded, block=block, seed=seed)
    return sm.location_blocks(loc, block=block, keys=["tvt"])


def training_field(df: DataFrame, locations: DataFrame, grid: GridSpec = HALF_DEGREE, periods=None) -> DataFrame:
    """Field rows of the chosen locations with their split and period. The location table
    has one row per cell, so it is broadcast."""
    loc = broadcast_bounded(per_cell(locations, grid).select(*CELL, "tvt", "loc_id", "block_id"), grid.n_cells)
    return mk.assign_splits(df.join(loc, CELL), periods=periods)


def training_inputs(fields: DataFrame, locations: DataFrame, optional=(), grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Rows of the chosen locations, each (scenario, variable) from the origin its rule names.

    ``fields`` has a column ``origin`` ('historical' or 'preindustrial'). Routing comes before the locations are
    gathered. A location, scenario and year whose value is missing then fails the job, but for the
    variables in ``optional``.
    """
    loc = broadcast_bounded(per_cell(locations, grid).select(*CELL, "loc_id"), grid.n_cells)
    routed = route_sources(fields.withColumnRenamed("origin", "__origin")).filter(F.col("__origin") == F.col("origin")).drop("__origin")
    d = routed.join(loc, CELL)
    name = F.concat_ws(" ", F.lit("missing value of"), "variable", "scenario", F.col("year").cast("string"))
    gap = F.col("value").isNull() & ~F.col("variable").isin(*optional)
    return d.withColumn("value", F.when(gap, F.raise_error(name).cast("double")).otherwise(F.col("value")))


def training_statistics(df: DataFrame, splits=("train", "val")) -> DataFrame:
    """Stored statistics per variable over the given splits, in one pass."""
    d = df.filter(F.col("split").isin(*splits))
    return stored(ag.finish_moments(ag.moments(d)), "statistics")
