"""Land-model output to ensemble mean."""

from pyspark.sql import DataFrame, functions as F

from gridspark.functions.geo import GridSpec, HALF_DEGREE
from gridspark.operators import aggregates as ag, cleaning as cl, space as sp, time_axis as ta
from gridspark.operators.quality import catalog_gaps
from gridspark.schema import CELL


def clean_model_output(df: DataFrame, src: GridSpec | None = None, dst: GridSpec = HALF_DEGREE,
                       start: int = 0, end: int | None = None) -> DataFrame:
    """Sentinels to missing, trimmed axis, bilinear regrid where the grid differs, negatives
    of the listed variables to 0. Shuffles once per series and once in the regrid."""
    series = ["variable", "source", "scenario"]
    d = cl.sentinels_to_null(df)
    if start or end is not None:
        d = ta.trim(d, [*series, *CELL], start, end)
    if src is not None and src != dst:
        d = sp.regrid_bilinear(d, [*series, "t", "year", "month"], src, dst)
    return cl.clip_negative(d)


def ensemble_mean_field(df: DataFrame, n_sources: int) -> DataFrame:
    """Strict mean over ``n_sources`` sources per variable, scenario, cell and step."""
    keys = ["variable", "scenario", *CELL, "t", "year", "month"]
    return ag.ensemble_mean(df, keys, n_sources).withColumn("source", F.lit("ENSMEAN"))


def missing_inputs(catalog: DataFrame, models, scenarios, variables) -> DataFrame:
    """Wanted (model, scenario, variable) that the catalog does not hold exactly once."""
    spark = catalog.sparkSession
    rows = [(m, s, v) for m in models for s in scenarios for v in variables]
    wanted = spark.createDataFrame(rows, "model string, scenario string, variable string")
    return catalog_gaps(catalog, wanted)
