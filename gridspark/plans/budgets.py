"""Predictions or model output to budget reports."""

from pyspark.sql import DataFrame

from gridspark.functions.geo import GridSpec, HALF_DEGREE
from gridspark.operators import aggregates as ag, joins as jn, masks as mk, physics as ph
from gridspark.schema import CELL


def with_net_ecosystem_exchange(df: DataFrame, keys) -> DataFrame:
    """nee rows of every key whose gpp, rh and ra are all there once."""
    return _exchange(jn.member_columns(df, keys, ["gpp", "rh", "ra"], "value"))


def _exchange(wide: DataFrame) -> DataFrame:
    return ph.net_ecosystem_exchange(wide).withColumnRenamed("nee", "value").drop("gpp", "rh", "ra")


def budget_report(df: DataFrame, mask: DataFrame, codes, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Masked annual totals per source and the range and bands across sources per year.

    One shuffle for the totals (partial sums per task), one over a handful of rows.
    """
    masked = mk.apply_mask(df, mask, codes, grid=grid)
    return ag.ensemble_bands(ag.annual_totals(masked, ["source"], grid), ["year"], "total")


def budget_from_fluxes(df: DataFrame, mask: DataFrame, codes, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Budget report of the net ecosystem exchange of long gpp, rh and ra fields."""
    nee = with_net_ecosystem_exchange(df, ["source", *CELL, "year", "month"])
    return budget_report(nee, mask, codes, grid)


def budget_from_wide(df: DataFrame, mask: DataFrame, codes, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """:func:`budget_from_fluxes` of fluxes that are columns of one row for each source, cell, year and month."""
    return budget_report(_exchange(df.select("source", *CELL, "year", "month", "gpp", "rh", "ra")), mask, codes, grid)
