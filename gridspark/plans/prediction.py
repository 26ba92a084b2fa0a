"""Forcing to predictions and budgets: one flow from offsets to bands."""

from typing import Callable, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridspark.functions.geo import GridSpec, HALF_DEGREE
from gridspark.functions.sizing import stored
from gridspark.operators import rollout as ro
from gridspark.operators.resume import rollout_resumable
from gridspark.operators.samples import stats_vectors
from gridspark.plans import budgets
from gridspark.schema import CELL, NITROGEN_FERTILISER


class Emulator(NamedTuple):
    """A predictor and its channels. ``predict`` gets standardised inputs as an array, one row a step and
    one column a channel in the order of :attr:`inputs`, and returns standardised outputs in the order of ``outputs``."""
    predict: Callable[[np.ndarray], np.ndarray]
    outputs: tuple[str, ...]
    daily: tuple[str, ...] = ()
    monthly: tuple[str, ...] = ()
    monthly_states: tuple[str, ...] = ()
    annual: tuple[str, ...] = ()
    annual_states: tuple[str, ...] = ()

    @property
    def inputs(self) -> tuple[str, ...]:
        return self.daily + self.monthly + self.monthly_states + self.annual + self.annual_states

    @property
    def states(self) -> dict[str, str]:
        return {**dict.fromkeys(self.monthly_states, "monthly"), **dict.fromkeys(self.annual_states, "annual")}

    @property
    def forcing(self) -> tuple[str, ...]:
        return tuple(c for c in self.inputs if c not in self.states)


def _wide(df: DataFrame, scope: str, names, by) -> DataFrame:
    rows = df.filter((F.col("scope") == scope) & F.col("variable").isin(*names))
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("variable") == n, F.col("value"))).alias(n) for n in names])


def forcing_table(fields: DataFrame, model: Emulator, keys=("source",), offsets: DataFrame | None = None,
                  zero_fill=NITROGEN_FERTILISER, day: str = "day") -> DataFrame:
    """One row for each finest step with a column for every forcing channel and, as ``start_<name>``, every state.

    ``fields`` is long: scope ('daily', 'monthly' or 'annual'), variable, the keys, cell, year, and month and ``day`` as
    far as the scope has them. Monthly values hold over their days and annual ones over their year.
    ``offsets`` are parsed rules that move the forcing, not the states. A step without a value in a channel
    keeps its row with a missing value, but for the channels of ``zero_fill``, where 0 takes its place.
    """
    keys = [*keys, *CELL]
    moved = ro.apply_offsets(fields, offsets) if offsets is not None else fields
    fine = [*keys, "year", "month", day] if model.daily else [*keys, "year", "month"]
    base = _wide(moved, "daily", model.daily, fine) if model.daily else _wide(moved, "monthly", model.monthly, fine)
    for scope, names, by in (("monthly", model.monthly if model.daily else (), [*keys, "year", "month"]), ("annual", model.annual, [*keys, "year"])):
        if names:
            base = base.join(_wide(moved, scope, names, by), by, "left")
    for scope, names, by in (("monthly", model.monthly_states, [*keys, "year", "month"]), ("annual", model.annual_states, [*keys, "year"])):
        if names:
            start = _wide(fields, scope, names, by).withColumnsRenamed({n: f"start_{n}" for n in names})
            base = base.join(start, by, "left")
    return base.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in model.forcing if c in zero_fill})


def forcing_of_rows(rows: DataFrame, model: Emulator, columns: dict[str, Column], keys=("source",), offsets: DataFrame | None = None,
                    zero_fill=NITROGEN_FERTILISER, day: str = "day") -> DataFrame:
    """:func:`forcing_table` of rows that are not yet means.

    ``rows`` have the keys, cell, year, month and, where there is daily forcing, ``day``; a channel is the mean of its
    expression in ``columns`` over the rows of its day, month or year. Rows are shuffled once, by series: finest steps are summed there, and months and years are windows over them.
    """
    series = [*CELL, *keys]  # the cell first: rows of many cells are sorted, of few keys
    month, year = [*series, "year", "month"], [*series, "year"]
    fine = [*month, day] if model.daily else month
    by = {**dict.fromkeys(model.daily, fine), **dict.fromkeys(model.monthly + model.monthly_states, month), **dict.fromkeys(model.annual + model.annual_states, year)}
    means = [F.avg(columns[n]).alias(n) for n, over in by.items() if over == fine]
    parts = [p for n, over in by.items() if over != fine for p in (F.sum(columns[n]).alias(f"__sum_{n}"), F.count(columns[n]).alias(f"__n_{n}"))]
    table = rows.repartition(*series).groupBy(*fine).agg(*means, *parts)
    for over in (month, year):  # the order of months within series is one of years too
        w = W.partitionBy(*over)
        mean = {n: F.when(F.sum(f"__n_{n}").over(w) > 0, F.sum(f"__sum_{n}").over(w) / F.sum(f"__n_{n}").over(w)) for n, o in by.items() if o == over != fine}
        table = table.withColumns(mean) if mean else table
    if offsets is not None:
        scopes = {**dict.fromkeys(model.daily, "daily"), **dict.fromkeys(model.monthly, "monthly"), **dict.fromkeys(model.annual, "annual")}
        table = ro.offset_columns(table, offsets, scopes)
    filled = {n: F.coalesce(n, F.lit(0.0)).alias(n) if n in zero_fill else F.col(n) for n in model.forcing}
    return table.select(*keys, *CELL, *fine[len(series):], *filled.values(), *[F.col(n).alias(f"start_{n}") for n in model.states])


class _Standardised:
    """The predictor on physical units."""

    def __init__(self, model: Emulator, vectors):
        self.names, self.outputs, self.predict = list(model.inputs), list(model.outputs), model.predict
        (self.mean_in, self.std_in), (self.mean_out, self.std_out) = vectors

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        z = (frame[self.names].to_numpy(dtype=float) - self.mean_in) / self.std_in
        return pd.DataFrame(np.asarray(self.predict(z)) * self.std_out + self.mean_out, columns=self.outputs)


def _vectors(stats: DataFrame, names):
    row = stats_vectors(stats, list(names)).first()  # as many numbers as channels
    return np.array(row["mean"]), np.array(row["std"])


def prediction_run(fields: DataFrame, stats: DataFrame, model: Emulator, keys=("source",), offsets: DataFrame | None = None,
                   carry: str = "annual", nudge: tuple[float, str] | None = None, seed: tuple[int, tuple[str, ...]] | None = None,
                   grid: GridSpec = HALF_DEGREE, path: str | None = None, day: str = "day", split: int = 1, block_years: int = 10,
                   columns: dict[str, Column] | None = None) -> DataFrame:
    """Predictions at the finest step: keys, cell, year, month, ``day`` where there is daily forcing, and the outputs.

    The first year of a cell starts from its own states (``seed`` = (year, names) takes those of another
    year for the names), later ones from what the year before handed on by the rule ``carry``. A cell-year with a
    gap in its forcing is not predicted. ``nudge`` = (strength, mode) pulls state outputs towards the
    mean of their statistics. With ``path`` the run is kept there and goes on where it broke. ``fields`` are
    those of :func:`forcing_table` or, with ``columns``, the rows of :func:`forcing_of_rows`.
    """
    table = forcing_of_rows(fields, model, columns, keys, offsets, day=day) if columns else forcing_table(fields, model, keys, offsets, day=day)
    if seed:
        year, names = seed
        of = [*keys, *CELL, "month", *([day] if model.daily else [])]
        other = table.filter(F.col("year") == year).select(*of, *[F.col(f"start_{n}").alias(f"__{n}") for n in names], F.lit(True).alias("__hit"))
        table = table.join(other, of, "left").withColumns({f"start_{n}": F.when(F.col("__hit"), F.col(f"__{n}")).otherwise(F.col(f"start_{n}")) for n in names})
        table = table.drop("__hit", *[f"__{n}" for n in names])
    vectors = [_vectors(stats, names) for names in (model.inputs, model.outputs)]
    pull = None
    if nudge:
        mean, std = vectors[1]
        pull = ro.Nudging({n: (float(mean[i]), float(std[i])) for i, n in enumerate(model.outputs) if n in model.states}, *nudge)
    rules = dict(keys=list(keys), predict=_Standardised(model, vectors), states=model.states, outputs=list(model.outputs), carry=carry,
                 steps=("year", "month", day) if model.daily else ("year", "month"), start={n: f"start_{n}" for n in model.states},
                 complete=list(model.forcing), nudging=pull, grid=grid, split=split)
    if path is None:
        return ro.rollout(table, **rules)
    return rollout_resumable(stored(table, "forcing"), path, block_years=block_years, **rules)  # read for what there is to do and by every block


def step_means(predicted: DataFrame, model: Emulator, keys=("source",), by=("year", "month")) -> DataFrame:
    """Long field (variable, keys, cell, ``by``, value): means of the predicted steps, missing ones left out."""
    return _wide_means(predicted, model, keys, by).unpivot([*keys, *CELL, *by], list(model.outputs), "variable", "value")


def _wide_means(predicted: DataFrame, model: Emulator, keys=("source",), by=("year", "month")) -> DataFrame:
    return predicted.groupBy(*keys, *CELL, *by).agg(*[F.avg(o).alias(o) for o in model.outputs])


def predicted_budget(predicted: DataFrame, model: Emulator, mask: DataFrame, codes, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Net ecosystem exchange of the predicted fluxes, masked, as annual totals with their bands across sources."""
    return budgets.budget_from_wide(_wide_means(predicted, model), mask, codes, grid)
