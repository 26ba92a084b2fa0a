"""Predictions against labels in three ways: from given states, carried over the whole series, or carried over a short run-up."""

from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions.geo import GridSpec, HALF_DEGREE
from gridspark.functions.sizing import stored
from gridspark.operators.rollout import rollout
from gridspark.operators.skill import complete_label_years, metric_table
from gridspark.schema import CELL

MODES = ("teacher_forced", "full_sequence", "tail_only")


def run_up_windows(table: DataFrame, series, horizon: int, year: str = "year") -> DataFrame:
    """Every row once for each window it is in: ``target`` is the position of a year in its series, from
    ``horizon`` on, and its window the ``horizon`` years before it and itself."""
    place = F.dense_rank().over(W.partitionBy(*series).orderBy(year)) - 1  # one cell's years
    d = table.withColumn("__at", place).withColumn("__last", F.max("__at").over(W.partitionBy(*series)))
    d = d.withColumn("target", F.explode(F.sequence(F.greatest(F.col("__at"), F.lit(horizon)), F.least(F.col("__at") + horizon, F.col("__last")))))
    return d.filter(F.col("target") >= F.col("__at")).drop("__last")


def evaluation_predictions(table: DataFrame, keys, predict, states: dict[str, str], outputs, mode: str, horizon: int = 1, carry: str = "annual",
                           steps=("year", "month"), complete=(), start: dict[str, str] | None = None, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Predicted rows (keys, cell, steps, outputs) of all cells and years that the mode asks for.

    ``table`` has a row for each finest step with the forcing and, in the columns that ``start`` names, the given
    states. 'teacher_forced' predicts every year from its own given states; 'full_sequence' the first one of a
    series, the others from what is carried on; 'tail_only' every year after ``horizon`` years that started from
    given states, these years themselves left out. A year with a gap in the ``complete`` columns is not
    predicted, nor what hangs on it.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    keys, steps = list(keys), list(steps)
    rules = dict(predict=predict, states=states, outputs=list(outputs), carry=carry, steps=steps, start=start or {n: f"start_{n}" for n in states},
                 complete=list(complete), grid=grid, pin=False)
    if mode == "full_sequence":
        return rollout(table, keys, **rules)
    d = run_up_windows(table, [*keys, *CELL], 0 if mode == "teacher_forced" else horizon)
    # A window is a series of its own; only its last year counts, the one at its target.
    out = rollout(d.drop("__at"), [*keys, "target"], **rules)
    if mode == "teacher_forced":
        return out.drop("target")
    last = F.max(steps[0]).over(W.partitionBy(*keys, *CELL, "target"))  # one window's years
    return out.withColumn("__last", last).filter(F.col(steps[0]) == F.col("__last")).drop("__last", "target")


def evaluation_pairs(predicted: DataFrame, labels: DataFrame, keys, monthly=(), annual=()) -> DataFrame:
    """(variable, keys, cell, year, month, y, yhat): means of the predicted steps next to the ``labels`` (variable, keys, cell, year,
    month, value; month is missing in annual ones). Cell-years with a gap in a label, apart from those
    whose gaps do not count, and predictions with a gap are left out."""
    key = [*keys, *CELL]
    whole = complete_label_years(labels, key)
    parts = []
    for names, by in ((list(monthly), ["year", "month"]), (list(annual), ["year"])):
        if names:
            pooled = predicted.groupBy(*key, *by).agg(*[F.when(F.count(n) == F.count(F.lit(1)), F.avg(n)).alias(n) for n in names])
            rows = pooled.unpivot([*key, *by], names, "variable", "yhat")
            mine = labels.filter(F.col("variable").isin(*names)).select("variable", *key, *by, F.col("value").alias("y"))
            d = rows.join(mine, ["variable", *key, *by]).filter("yhat is not null")
            parts.append(d if "month" in by else d.withColumn("month", F.lit(None).cast("int")))
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out.join(whole, [*key, "year"], "left_semi").select("variable", *key, "year", "month", "y", "yhat")


def evaluate_modes(table: DataFrame, labels: DataFrame, keys, predict, states, outputs, monthly=(), annual=(), modes=MODES, horizon: int = 1, **rules) -> DataFrame:
    """The metric table of every mode, named in the column ``mode``.

    The table, the labels and what a mode predicts are read several times and computed once.
    """
    table, labels, out = stored(table, "forcing"), stored(labels, "labels"), None
    for mode in modes:
        predicted = stored(evaluation_predictions(table, keys, predict, states, outputs, mode, horizon, **rules), mode)
        d = metric_table(evaluation_pairs(predicted, labels, keys, monthly, annual)).withColumn("mode", F.lit(mode))
        out = d if out is None else out.unionByName(d)
    return out
