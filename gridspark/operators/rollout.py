"""Carried-state scoring, state templates, nudging and counterfactual offsets."""

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridspark.functions.geo import HALF_DEGREE, GridSpec
from gridspark.functions.sizing import broadcast_bounded, broadcast_counted
from gridspark.operators.samples import stats_of
from gridspark.schema import CELL, NON_NEGATIVE_OFFSETS


# --- carry rules as DataFrames -------------------------------------------------------

def carry_annual_mean(df: DataFrame, keys, value: str = "value", out: str = "state") -> DataFrame:
    """State of every day = mean of the year before; missing in the first year."""
    prev = (df.groupBy(*keys, "year").agg(F.avg(value).alias(out))
            .withColumn("year", F.col("year") + 1))
    return df.join(prev, [*keys, "year"], "left")


def carry_december(df: DataFrame, keys, kind: str = "kind", value: str = "value", out: str = "state",
                   rest: float | None = 0.0) -> DataFrame:
    """Monthly states take last December's mean in January and ``rest`` in other months
    (0 when predicting, None when training); annual states take last year's mean."""
    prev = df.groupBy(*keys, "year").agg(
        F.avg(F.when(F.col("month") == 12, F.col(value))).alias("__dec"), F.avg(value).alias("__ann"))
    prev = prev.withColumn("year", F.col("year") + 1)
    d = df.join(prev, [*keys, "year"], "left")
    monthly = F.when(F.col("month") == 1, F.col("__dec")).otherwise(F.lit(rest).cast("double"))
    state = F.when(F.col(kind) == "monthly", monthly).when(F.col(kind) == "annual", F.col("__ann"))
    return d.withColumn(out, F.coalesce(state, F.lit(0.0)) if rest is not None else state).drop("__dec", "__ann")


def states_from_forcing(df: DataFrame, keys, value: str = "value", out: str = "state") -> DataFrame:
    """No carry: a step's state is the forcing of the same month a year before; the first
    year is pinned to its own forcing; absent values count as 0."""
    prev = df.select(*keys, (F.col("year") + 1).alias("year"), "month", F.col(value).alias("__p"))
    first = F.min("year").over(W.partitionBy(*keys))
    d = df.withColumn("__first", first).join(prev, [*keys, "year", "month"], "left")
    state = F.when(F.col("year") == F.col("__first"), F.col(value)).otherwise(F.col("__p"))
    return d.withColumn(out, F.coalesce(state, F.lit(0.0))).drop("__first", "__p")


def seed_states(df: DataFrame, keys, variables, seed_year: int, value: str = "state",
                source: DataFrame | None = None) -> DataFrame:
    """Replace chosen states by those of another year, month by month."""
    src = source if source is not None else df
    s = (src.filter(F.col("variable").isin(*variables) & (F.col("year") == seed_year))
         .select(*keys, "month", F.col(value).alias("__s"), F.lit(True).alias("__hit")))
    d = df.join(s, [*keys, "month"], "left")
    return d.withColumn(value, F.when(F.col("__hit"), F.col("__s")).otherwise(F.col(value))).drop("__s", "__hit")


def carry_months(df: DataFrame, keys, gain: float, forcing: str = "value", start: str = "start") -> DataFrame:
    """State inside a year: month m sees gain * state(m-1) + forcing(m); ``start`` feeds
    January. Twelve rows per group are folded in order."""
    rows = F.sort_array(F.collect_list(F.struct("month", F.col(forcing).alias("f"))))
    g = df.groupBy(*keys, "year").agg(rows.alias("__r"), F.first(start).alias("__s0"))
    return _fold(g, [*keys, "year"], "month", gain, F.lit(1.0), F.col("__s0"))


def _fold(g: DataFrame, keys, order: str, gain, weight, initial) -> DataFrame:
    zero = F.struct(initial.cast("double").alias("s"),
                    F.array().cast(f"array<struct<{order}:int,state:double>>").alias("out"))

    def step(acc, r):
        s = acc["s"] * gain + r["f"] * weight
        return F.struct(s.alias("s"), F.concat(acc["out"], F.array(F.struct(
            r[order].cast("int").alias(order), s.alias("state")))).alias("out"))

    d = g.withColumn("__o", F.explode(F.aggregate("__r", zero, step, lambda a: a["out"])))
    return d.select(*keys, F.col(f"__o.{order}").alias(order), F.col("__o.state").alias("state"))


def rollout_affine(df: DataFrame, keys, gain: float, weight: float, initial: float = 0.0,
                   order: str = "year", forcing: str = "value") -> DataFrame:
    """Carried state of an affine predictor, without Python: state = gain * previous
    state + weight * forcing. A group is one cell's years."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(forcing).alias("f"))))
    g = df.groupBy(*keys).agg(rows.alias("__r"))
    return _fold(g, list(keys), order, F.lit(gain), F.lit(weight), F.lit(initial))


class Nudging(NamedTuple):
    """How a rollout pulls its states: (mean, std) per state, strength and mode of ``nudge``."""
    stats: dict[str, tuple[float, float]]
    lam: float
    mode: str = "z_shrink"

    def of(self, name: str, value: np.ndarray) -> np.ndarray:
        mu, sd = self.stats.get(name, (0.0, 1.0))
        sd = sd if sd is not None and np.isfinite(sd) and sd > 0 else 1.0
        z, lam = (value - mu) / sd, self.lam
        if self.mode == "none" or lam == 0:
            return value
        if self.mode == "original":
            return mu + (lam * sd - z) * sd
        if self.mode == "z_shrink":
            return mu + (1 - lam) * z * sd
        if self.mode == "z_mirror":
            return mu + np.clip(z, -3.0, 3.0) * sd
        if self.mode == "z_adaptive":
            k = 1 - max(0.0, min(1.0, lam))
            return mu + np.where(np.abs(z) <= 3.0, k * z, np.sign(z) * (3.0 - (3.0 - np.abs(z)) * k)) * sd
        raise ValueError(f"unknown nudge mode {self.mode!r}")


# --- rollout with a caller's predictor -----------------------------------------------

def rollout(df: DataFrame, keys, predict, states: dict[str, str], outputs, carry: str = "annual",
            cell=CELL, steps=("year", "month"), initial: float = 0.0, grid: GridSpec = HALF_DEGREE,
            start: dict[str, str] | None = None, complete=(), nudging: Nudging | None = None,
            split: int = 1, pin: bool = True) -> DataFrame:
    """Yearly rollout with any predictor, a tile of cells at a time.

    ``predict(frame)`` gets one year of all cells of a tile as a pandas frame, ordered by
    cell and step, with the forcing and one column per state in ``states`` (name ->
    'monthly' or 'annual'), and returns the ``outputs`` (a superset of the states) as
    columns in the same row order. ``keys`` are what a tile is repeated over (source,
    scenario). Carry rules: 'annual' (last year's mean) and 'december' (monthly states
    take last December in January, 0 in other months); missing steps do not enter a mean.

    In the first year of a cell a state is ``initial``, or the column that ``start`` names
    for it (``seed_states`` may have changed that column); then, unless ``pin`` is off, the state's
    output of that year is this start value too, and is what is carried on. In later years ``nudging``
    pulls the state outputs before they are carried. With ``complete`` columns a cell-year
    with a missing value in one of them or in a state is not predicted: its outputs are
    missing, and so is the state it hands on.

    Partitions are sorted by tile and year and read as a stream, so a task holds one year
    of one tile (at most tile*tile cells, or about that over ``split``) and its carried
    states, not the whole series.
    """
    keys, cell, steps = list(keys), list(cell), list(steps)
    year = steps[0]
    names = [*keys, *cell, *steps]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names)
    schema += "".join(f", `{o}` double" for o in outputs)
    unit = [*keys, "__tile"]
    d = in_tiles(df, "__tile", cell, grid, split).repartition(*unit).sortWithinPartitions(*unit, year, *cell, *steps[1:])
    rule = (names, cell, steps, predict, dict(states), list(outputs), carry, initial, dict(start or {}), list(complete), nudging, pin)

    def run(batches):
        held, now, carried = [], None, {}
        for pdf in batches:
            first = _starts(pdf, [*unit, year])
            for a, b in zip(first, [*first[1:], len(pdf)]):
                key = tuple(None if pd.isna(pdf[c].iat[a]) else pdf[c].iat[a] for c in (*unit, year))
                if now is not None and key != now:
                    yield _score_year(pd.concat(held), rule, carried)
                    if key[:-1] != now[:-1]:
                        carried = {}
                    held = []
                now = key
                held.append(pdf.iloc[a:b])
        if held:
            yield _score_year(pd.concat(held), rule, carried)

    return d.mapInPandas(run, schema)


def in_tiles(df: DataFrame, name: str, cell, grid: GridSpec, split: int = 1) -> DataFrame:
    """Add the tile of each cell, or its part of a tile cut into ``split``."""
    cell = list(cell)
    tile = grid.tile_id(*cell) if cell == list(CELL) else F.pmod(F.xxhash64(*cell), F.lit(grid.n_tiles))
    if split > 1:
        tile = tile * split + F.pmod(F.xxhash64(*cell, F.lit("part")), F.lit(split))
    return df.withColumn(name, tile)


def _starts(frame, columns) -> list[int]:
    """First rows of the runs of equal values; missing values are equal."""
    change = np.zeros(max(len(frame) - 1, 0), bool)
    for c in columns:
        code = pd.factorize(frame[c])[0]
        change |= code[1:] != code[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist()] if len(frame) else []


def _means(values, first, use):
    """Mean per run of rows over those in ``use``, missing where there are none."""
    n = np.add.reduceat(use.astype(float), first)
    total = np.add.reduceat(np.where(use, values, 0.0), first)
    return np.divide(total, n, out=np.full(len(first), np.nan), where=n > 0)


def _score_year(frame, rule, carried):
    """Score one year of a tile; returns its rows and leaves in ``carried`` what each cell hands
    on: (cell) -> (year means, December means) of the states. A cell without rows keeps its own."""
    names, cell, steps, predict, states, outputs, carry, initial, start, complete, nudging, pin = rule
    frame = frame.reset_index(drop=True)
    first = np.array(_starts(frame, cell))
    ids = [tuple(None if pd.isna(x) else x for x in t) for t in frame[cell].iloc[first].itertuples(index=False, name=None)]
    owner = np.repeat(np.arange(len(first)), np.diff([*first, len(frame)]))
    blank = np.full(len(states), np.nan)
    last = [carried.get(i, (blank, blank)) for i in ids]
    year_mean, december = (np.array([x[k] for x in last]) for k in (0, 1))
    later = np.array([i in carried for i in ids])[owner]
    month = frame["month"].to_numpy() if "month" in steps else None
    for k, (name, kind) in enumerate(states.items()):
        state = year_mean[owner, k]
        if carry != "annual" and kind != "annual":
            state = np.where(month == 1, december[owner, k], 0.0)
        begin = frame[start[name]].to_numpy(dtype=float) if name in start else initial
        frame[name] = np.where(later, state, begin)
    ok = np.ones(len(frame), bool)
    if complete:
        whole = np.isfinite(frame[[*complete, *states]].to_numpy(dtype=float)).all(1)
        ok = np.logical_and.reduceat(whole, first)[owner]
    got = predict(frame[ok].reset_index(drop=True)) if ok.any() else None
    res = frame[names].copy()
    for o in outputs:
        out = np.full(len(frame), np.nan)
        if got is not None:
            out[ok] = np.asarray(got[o], dtype=float)
        if o in states and nudging:
            out = np.where(later, nudging.of(o, out), out)
        if o in start and pin:
            out = np.where(later, out, frame[o])
        res[o] = out
    values = [res[name].to_numpy() for name in states]
    present = [~np.isnan(v) for v in values]
    year_mean = np.stack([_means(v, first, p) for v, p in zip(values, present)], 1)
    if month is not None:
        december = np.stack([_means(v, first, p & (month == 12)) for v, p in zip(values, present)], 1)
    carried.update(zip(ids, zip(year_mean, december)))
    return res


# --- nudging -------------------------------------------------------------------------

def nudge(value: Column, mean: Column, std: Column, lam: float, mode: str) -> Column:
    """Pull a state towards its mean, in physical units.

    'z_mirror' ignores the strength and only clips to three deviations; 'original' is not
    a blend. Both are kept as they are, since stored results depend on them.
    """
    mu = F.coalesce(mean, F.lit(0.0))
    sd = F.when(std > 0, std).otherwise(1.0)
    z = (value - mu) / sd
    if mode == "none" or lam == 0:
        return value
    if mode == "original":
        return mu + (lam * sd - z) * sd
    if mode == "z_shrink":
        return mu + (1 - lam) * z * sd
    if mode == "z_mirror":
        return mu + F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)) * sd
    if mode == "z_adaptive":
        k = 1 - max(0.0, min(1.0, lam))
        far = F.signum(z) * (3.0 - (3.0 - F.abs(z)) * k)
        return mu + F.when(F.abs(z) <= 3.0, k * z).otherwise(far) * sd
    raise ValueError(f"unknown nudge mode {mode!r}")


def nudge_states(df: DataFrame, stats: DataFrame, states, lam: float, mode: str, value: str = "value") -> DataFrame:
    """Nudge the listed state variables, leave the others."""
    d = df.join(broadcast_bounded(stats_of(stats, states), len(states)), "variable", "left")
    v = nudge(F.col(value), F.col("mean"), F.col("std"), lam, mode)
    return d.withColumn(value, F.when(F.col("variable").isin(*states), v)
                        .otherwise(F.col(value))).drop("mean", "std")


def nudge_by_modes(df: DataFrame, stats: DataFrame, states, lam: float, modes, value: str = "value") -> DataFrame:
    """:func:`nudge_states` under each of ``modes``, named in the column ``mode``; the field is read once."""
    d = df.join(broadcast_bounded(stats_of(stats, states), len(states)), "variable", "left")
    d = d.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    pulled = F.col(value)
    for m in modes:
        pulled = F.when(F.col("mode") == m, nudge(F.col(value), F.col("mean"), F.col("std"), lam, m)).otherwise(pulled)
    return d.withColumn(value, F.when(F.col("variable").isin(*states), pulled).otherwise(F.col(value))).drop("mean", "std")


# --- counterfactual offsets ----------------------------------------------------------

SCOPES = ("daily", "monthly", "annual")


def parse_offsets(specs: DataFrame, spec: str = "spec", keys=()) -> DataFrame:
    """``scope:var=value[%]`` lists to rules (scope, variable, mode, value).

    An entry without a scope, with an unknown one or without a number is left out; the
    last entry of a variable wins.
    """
    d = specs.select(*keys, F.posexplode(F.split(spec, ",")).alias("__i", "__e"))
    e = F.trim("__e")
    rest = F.regexp_extract(e, r"^[^:]*:(.*)$", 1)
    number = F.trim(F.regexp_extract(rest, r"^[^=]*=(.*)$", 1))
    d = d.select(
        *keys, "__i",
        F.lower(F.trim(F.regexp_extract(e, r"^([^:]*):", 1))).alias("scope"),
        F.trim(F.regexp_extract(rest, r"^([^=]*)=", 1)).alias("variable"),
        F.when(number.endswith("%"), "percent").otherwise("add").alias("mode"),
        F.regexp_replace(number, r"%$", "").try_cast("double").alias("value"))
    d = d.filter(F.col("scope").isin(*SCOPES) & F.col("value").isNotNull())
    return (d.groupBy(*keys, "scope", "variable")
            .agg(F.max_by(F.struct("mode", "value"), "__i").alias("__r"))
            .select(*keys, "scope", "variable", "__r.mode", "__r.value"))


def apply_offsets(df: DataFrame, rules: DataFrame, scope: str = "scope", value: str = "value",
                  non_negative=NON_NEGATIVE_OFFSETS) -> DataFrame:
    """Add or scale by the rule of (scope, variable), then clip the listed variables at 0."""
    r = rules.select(F.col("scope").alias(scope), "variable", F.col("mode").alias("__m"), F.col("value").alias("__x"))
    d = df.join(broadcast_counted(r, 10_000), [scope, "variable"], "left")
    v = F.col(value)
    moved = _moved(v, F.col("__m"), F.col("__x"), F.col("variable").isin(*non_negative))
    return d.withColumn(value, F.when(F.col("__m").isNotNull(), moved).otherwise(v)).drop("__m", "__x")


def offset_columns(df: DataFrame, rules: DataFrame, scopes: dict[str, str], non_negative=NON_NEGATIVE_OFFSETS) -> DataFrame:
    """:func:`apply_offsets` for a table with a column for each variable, whose scopes ``scopes`` has."""
    found = {(r.scope, r.variable): r for r in rules.filter(F.col("variable").isin(*scopes)).collect()}  # one for each variable and scope
    return df.withColumns({n: _moved(F.col(n), F.lit(found[s, n].mode), F.lit(found[s, n].value), F.lit(n in non_negative))
                           for n, s in scopes.items() if (s, n) in found})


def _moved(v: Column, mode: Column, x: Column, clip: Column) -> Column:
    moved = F.when(mode == "percent", v * (1 + x / 100)).otherwise(v + x)
    return F.when(clip & (moved < 0), 0.0).otherwise(moved)


# Offset sweeps.
TEMPERATURE_SWEEP = tuple(float(x) for x in range(-5, 6))
PRECIPITATION_SWEEP = tuple(float(x) for x in range(0, -101, -10))


def sweep_offsets(df: DataFrame, variable: str, offsets, mode: str, value: str = "value") -> DataFrame:
    """One copy of the field per offset; the listed variable is moved in each copy."""
    d = df.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    v = F.col(value)
    moved = v * (1 + F.col("offset") / 100) if mode == "percent" else v + F.col("offset")
    if variable in NON_NEGATIVE_OFFSETS:
        moved = F.greatest(moved, F.lit(0.0))
    return d.withColumn(value, F.when((F.col("variable") == variable) & v.isNotNull(), moved).otherwise(v))
