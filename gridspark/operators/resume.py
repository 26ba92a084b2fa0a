"""Rollouts that go on where a broken run ended.

Predictions and the states that every year hands on are written block by block of years, each
block as one attempt; a log of (unit, year, attempt) is written after it. What an attempt
wrote without reaching the log is never read. A unit is a tile for one value of the keys.
"""

import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.functions.geo import HALF_DEGREE, GridSpec
from gridspark.functions.sizing import broadcast_counted, stored
from gridspark.operators.rollout import Nudging, _score_year, _starts, in_tiles
from gridspark.schema import CELL
from gridspark.session import own_writers

FORCING, STATES = 1, 0


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _same(left: str, right: str, columns):
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """(unit columns, year, attempt) of what the log says is done; None before the first commit."""
    log = _read(spark, f"{path}/log")
    if log is None:
        return None
    unit = [c for c in log.columns if c not in ("seq", "done", "attempt")]
    last = log.groupBy(*unit).agg(F.max_by(F.struct("done", "attempt"), "seq").alias("last"))
    return last.filter("last.done").select(*unit, "last.attempt")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """All predicted rows that the log vouches for."""
    done = finished(spark, path)
    rows = spark.read.parquet(f"{path}/blocks").filter(F.col("kind") == FORCING)
    year = done.columns[-2]
    columns = [c for c in rows.columns if c not in ("kind", "attempt", "tile", "states", "decembers")]
    unit = [*[c for c in done.columns if c not in ("attempt", year)], year, "attempt"]
    return rows.alias("l").join(broadcast_counted(done).alias("r"), _same("l", "r", unit), "left_semi").select(*columns)


def forget(spark: SparkSession, path: str, units: DataFrame, year: int) -> None:
    """Take ``units`` (their columns as in the log) back to before ``year``: later years are predicted again."""
    done = finished(spark, path)
    if done is None:
        return
    column = done.columns[-2]
    gone = done.filter(F.col(column) >= year).alias("l").join(units.alias("r"), _same("l", "r", units.columns), "left_semi")
    _append(gone, path, False)


def _append(done: DataFrame, path: str, kept: bool) -> None:
    spark = done.sparkSession
    log = _read(spark, f"{path}/log")
    seq = 0 if log is None else log.agg(F.max("seq")).first()[0] + 1
    # One row for each unit and year of a block, in one file, so an entry is there as a whole or not at all.
    done.withColumns({"seq": F.lit(seq).cast("long"), "done": F.lit(kept)}).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _handed_on(spark, path, done, todo, unit, year):
    """State rows of the last finished year of each unit before its first one to do."""
    first = todo.groupBy(*unit).agg(F.min(year).alias("__first"))
    before = done.alias("l").join(first.alias("r"), _same("l", "r", unit)).filter(F.col(f"l.{year}") < F.col("__first"))
    last = before.groupBy(*[F.col(f"l.{c}").alias(c) for c in unit]).agg(F.max_by(F.struct(F.col(f"l.{year}").alias(year), "attempt"), F.col(f"l.{year}")).alias("last"))
    last = last.select(*unit, f"last.{year}", "last.attempt")
    rows = spark.read.parquet(f"{path}/blocks").filter(F.col("kind") == STATES)
    return rows.alias("l").join(broadcast_counted(last).alias("r"), _same("l", "r", [*unit, year, "attempt"]), "left_semi")


def rollout_resumable(df: DataFrame, path: str, keys, predict, states: dict[str, str], outputs, carry: str = "annual",
                      cell=CELL, steps=("year", "month"), initial: float = 0.0, grid: GridSpec = HALF_DEGREE,
                      start: dict[str, str] | None = None, complete=(), nudging: Nudging | None = None,
                      split: int = 1, block_years: int = 10, until: int | None = None) -> DataFrame:
    """:func:`rollout` kept in the folder ``path``; the result is all that the log there vouches for.

    Years run in blocks of ``block_years``, one job each, up to ``until``. Rows of finished units and years
    are left out by an anti-join, and a unit goes on from the states of its last finished year, so a
    run that broke, new units, and units that :func:`forget` took back end with what one whole run
    gives. One run at a time writes to a folder. Other arguments are those of :func:`rollout`.
    """
    spark = df.sparkSession
    keys, cell, steps, outputs = list(keys), list(cell), list(steps), list(outputs)
    year, unit = steps[0], [*keys, "tile"]
    names = [*keys, *cell, *steps]
    rows = in_tiles(df, "tile", cell, grid, split)
    present = stored(rows.select(*unit, year).distinct(), "units")  # what there is to do, from one pass over the forcing
    first, last, units = present.agg(F.min(year), F.max(year), F.count_distinct(F.struct(*unit))).first()
    # As many tasks as the session asks for: what a task costs is Python's time, so few bytes do not make one of many units.
    tasks = max(1, min(units, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rule = (names, cell, steps, predict, dict(states), outputs, carry, initial, dict(start or {}), list(complete), nudging, True)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "tile"]) + "".join(f", `{o}` double" for o in outputs)
    # States travel as plain numbers: Arrow walks over all missing arrays of a batch again for each row it adds.
    hands = {"states": [f"__state{i}" for i in range(len(states))], "decembers": [f"__december{i}" for i in range(len(states))]}
    numbers = [*hands["states"], *hands["decembers"]]
    schema += ", kind int" + "".join(f", `{c}` double" for c in numbers)
    carried_kinds = {"kind": "int", **dict.fromkeys(numbers, "double")}

    def plain(name):
        """What a state row has in a column of the forcing: no missing value where that would change a type."""
        return (F.lit(0) if kinds[name] in ("tinyint", "smallint", "int", "bigint") else F.lit(None)).cast(kinds[name]).alias(name)

    def rows_of(unit_now, year_now, carried):
        frame = pd.DataFrame([*carried], columns=cell)
        for c, v in zip([*unit, year], [*unit_now, year_now]):
            frame[c] = v
        frame[numbers] = np.hstack([np.array([v[k] for v in carried.values()]) for k in range(len(hands))])
        return frame.assign(kind=STATES)

    def run(batches):
        held, now, carried = [], None, {}

        def finish():
            frame, of, at = pd.concat(held), now[:-1], now[-1]
            if frame["kind"].iat[0] == STATES:
                ids = [tuple(None if pd.isna(x) else x for x in t) for t in frame[cell].itertuples(index=False, name=None)]
                carried.update(zip(ids, zip(*[frame[hands[c]].to_numpy(dtype=float) for c in hands])))
                return
            out = _score_year(frame.drop(columns=["kind", *numbers]), rule, carried)
            yield shaped(out.assign(tile=of[-1], kind=FORCING))
            yield shaped(rows_of(of, at, carried))

        for pdf in batches:
            begins = _starts(pdf, [*unit, year])
            for a, b in zip(begins, [*begins[1:], len(pdf)]):
                key = tuple(None if pd.isna(pdf[c].iat[a]) else pdf[c].iat[a] for c in (*unit, year))
                if now is not None and key != now:
                    yield from finish()
                    if key[:-1] != now[:-1]:
                        carried = {}
                    held = []
                now = key
                held.append(pdf.iloc[a:b])
        if held:
            yield from finish()

    order = [*names, "tile", *outputs, "kind", *numbers]

    def shaped(frame):
        return frame.reindex(columns=order)

    end = last if until is None or last is None else min(last, until)
    for a in range(first if first is not None else 0, (end if end is not None else -1) + 1, block_years):
        within = F.col(year).between(a, min(a + block_years - 1, end))
        todo, open_units = rows.filter(within), present.filter(within)
        done = finished(spark, path)
        if done is not None:
            todo, open_units = (d.alias("l").join(broadcast_counted(done).alias("r"), _same("l", "r", [*unit, year]), "left_anti").select(*d.columns) for d in (todo, open_units))
        if open_units.isEmpty():
            continue
        fed = todo.select("*", *[F.lit(FORCING if c == "kind" else None).cast(t).alias(c) for c, t in carried_kinds.items()])
        if done is not None:
            have = {*unit, *cell, year}
            fed = fed.unionByName(_handed_on(spark, path, done, open_units, unit, year).select(
                *[F.col(c) if c in have else plain(c) for c in rows.columns], "kind", *[F.col(kept)[i].alias(c) for kept, of in hands.items() for i, c in enumerate(of)]))
        fed = fed.repartition(tasks, *unit).sortWithinPartitions(*unit, year, "kind", *cell, *steps[1:])
        attempt = f"a-{uuid.uuid4().hex}"
        kept = {c: F.when(F.col("kind") == STATES, F.array(*of).cast("array<double>")) for c, of in hands.items()}
        out = fed.mapInPandas(run, schema).withColumns(kept).drop(*numbers)
        with own_writers(spark, 2):  # both kinds are written as they come, without a sort of the task's rows by kind
            out.write.partitionBy("kind").parquet(f"{path}/blocks/attempt={attempt}")
        wrote = spark.read.parquet(f"{path}/blocks/attempt={attempt}").filter(F.col("kind") == FORCING)
        _append(wrote.select(*unit, year).distinct().withColumn("attempt", F.lit(attempt)), path, True)
    if finished(spark, path) is None:
        return df.select(*names, *[F.lit(None).cast("double").alias(o) for o in outputs]).limit(0)
    return predictions(spark, path).select(*names, *outputs)
