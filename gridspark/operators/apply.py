"""A caller's function per series, and over a list of inputs."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridspark.operators.rollout import _starts

_WHOLE = ("tinyint", "smallint", "int", "bigint", "boolean")


def apply_series(df: DataFrame, keys, fn, schema: str, order: str = "t") -> DataFrame:
    """Run ``fn(frame) -> frame`` on every series, rows in time order.

    A series is one cell's time axis, so a group has at most 44,895 rows. Partitions are sorted by series and
    read as a stream of batches with many series each, so a task holds a batch and a series, and a
    series costs a call of ``fn``. Its frame has the types it would have alone.
    """
    keys, names = list(keys), df.columns
    out = df.sparkSession.createDataFrame([], schema).columns
    # A missing value makes whole numbers of the batch floats: they travel as 0 with a flag.
    flags = {c: f"__none_{i}" for i, (c, t) in enumerate(df.dtypes) if t in _WHOLE}
    d = df.repartition(*keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_last())
    zero = {c: F.lit(False) if t == "boolean" else F.lit(0).cast(t) for c, t in df.dtypes if c in flags}
    d = d.select(*[F.coalesce(c, zero[c]).alias(c) if c in flags else F.col(c) for c in names], *[F.col(c).isNull().alias(n) for c, n in flags.items()])
    marks = [*keys, *[flags[c] for c in keys if c in flags]]

    def series(parts):
        frame = parts[0] if len(parts) == 1 else pd.concat(parts)
        frame.index = pd.RangeIndex(len(frame))
        if len(frame.columns) > len(names):
            for c, n in flags.items():
                if n in frame and frame[n].eq(True).any():
                    frame[c] = frame[c].astype(object if frame[c].dtype == bool else float).mask(frame[n].eq(True), None)
            frame = frame[names]
        got = fn(frame)
        if not len(got):
            return None
        if list(got.columns) == out:
            return got
        return got[out] if any(isinstance(c, str) for c in got.columns) else got.set_axis(out, axis=1)

    def joined(frames):
        """Results in as few frames as keep their types."""
        held = []
        for f in frames:
            if f is None:
                continue
            if held and not f.dtypes.equals(held[-1].dtypes):
                yield pd.concat(held)
                held = []
            held.append(f)
        if held:
            yield pd.concat(held)

    def run(batches):
        held, last = [], None
        for pdf in batches:
            if not len(pdf):
                continue
            first, end = _starts(pdf, marks), pdf[marks].iloc[[0, -1]]
            if held and len(_starts(pd.concat([last, end.iloc[:1]]), marks)) > 1:
                yield from joined([series(held)])
                held = []
            last = end.iloc[1:]
            if not any(pdf[n].any() for n in flags.values()):
                pdf = pdf[names]
            done = []
            for a, b in zip(first, [*first[1:], len(pdf)]):
                held.append(pdf.iloc[a:b])
                if b < len(pdf):
                    done.append(series(held))
                    held = []
            yield from joined(done)
        if held:
            yield from joined([series(held)])

    return d.mapInPandas(run, schema)


def apply_steps(df: DataFrame, steps) -> DataFrame:
    """Run a list of DataFrame -> DataFrame steps one after the other, as one lazy plan."""
    for step in steps:
        df = step(df)
    return df
