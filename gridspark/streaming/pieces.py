"""Running moments as keyed state: a piece that comes again takes its earlier moments back.

Every task first sums up what it has read of each piece, so only partial moments are shuffled. State of a
piece remembers its version and the keys it has rows of; state of a key holds the moments of each
piece. A newer version of a piece replaces its moments everywhere and takes them from keys that
it no longer has; an older one, or the same again, changes nothing.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_FIGURES = ("n", "total", "mean", "m2", "least", "most")
_FIGURES_SCHEMA = "n long, total double, mean double, m2 double, least double, most double"


def merged(rows):
    """Moments of all rows from an iterable of (n, total, mean, m2, least, most)."""
    n, total, mean, m2, least, most = 0, 0.0, 0.0, 0.0, None, None
    for k, t, m, s, a, z in rows:
        if not k:
            continue
        gap, both = m - mean, n + k
        m2 += s + gap * gap * n * k / both
        mean += gap * k / both
        n, total = both, total + t
        least, most = (a, z) if least is None else (min(least, a), max(most, z))
    return (n, total, mean, m2, least, most) if n else (0, 0.0, 0.0, 0.0, None, None)


class _Pieces(StatefulProcessor):
    """By piece: passes on the newest version's moments, with n = 0 for keys that it has lost."""

    def __init__(self, keys, schema: str):
        self.keys, self.schema = keys, schema

    def init(self, handle):
        self.version = handle.getValueState("version", "version long")
        self.known = handle.getMapState("keys", self.schema, "present boolean")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows))
        top = int(frame["version"].max())
        if self.version.exists() and top <= self.version.get()[0]:
            return
        self.version.update((top,))
        frame = frame[frame["version"] == top]
        now = {}
        for row in frame[[*self.keys, *_FIGURES]].itertuples(index=False, name=None):
            at = tuple(None if pd.isna(x) else x for x in row[:len(self.keys)])
            now.setdefault(at, []).append(row[len(self.keys):])
        old = [tuple(k) for k in self.known.keys()]
        for at in old:
            if at not in now:
                self.known.removeKey(at)
        for at in now:
            self.known.updateValue(at, (True,))
        out = [(key[0], *at, *merged(v)) for at, v in now.items()] + [(key[0], *at, *merged(())) for at in old if at not in now]
        yield pd.DataFrame(out, columns=["piece", *self.keys, *_FIGURES])

    def close(self):
        pass


class _Totals(StatefulProcessor):
    """By key: the moments of every piece, and their sum as the key's moments."""

    def __init__(self, keys):
        self.keys = keys

    def init(self, handle):
        self.pieces = handle.getMapState("pieces", "piece string", _FIGURES_SCHEMA)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for piece, *figures in frame[["piece", *_FIGURES]].itertuples(index=False, name=None):
                if figures[0]:
                    self.pieces.updateValue((piece,), (int(figures[0]), *map(float, figures[1:])))
                elif self.pieces.containsKey((piece,)):
                    self.pieces.removeKey((piece,))
        held = sorted((k[0], tuple(v)) for k, v in self.pieces.iterator())
        yield pd.DataFrame([(*key, *merged(v for _, v in held))], columns=[*self.keys, *_FIGURES])

    def close(self):
        pass


def _partial(keys, columns):
    """Moments of each piece, version and key in every Arrow batch."""
    def run(batches):
        for b in batches:
            b = b[b["value"].notna()]
            if len(b):
                g = b.groupby(["piece", "version", *keys], dropna=False, sort=False)["value"]
                d = g.agg(n="count", total="sum", mean="mean", m2=lambda v: float(((v - v.mean()) ** 2).sum()), least="min", most="max").reset_index()
                yield d[columns]
    return run


def keyed_moments(stream: DataFrame, path: str, checkpoint: str, keys=("variable", "year"), value: str = "value") -> None:
    """Run all waiting pieces of ``stream`` (columns piece, version, the keys and the value) into the state
    below ``checkpoint`` and write every key's new moments to ``path``.

    ``piece`` names a piece (a file, say), ``version`` (a whole number, its time of change, say) orders its editions;
    all rows of an edition come in one micro-batch, as those of a file do. How many files one takes is the
    reader's ``maxFilesPerTrigger``. Missing values do not count; an edition without any present value
    leaves earlier ones as they are.
    """
    spark, keys = stream.sparkSession, list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    d = stream.select(F.col("piece").cast("string").alias("piece"), F.col("version").cast("long").alias("version"), *keys, F.col(value).cast("double").alias("value"))
    columns = ["piece", "version", *keys, *_FIGURES]
    d = d.mapInPandas(_partial(keys, columns), f"piece string, version long, {key_schema}, {_FIGURES_SCHEMA}")
    d = d.groupBy("piece").transformWithStateInPandas(_Pieces(keys, key_schema), f"piece string, {key_schema}, {_FIGURES_SCHEMA}", "append", "none")
    d = d.groupBy(*keys).transformWithStateInPandas(_Totals(keys), f"{key_schema}, {_FIGURES_SCHEMA}", "append", "none")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)  # keyed state with maps needs it; the query keeps the setting it started with
    try:
        q = d.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    q.awaitTermination()


def current_moments(spark: SparkSession, path: str, keys=("variable", "year")) -> DataFrame:
    """(keys, n, sum, mean, std, min, max) as of the last micro-batch; keys without rows are left out."""
    d = spark.read.parquet(path)
    last = d.groupBy(*keys).agg(F.max_by(F.struct(*_FIGURES), "batch_id").alias("m")).filter("m.n > 0")
    return last.select(*keys, "m.n", F.col("m.total").alias("sum"), "m.mean", F.sqrt(F.col("m.m2") / F.col("m.n")).alias("std"),
                       F.col("m.least").alias("min"), F.col("m.most").alias("max"))
