"""Fields laid out once by cell, so that work per cell needs no shuffle.

A layout is a table bucketed by the cell and sorted by cell, series and step inside each bucket. Every job
that groups, joins or runs windows by cell reads buckets as its partitions. For joins on more
columns than the cell the session needs ``spark.sql.requireAllClusterKeysForCoPartition=false``.
"""

import uuid

from pyspark.sql import DataFrame

from gridspark.schema import CELL
from gridspark.session import scratch_path

#: Rows of one bucket, about.
BUCKET_ROWS = 2_000_000


def buckets_for(rows: int, least: int = 1) -> int:
    """A power of two, so that layouts of different sizes still line up."""
    return max(least, 1 << max(0, (rows // BUCKET_ROWS).bit_length()))


def write_layout(df: DataFrame, sort=(), keys=CELL, buckets: int | None = None, name: str | None = None) -> str:
    """Write ``df`` as a bucketed table and return its name. Tables that meet in a join want the same
    ``keys``; bucket numbers may differ by a power of two. Rows of one cell lie in one bucket, at most the
    calendar's steps for each series, so no bucket grows with a hot cell beyond that."""
    spark, keys = df.sparkSession, list(keys)
    name = name or f"layout_{uuid.uuid4().hex}"
    n = buckets or buckets_for(df.count())
    df = df.repartition(n, *keys)
    df.write.bucketBy(n, *keys).sortBy(*keys, *sort).option("path", scratch_path(spark, name)).saveAsTable(name)
    return name


def read_layout(spark, name: str) -> DataFrame:
    return spark.table(name)
