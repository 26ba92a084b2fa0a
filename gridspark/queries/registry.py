"""Registry of the runnable queries and their SQL twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with the SQL that gives the same rows."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    """Round so that the order of a floating sum does not show."""
    return df.withColumns({c: F.round(c, n) for c in cols})


def hash_sql(*cols: str, seed: int = 0) -> str:
    """The sort key of ``functions.ranking.hash_key`` in SQL."""
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
    return f"CAST(('0x' || md5(concat_ws('|', {parts}, '{seed}'))[1:15]) AS BIGINT)"


# SQL snippets over lat_idx, mirroring functions/geo.py.
LAT = "CAST(-89.75 + lat_idx * 0.5 AS DOUBLE)"
AREA = ("(6371000.0 * 6371000.0 * radians(0.5) * "
        f"(sin(radians({LAT} + 0.25)) - sin(radians({LAT} - 0.25))))")
AREA_COS = f"(6371000.0 * 6371000.0 * radians(0.5) * radians(0.5) * cos(radians({LAT})))"
SECONDS_MEAN_MONTH = "(365.0 / 12.0 * 86400.0)"
TILE = "((lat_idx // 30) * 24 + lon_idx // 30)"
