"""Field-shaped views of the relational test tables, in Spark and as SQL text.

Suppliers are cells of the half-degree grid, the part number picks the source, the line
number the scenario and the ship date the time, so the number of series grows with the
data. Every view is one partial aggregate over the whole table.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.functions import noleap as nl


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell_of(key: str) -> dict[str, Column]:
    """Cell of a key: ten latitude bands filled row by row, then the next column east."""
    k = F.col(key)
    return {
        "lat_idx": (F.pmod(k, F.lit(10)) * 36 + F.pmod(F.floor(k / 10), F.lit(36))).cast("int"),
        "lon_idx": F.pmod(F.floor(k / 360), F.lit(720)).cast("int"),
    }


def _cell_sql(key: str) -> str:
    return (f"CAST(({key} % 10) * 36 + ({key} // 10) % 36 AS INT) AS lat_idx, "
            f"CAST(({key} // 360) % 720 AS INT) AS lon_idx")


MEASURES = {
    "gpp": "l_extendedprice / 365.2425",
    "ra": "l_extendedprice * l_discount / 73.0485",
    "rh": "l_extendedprice * l_tax / 73.0485",
    "npp": "l_extendedprice * (1 - l_discount) / 365.2425",
}
VARIABLES = tuple(MEASURES)


def _measure(name: str) -> Column:
    return F.expr(MEASURES[name].replace("365.2425", "365.2425D").replace("73.0485", "73.0485D"))


def _keys(*names: str) -> list[Column]:
    cols = {
        "source": F.concat(F.lit("M"), F.pmod(F.col("l_partkey"), F.lit(4)).cast("string")),
        "scenario": F.concat(F.lit("S"), F.pmod(F.col("l_linenumber"), F.lit(4)).cast("string")),
        "year": F.year("l_shipdate"),
        "month": F.month("l_shipdate"),
        "t": nl.date_to_day("l_shipdate"),
        **cell_of("l_suppkey"),
    }
    return [cols[n].alias(n) for n in names]


_KEY_SQL = {
    "source": "'M' || CAST(l_partkey % 4 AS VARCHAR) AS source",
    "scenario": "'S' || CAST(l_linenumber % 4 AS VARCHAR) AS scenario",
    "year": "CAST(year(l_shipdate) AS INT) AS year",
    "month": "CAST(month(l_shipdate) AS INT) AS month",
    "cell": _cell_sql("l_suppkey"),
}


def field(spark: SparkSession, sf_dir: str, *keys: str, measure: str = "gpp") -> DataFrame:
    """Mean of one measure per key, from the key names source, scenario, cell, year, month, t."""
    names = [n for k in keys for n in (("lat_idx", "lon_idx") if k == "cell" else (k,))]
    d = table(spark, sf_dir, "lineitem")
    return d.groupBy(*_keys(*names)).agg(F.avg(_measure(measure)).alias("value"))


def field_sql(*keys: str, measure: str = "gpp", name: str = "field") -> str:
    """The same view as a common table expression."""
    cols = ", ".join(_KEY_SQL[k] for k in keys)
    return (f"{name} AS (SELECT {cols}, avg({MEASURES[measure]}) AS value "
            f"FROM lineitem GROUP BY ALL)")


MONTHLY = ("source", "cell", "year", "month")
MONTHLY_KEYS = ["source", "lat_idx", "lon_idx"]


def field_month(spark, sf_dir, measure="gpp"):
    """Monthly field with a day number, sparse where nothing shipped."""
    return field(spark, sf_dir, *MONTHLY, measure=measure).withColumn("t", nl.day_number("year", F.col("month")))


CUM_SQL = "[0,31,59,90,120,151,181,212,243,273,304,334]"
LEN_SQL = "[31,28,31,30,31,30,31,31,30,31,30,31]"


def month_of_doy_sql(doy: str) -> str:
    ends = [31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
    return "(1 + " + " + ".join(f"CAST({doy} > {e} AS INT)" for e in ends) + ")"


def field_month_sql(measure="gpp"):
    return (field_sql(*MONTHLY, measure=measure, name="field0") + f""",
field AS (SELECT *, CAST((year - 1901) * 365 + {CUM_SQL}[month] AS INT) AS t FROM field0)""")


def field_gaps(spark, sf_dir):
    """Monthly field in which every seventh (row, month) is a missing value, not a missing row."""
    gap = F.pmod(F.col("lat_idx") + F.col("month"), F.lit(7)) == 0
    return field_month(spark, sf_dir).withColumn("value", F.when(~gap, F.col("value")))


def field_gaps_sql():
    return (field_sql(*MONTHLY, name="field0") + f""",
field AS (SELECT source, lat_idx, lon_idx, year, month,
  CASE WHEN (lat_idx + month) % 7 = 0 THEN NULL ELSE value END AS value,
  CAST((year - 1901) * 365 + {CUM_SQL}[month] AS INT) AS t FROM field0)""")


def field_vars(spark, sf_dir, *keys, variables=VARIABLES):
    """Long field with one row per variable and key."""
    names = [n for k in keys for n in (("lat_idx", "lon_idx") if k == "cell" else (k,))]
    d = table(spark, sf_dir, "lineitem").groupBy(*_keys(*names)).agg(
        *[F.avg(_measure(v)).alias(v) for v in variables])
    return d.unpivot(names, list(variables), "variable", "value")


def field_wide(spark, sf_dir, *keys, variables=VARIABLES):
    names = [n for k in keys for n in (("lat_idx", "lon_idx") if k == "cell" else (k,))]
    return table(spark, sf_dir, "lineitem").groupBy(*_keys(*names)).agg(
        *[F.avg(_measure(v)).alias(v) for v in variables])


def field_wide_sql(*keys, variables=VARIABLES, name="wide"):
    cols = ", ".join(_KEY_SQL[k] for k in keys)
    aggs = ", ".join(f"avg({MEASURES[v]}) AS {v}" for v in variables)
    return f"{name} AS (SELECT {cols}, {aggs} FROM lineitem GROUP BY ALL)"


def field_vars_sql(*keys, variables=VARIABLES):
    """Long view; two steps so that the aggregate runs once."""
    names = [n for k in keys for n in (("lat_idx", "lon_idx") if k == "cell" else (k,))]
    parts = "\n  UNION ALL ".join(
        f"SELECT {', '.join(names)}, '{v}' AS variable, {v} AS value FROM wide" for v in variables)
    return f"{field_wide_sql(*keys, variables=variables)},\nfield AS ({parts})"


def field_day(spark, sf_dir):
    """Daily field from events: variable = event type, cell = user, t = day number."""
    d = table(spark, sf_dir, "events")
    return (d.groupBy(F.col("event_type").alias("variable"),
                      *[c.alias(n) for n, c in cell_of("user_id").items()],
                      nl.date_to_day("ts").alias("t"))
            .agg(F.avg(F.col("value") / 7.302).alias("value")))


def field_day_sql():
    return (f"field AS (SELECT event_type AS variable, {_cell_sql('user_id')}, "
            f"CAST((year(ts) - 1901) * 365 + {CUM_SQL}[month(ts)] + "
            "CASE WHEN month(ts) = 2 AND day(ts) = 29 THEN 28 ELSE day(ts) END - 1 AS INT) AS t, "
            "avg(value / 7.302) AS value FROM events GROUP BY ALL)")


def pairs(spark, sf_dir):
    """Label and prediction per line: the price against quantity times retail price."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_quantity", "l_extendedprice",
                                                 "l_suppkey", "l_linenumber", "l_orderkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    d = li.join(p, li.l_partkey == p.p_partkey)
    return d.select(F.col("l_returnflag").alias("variable"), F.col("l_extendedprice").alias("y"),
                    (F.col("l_quantity") * F.col("p_retailprice")).alias("yhat"),
                    *[c.alias(n) for n, c in cell_of("l_suppkey").items()],
                    "l_orderkey", "l_linenumber", "l_suppkey")


PAIRS_SQL = (f"pairs AS (SELECT l_returnflag AS variable, l_extendedprice AS y, "
             f"l_quantity * p_retailprice AS yhat, {_cell_sql('l_suppkey')}, l_orderkey, l_linenumber, l_suppkey "
             "FROM lineitem JOIN part ON l_partkey = p_partkey)")


def cells(spark, sf_dir):
    """Cell table with a land flag and a split code; one row per part cell."""
    d = table(spark, sf_dir, "part").select(
        *[c.alias(n) for n, c in cell_of("p_partkey").items()], "p_size", "p_retailprice", "p_partkey")
    diagonal = F.col("lat_idx") + F.col("lon_idx")
    return d.groupBy("lat_idx", "lon_idx").agg(
        F.avg(F.col("p_size") / 7.302).alias("value"),
        F.max((F.pmod(F.col("p_size"), F.lit(5)) != 0).cast("int")).alias("land"),
        F.pmod(F.max(diagonal), F.lit(3)).cast("int").alias("tvt"))


CELLS_SQL = (f"cells0 AS (SELECT {_cell_sql('p_partkey')}, p_size FROM part), "
             "cells AS (SELECT lat_idx, lon_idx, avg(p_size / 7.302) AS value, "
             "CAST(max(CASE WHEN p_size % 5 <> 0 THEN 1 ELSE 0 END) AS INT) AS land, "
             "CAST(max(lat_idx + lon_idx) % 3 AS INT) AS tvt FROM cells0 GROUP BY lat_idx, lon_idx)")


def catalog(spark, sf_dir):
    """Catalog rows from orders: model = customer group, variable = status, path = order."""
    d = table(spark, sf_dir, "orders")
    return d.select(
        F.concat(F.lit("model_"), F.pmod("o_custkey", F.lit(8)).cast("string")).alias("model"),
        F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("variable"),
        F.format_string("run_S%d_%04d.nc", F.pmod("o_orderkey", F.lit(6)), F.year("o_orderdate")).alias("path"),
        "o_orderkey", F.year("o_orderdate").alias("year"))


CATALOG_SQL = ("catalog AS (SELECT 'model_' || CAST(o_custkey % 8 AS VARCHAR) AS model, o_orderpriority AS scenario, "
               "o_orderstatus AS variable, "
               "'run_S' || CAST(o_orderkey % 6 AS VARCHAR) || '_' || CAST(year(o_orderdate) AS VARCHAR) || '.nc' AS path, "
               "o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders)")


# Log lines written from orders: each order is one line of the run its customer belongs to.
def log_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    loss = F.format_string("%.8f", F.col("o_totalprice") / 1e6)
    kind = F.pmod(k, F.lit(40))
    epoch = (F.floor(k / 400) + 1).cast("int")
    line = (F.when(k < 8, F.lit("Dataloader batches per GPU — train=10, val=2, test=2"))
            .when(kind.isin(8, 9, 10, 11, 12, 13, 14, 15), F.concat(F.lit("[Epoch "), epoch, F.lit("/90] start")))
            .when(kind.between(16, 23), F.concat(F.lit("[Validation @ batch "), F.pmod(k, F.lit(13)).cast("int"),
                                                 F.lit("] avg_loss="), loss))
            .when(kind.between(24, 27), F.concat(F.lit("x Progress — epoch "), epoch, F.lit("/90, batch "),
                                                 F.pmod(k, F.lit(10)).cast("int"), F.lit("/10, avg_batch_loss="), loss))
            .when(kind.between(28, 31), F.concat(F.lit("now avg_batch_loss="), loss))
            .when(kind.between(32, 35), F.concat(
                F.lit("2025-10-28 10:00:"), F.format_string("%02d", F.pmod(k, F.lit(60))), F.lit(",123 [INFO] Epoch average train loss="),
                loss, F.lit(", val loss="), loss, F.lit(" (val_cnt=7)")))
            .when(kind == 36, F.concat(F.lit("[Pre-flight validation] avg_loss="), loss))
            .otherwise(F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run"), F.pmod(k, F.lit(4)).cast("string")).alias("file"), k.alias("line_no"), line.alias("line"))


LOG_SQL = """lines AS (SELECT 'run' || CAST(o_orderkey % 4 AS VARCHAR) AS file, o_orderkey AS line_no,
  CASE WHEN o_orderkey < 8 THEN 'Dataloader batches per GPU — train=10, val=2, test=2'
  WHEN o_orderkey % 40 BETWEEN 8 AND 15 THEN '[Epoch ' || CAST(o_orderkey // 400 + 1 AS VARCHAR) || '/90] start'
  WHEN o_orderkey % 40 BETWEEN 16 AND 23 THEN '[Validation @ batch ' || CAST(o_orderkey % 13 AS VARCHAR) || '] avg_loss=' || printf('%.8f', o_totalprice / 1e6)
  WHEN o_orderkey % 40 BETWEEN 24 AND 27 THEN 'x Progress — epoch ' || CAST(o_orderkey // 400 + 1 AS VARCHAR) || '/90, batch ' || CAST(o_orderkey % 10 AS VARCHAR) || '/10, avg_batch_loss=' || printf('%.8f', o_totalprice / 1e6)
  WHEN o_orderkey % 40 BETWEEN 28 AND 31 THEN 'now avg_batch_loss=' || printf('%.8f', o_totalprice / 1e6)
  WHEN o_orderkey % 40 BETWEEN 32 AND 35 THEN '2025-10-28 10:00:' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ',123 [INFO] Epoch average train loss=' || printf('%.8f', o_totalprice / 1e6) || ', val loss=' || printf('%.8f', o_totalprice / 1e6) || ' (val_cnt=7)'
  WHEN o_orderkey % 40 = 36 THEN '[Pre-flight validation] avg_loss=' || printf('%.8f', o_totalprice / 1e6)
  ELSE o_orderpriority END AS line FROM orders)"""
