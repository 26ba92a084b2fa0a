"""Derived variables, units and balance residuals."""

from pyspark.sql import functions as F

from gridspark.functions.geo import HALF_DEGREE
from gridspark.operators import joins as jn, physics as ph
from gridspark.queries.registry import LAT, query, rounded
from gridspark.sources import adapters as ad

_Y = ("source", "cell", "year")
K = ad.MONTHLY_KEYS
KS = ", ".join(K)
_M = ("source", "cell", "year", "month")
WIDE_Y = ad.field_wide_sql(*_Y)
WIDE_M = ad.field_wide_sql(*_M)


@query("d01_total_carbon", f"""
WITH {WIDE_Y} SELECT {KS}, year, round(gpp + ra + CASE WHEN rh < 5 THEN NULL ELSE rh END, 6) AS "cTotal" FROM wide""")
def total_carbon(spark, sf):
    d = ad.field_wide(spark, sf, *_Y).withColumnsRenamed({"gpp": "cVeg", "ra": "cLitter"})
    d = d.withColumn("cSoil", F.when(F.col("rh") >= 5, F.col("rh")))
    return rounded(d.select(*K, "year", ph.total_carbon().alias("cTotal")), "cTotal")


@query("d02_difference", f"WITH {WIDE_Y} SELECT {KS}, year, round(gpp - ra, 6) AS npp FROM wide")
def difference(spark, sf):
    d = ph.difference(ad.field_wide(spark, sf, *_Y), "gpp", "ra", "npp")
    return rounded(d.select(*K, "year", "npp"), "npp")


@query("d03_net_ecosystem_exchange", f"""
WITH {ad.field_wide_sql(*_M)} SELECT {KS}, year, month, round(gpp - rh - CASE WHEN ra > 40 THEN NULL ELSE ra END, 6) AS nee FROM wide""")
def net_ecosystem_exchange(spark, sf):
    f = ad.field_vars(spark, sf, *_M, variables=("gpp", "ra", "rh")).withColumn(
        "value", F.when((F.col("variable") != "ra") | (F.col("value") <= 40), F.col("value")))
    wide = jn.merge_variables(f, [*K, "year", "month"], ["gpp", "ra", "rh"])
    d = ph.net_ecosystem_exchange(wide)
    return rounded(d.select(*K, "year", "month", "nee"), "nee")


@query("d04_potential_radiation", f"""
WITH p AS (SELECT DISTINCT {ad._cell_sql('l_suppkey')}, least(CAST(dayofyear(l_shipdate) AS INT), 365) AS doy FROM lineitem),
q AS (SELECT DISTINCT lat_idx, doy FROM p), h AS (SELECT unnest(range(1, 25)) AS hour),
b AS (SELECT lat_idx, doy, hour, greatest(0.0, sin(radians({LAT})) * sin(radians(23.45 * sin(radians((360.0 / 365.0) * (284 + doy)))))
  + cos(radians({LAT})) * cos(radians(23.45 * sin(radians((360.0 / 365.0) * (284 + doy))))) * cos(radians(15.0 * (hour - 12.0)))) AS beta FROM q, h)
SELECT lat_idx, doy, round(1.361 * 3600.0 * sum(beta * CASE WHEN hour IN (1, 24) THEN 0.5 ELSE 1.0 END), 4) AS radiation FROM b GROUP BY ALL""")
def potential_radiation(spark, sf):
    q = ad.table(spark, sf, "lineitem").select(
        ad.cell_of("l_suppkey")["lat_idx"].alias("lat_idx"),
        F.least(F.dayofyear("l_shipdate"), F.lit(365)).alias("doy")).distinct()
    return rounded(q.withColumn("radiation", ph.potential_radiation(HALF_DEGREE.lat("lat_idx"), "doy")), "radiation", n=4)


@query("d05_convert_units", """
WITH u AS (SELECT l_returnflag, l_extendedprice / 365.2425 AS value, CASE l_returnflag WHEN 'A' THEN 'g m-2 d-1' WHEN 'N' THEN 'K' ELSE 'C' END AS unit FROM lineitem)
SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'kg m-2 s-1' ELSE 'C' END AS unit,
  round(avg(CASE unit WHEN 'g m-2 d-1' THEN value * 1e6 / 86400000.0 WHEN 'K' THEN value - 273.15 ELSE value END), 6) AS value FROM u GROUP BY ALL""")
def convert_units(spark, sf):
    unit = F.when(F.col("l_returnflag") == "A", "g m-2 d-1").when(F.col("l_returnflag") == "N", "K").otherwise("C")
    to = F.when(F.col("l_returnflag") == "A", "kg m-2 s-1").otherwise("C")
    d = ad.table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 365.2425).alias("value"),
                                               unit.alias("unit"), to.alias("to_unit"))
    d = ph.convert_units(d, "unit", "to_unit")
    v = F.avg("value") * F.when(F.col("l_returnflag") == "A", 1e6).otherwise(1.0)
    return rounded(d.groupBy("l_returnflag", "unit").agg(F.avg("value").alias("v")).withColumn(
        "value", F.when(F.col("l_returnflag") == "A", F.col("v") * 1e6).otherwise(F.col("v"))).drop("v"), "value")


# One wide monthly table standing for all balance variables.
_BAL = f"""{WIDE_M}, b AS (SELECT {KS}, year, month, gpp AS mrso, ra / 1e7 AS pre, rh / 1e7 AS mrro, npp / 1e8 AS evapotrans,
  npp, gpp, ra, rh, gpp - ra - rh AS nbp, rh / 2 AS "fFire", ra / 3 AS "fLuc", gpp * 10 AS "cTotal_monthly" FROM wide)"""


def _balance(spark, sf):
    d = ad.field_wide(spark, sf, *_M)
    return d.select(*K, "year", "month", F.col("gpp").alias("mrso"), (F.col("ra") / 1e7).alias("pre"),
                    (F.col("rh") / 1e7).alias("mrro"), (F.col("npp") / 1e8).alias("evapotrans"), "npp", "gpp", "ra", "rh",
                    (F.col("gpp") - F.col("ra") - F.col("rh")).alias("nbp"), (F.col("rh") / 2).alias("fFire"),
                    (F.col("ra") / 3).alias("fLuc"), (F.col("gpp") * 10).alias("cTotal_monthly"))


def _annual(spark, sf):
    d = ad.field_wide(spark, sf, *_Y)
    return d.select(*K, "year", F.col("gpp").alias("cVeg"), F.col("ra").alias("cLitter"), F.col("rh").alias("cSoil"))


_SEC = f"{ad.LEN_SQL}[month] * 86400.0"
_LAST_MONTH = f"OVER (PARTITION BY {KS}, year ORDER BY month RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
_WATER = f"mrso - max(mrso) {_LAST_MONTH} - (pre - mrro - evapotrans) * {_SEC}"
_STOCK = f'"cTotal_monthly" - max("cTotal_monthly") {_LAST_MONTH}'
OUT = [*K, "year", "month", "residual"]


@query("d06_water_residual", f"WITH {_BAL}, r AS (SELECT *, {_WATER} AS r FROM b) SELECT {KS}, year, month, round(r, 6) AS residual FROM r WHERE month > 1")
def water_residual(spark, sf):
    return rounded(ph.water_residual(_balance(spark, sf), K).select(*OUT), "residual")


@query("d07_npp_residual", f"WITH {_BAL} SELECT {KS}, year, month, round(npp - (gpp - ra), 6) AS residual FROM b")
def npp_residual(spark, sf):
    return rounded(ph.npp_residual(_balance(spark, sf)).select(*OUT), "residual")


@query("d08_nbp_residual", f"""WITH {_BAL} SELECT {KS}, year, month, round(nbp - (npp - rh - "fFire" - "fLuc"), 6) AS residual FROM b""")
def nbp_residual(spark, sf):
    return rounded(ph.nbp_residual(_balance(spark, sf)).select(*OUT), "residual")


@query("d09_stock_flux_residual", f"WITH {_BAL}, r AS (SELECT *, {_STOCK} - nbp * {_SEC} AS r FROM b) SELECT {KS}, year, month, round(r, 2) AS residual FROM r WHERE month > 1")
def stock_flux_residual(spark, sf):
    return rounded(ph.stock_flux_residual(_balance(spark, sf), K).select(*OUT), "residual", n=2)


@query("d09_stock_flux_unintegrated", f"WITH {_BAL}, r AS (SELECT *, {_STOCK} - nbp AS r FROM b) SELECT {KS}, year, month, round(r, 6) AS residual FROM r WHERE month > 1")
def stock_flux_unintegrated(spark, sf):
    return rounded(ph.stock_flux_residual(_balance(spark, sf), K, integrate=False).select(*OUT), "residual")


_PART = f"""{_BAL}, {ad.field_wide_sql(*_Y, name="ann")}, p AS (SELECT {KS}, year, "cTotal_monthly" - (a.gpp + a.ra + a.rh) AS r FROM (SELECT * FROM b WHERE month = 12) x JOIN ann a USING ({KS}, year))"""


@query("d10_partition_residual", f"WITH {_PART} SELECT {KS}, year, round(r, 6) AS residual FROM p")
def partition_residual(spark, sf):
    d = ph.partition_residual(_balance(spark, sf), _annual(spark, sf), K)
    return rounded(d.select(*K, "year", "residual"), "residual")


@query("d11_balance_scores", f"""
WITH {_PART}, r AS (SELECT 'water_balance' AS balance, r FROM (SELECT month, {_WATER} AS r FROM b) WHERE month > 1
  UNION ALL SELECT 'npp_balance', npp - (gpp - ra) FROM b UNION ALL SELECT 'nbp_balance', nbp - (npp - rh - "fFire" - "fLuc") FROM b
  UNION ALL SELECT 'carbon_partition_december', r FROM p),
s AS (SELECT balance, avg(abs(r)) AS loss, count(r) AS n, CASE balance WHEN 'water_balance' THEN 0.5 WHEN 'npp_balance' THEN 2.0 WHEN 'nbp_balance' THEN 1.0 ELSE 0.25 END::DOUBLE AS weight FROM r GROUP BY balance)
SELECT balance, round(loss, 5) AS loss, n, weight, round(weight * loss, 5) AS weighted FROM s
UNION ALL SELECT 'TOTAL', NULL, CAST(sum(n) AS BIGINT), NULL, round(sum(weight * loss), 5) FROM s""")
def balance_scores(spark, sf):
    r = ph.balance_residuals(_balance(spark, sf), K, _annual(spark, sf))
    d = ph.balance_scores(r, {"water_balance": 0.5, "npp_balance": 2.0, "nbp_balance": 1.0, "carbon_partition_december": 0.25}, loss="mae")
    return rounded(d, "loss", "weighted", n=5)


@query("d12_bias", f"""WITH {WIDE_Y} SELECT {KS}, year, round(npp - gpp, 6) AS bias FROM wide""")
def bias(spark, sf):
    f = ad.field_vars(spark, sf, *_Y, variables=("gpp", "npp"))
    f = f.withColumn("role", F.when(F.col("variable") == "gpp", "Label").otherwise("Predicted"))
    return rounded(ph.bias(f, [*K, "year"]), "bias")


@query("d13_split_role", """
WITH n AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Label_' WHEN 'O' THEN 'Predicted_' ELSE 'other' END || CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'O' THEN 'x' ELSE o_orderpriority END AS name FROM orders),
s AS (SELECT name, nullif(regexp_extract(name, '^(Label|Predicted|Bias)_(.+)$', 1), '') AS role, nullif(regexp_extract(name, '^(Label|Predicted|Bias)_(.+)$', 2), '') AS suffix FROM n),
k AS (SELECT suffix FROM s WHERE role IS NOT NULL GROUP BY suffix HAVING count(DISTINCT role) = 2)
SELECT name, role, s.suffix, s.suffix IN (SELECT suffix FROM k) AS complete, count(*) AS n FROM s GROUP BY ALL""")
def split_role(spark, sf):
    first = F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "O")
    name = F.concat(F.when(F.col("o_orderstatus") == "F", "Label_").when(F.col("o_orderstatus") == "O", "Predicted_").otherwise("other"),
                    F.when(first, "x").otherwise(F.col("o_orderpriority")))
    d = ph.split_role(ad.table(spark, sf, "orders").select(name.alias("name")))
    d = d.groupBy("name", "role", "suffix").agg(F.count(F.lit(1)).alias("n"))
    ok = ph.complete_roles(d).withColumn("c", F.lit(True))
    d = d.join(ok, "suffix", "left")
    return d.withColumn("complete", F.when(F.col("suffix").isNotNull(), F.coalesce("c", F.lit(False)))).drop("c")
