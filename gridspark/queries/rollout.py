"""Carried-state scoring and counterfactual offsets."""

import pandas as pd
from pyspark.sql import functions as F

from gridspark.functions.sizing import stored
from gridspark.operators import aggregates as ag, rollout as ro
from gridspark.operators.apply import apply_series, apply_steps
from gridspark.operators.resume import rollout_resumable
from gridspark.queries.registry import query, rounded
from gridspark.session import scratch_path
from gridspark.sources import adapters as ad

K = ad.MONTHLY_KEYS
KS = ", ".join(K)
FM = ad.field_month_sql()
FY = ad.field_sql("source", "cell", "year")
_Y = ("source", "cell", "year")

_AFFINE = f"""
x AS (SELECT {KS}, year, value, row_number() OVER (PARTITION BY {KS} ORDER BY year) AS i FROM field),
r(source, lat_idx, lon_idx, i, year, state) AS (SELECT {KS}, i, year, 0.7 * 5.0 + 0.3 * value FROM x WHERE i = 1
  UNION ALL SELECT x.source, x.lat_idx, x.lon_idx, x.i, x.year, 0.7 * r.state + 0.3 * x.value FROM r JOIN x ON x.source = r.source AND x.lat_idx = r.lat_idx AND x.lon_idx = r.lon_idx AND x.i = r.i + 1)"""


@query("r01_rollout_affine", f"WITH RECURSIVE {FY}, {_AFFINE} SELECT {KS}, year, round(state, 6) AS state FROM r")
def rollout_affine(spark, sf):
    return rounded(ro.rollout_affine(ad.field(spark, sf, *_Y), K, 0.7, 0.3, initial=5.0), "state")


def _predict(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"soil": 0.7 * frame["soil"] + 0.3 * frame["value"]})


@query("r01_rollout_predictor", f"WITH RECURSIVE {FY}, {_AFFINE} SELECT {KS}, year, CAST(1 AS INT) AS month, round(state, 6) AS soil FROM r")
def rollout_predictor(spark, sf):
    """The same recursion through a caller's predictor, one step a year."""
    f = ad.field(spark, sf, *_Y).withColumn("month", F.lit(1))
    return rounded(ro.rollout(f, ["source"], _predict, {"soil": "annual"}, ["soil"], initial=5.0), "soil")


# A cell starts from its own forcing, its states are nudged inside the loop, and years with a gap are skipped.
_NUDGE_TO = {"soil": (30.0, 12.0), "leaf": (20.0, 8.0)}


def _predict_two(frame: pd.DataFrame) -> pd.DataFrame:
    v, soil, leaf = frame["value"], frame["soil"], frame["leaf"]
    return pd.DataFrame({"soil": 0.6 * soil + 0.4 * v, "leaf": 0.5 * leaf + 0.5 * v, "gpp": v - 0.1 * soil + 0.05 * leaf})


def _pinned_sql(carry: str) -> str:
    """Year by year: ``s`` and ``l`` are what the states hand on, ``bad`` marks a skipped year."""
    yearly = carry == "annual"
    handed = "avg(v)" if yearly else "avg(CASE WHEN month = 12 THEN v END)"
    needs = "r.l IS NULL" if yearly else "(y.jan AND r.l IS NULL)"
    skip = f"(y.gap OR r.s IS NULL OR {needs})"
    leaf_in = "p.l" if yearly else "CASE WHEN month = 1 THEN p.l ELSE 0 END"
    leaf_out = "20 + 0.8 * (0.5 * r.l + 0.5 * y.vl - 20)" if yearly else "20 + 0.8 * (0.5 * y.vl - 20)"
    return f"""WITH RECURSIVE {FM}, g AS (SELECT {KS}, year, month, CASE WHEN value < 260 THEN value END AS v FROM field),
y AS (SELECT {KS}, year, row_number() OVER (PARTITION BY {KS} ORDER BY year) AS i, bool_or(v IS NULL) AS gap, bool_or(month = 1) AS jan, avg(v) AS v, {handed} AS vl FROM g GROUP BY {KS}, year),
r(source, lat_idx, lon_idx, i, year, bad, s, l) AS (SELECT {KS}, i, year, gap, 2 * v, 3 * vl FROM y WHERE i = 1
  UNION ALL SELECT {KS}, y.i, y.year, {skip}, CASE WHEN NOT {skip} THEN 30 + 0.8 * (0.6 * r.s + 0.4 * y.v - 30) END, CASE WHEN NOT {skip} THEN {leaf_out} END
  FROM r JOIN y USING ({KS}) WHERE y.i = r.i + 1),
x AS (SELECT {KS}, g.year, month, v, r.i, bad, CASE WHEN r.i = 1 THEN 2 * v ELSE p.s END AS s, CASE WHEN r.i = 1 THEN 3 * v ELSE {leaf_in} END AS l
  FROM g JOIN r USING ({KS}, year) LEFT JOIN (SELECT {KS}, i + 1 AS i, s, l FROM r) p USING ({KS}, i))
SELECT {KS}, year, month, round(CASE WHEN i = 1 THEN s WHEN NOT bad THEN 30 + 0.8 * (0.6 * s + 0.4 * v - 30) END, 6) AS soil,
  round(CASE WHEN i = 1 THEN l WHEN NOT bad THEN 20 + 0.8 * (0.5 * l + 0.5 * v - 20) END, 6) AS leaf, round(CASE WHEN NOT bad THEN v - 0.1 * s + 0.05 * l END, 6) AS gpp FROM x"""


def _pinned_forcing(spark, sf):
    f = ad.field_month(spark, sf).withColumn("value", F.when(F.col("value") < 260, F.col("value")))
    return f.withColumns({"soil0": F.col("value") * 2, "leaf0": F.col("value") * 3})


_PINNED = dict(keys=["source"], predict=_predict_two, states={"soil": "annual", "leaf": "monthly"}, outputs=["soil", "leaf", "gpp"],
               start={"soil": "soil0", "leaf": "leaf0"}, complete=["value"], nudging=ro.Nudging(_NUDGE_TO, 0.2), split=2)


def _pinned(spark, sf, carry):
    return rounded(ro.rollout(_pinned_forcing(spark, sf), carry=carry, **_PINNED), "soil", "leaf", "gpp")


@query("r01_rollout_pinned_annual", _pinned_sql("annual"))
def rollout_pinned_annual(spark, sf):
    return _pinned(spark, sf, "annual")


@query("r01_rollout_pinned_december", _pinned_sql("december"))
def rollout_pinned_december(spark, sf):
    return _pinned(spark, sf, "december")


@query("r01_rollout_resumed", _pinned_sql("december"))
def rollout_resumed(spark, sf):
    """A run that ended after 1994 goes on from its stored states, in blocks of three years."""
    path = scratch_path(spark, "rollout")
    f = stored(_pinned_forcing(spark, sf), "forcing")  # read by both runs and by every block
    rollout_resumable(f, path, carry="december", block_years=3, until=1994, **_PINNED)
    return rounded(rollout_resumable(f, path, carry="december", block_years=3, **_PINNED), "soil", "leaf", "gpp")


@query("r02_carry_annual_mean", f"""
WITH {FM}, p AS (SELECT {KS}, year + 1 AS year, avg(value) AS state FROM field GROUP BY ALL)
SELECT {KS}, year, month, round(state, 6) AS state FROM field LEFT JOIN p USING ({KS}, year)""")
def carry_annual_mean(spark, sf):
    d = ro.carry_annual_mean(ad.field_month(spark, sf), K)
    return rounded(d.select(*K, "year", "month", "state"), "state")


def _december_sql(rest):
    state = "CASE WHEN source IN ('M0', 'M1') THEN CASE WHEN month = 1 THEN d ELSE " + rest + " END ELSE a END"
    return (f"WITH {FM}, p AS (SELECT {KS}, year + 1 AS year, avg(CASE WHEN month = 12 THEN value END) AS d, avg(value) AS a FROM field GROUP BY ALL) "
            f"SELECT {KS}, year, month, round({'coalesce(' + state + ', 0)' if rest == '0' else state}, 6) AS state FROM field LEFT JOIN p USING ({KS}, year)")


def _kinds(spark, sf):
    kind = F.when(F.col("source").isin("M0", "M1"), "monthly").otherwise("annual")
    return ad.field_month(spark, sf).withColumn("kind", kind)


@query("r03_carry_december", _december_sql("0"))
def carry_december(spark, sf):
    return rounded(ro.carry_december(_kinds(spark, sf), K).select(*K, "year", "month", "state"), "state")


@query("r03_carry_december_training", _december_sql("NULL"))
def carry_december_training(spark, sf):
    return rounded(ro.carry_december(_kinds(spark, sf), K, rest=None).select(*K, "year", "month", "state"), "state")


@query("r04_states_from_forcing", f"""
WITH {FM}, p AS (SELECT {KS}, year + 1 AS year, month, value AS pv FROM field), f AS (SELECT *, min(year) OVER (PARTITION BY {KS}) AS y0 FROM field)
SELECT {KS}, year, month, round(coalesce(CASE WHEN year = y0 THEN value ELSE pv END, 0), 6) AS state FROM f LEFT JOIN p USING ({KS}, year, month)""")
def states_from_forcing(spark, sf):
    return rounded(ro.states_from_forcing(ad.field_month(spark, sf), K).select(*K, "year", "month", "state"), "state")


@query("r05_seed_states", f"""
WITH {ad.field_vars_sql("cell", "year", "month", variables=("gpp", "ra"))}, s AS (SELECT variable, lat_idx, lon_idx, month, value AS sv FROM field WHERE variable = 'ra' AND year = 1998)
SELECT variable, lat_idx, lon_idx, year, month, round(CASE WHEN sv IS NOT NULL THEN sv ELSE value END, 6) AS value FROM field LEFT JOIN s USING (variable, lat_idx, lon_idx, month)""")
def seed_states(spark, sf):
    f = ad.field_vars(spark, sf, "cell", "year", "month", variables=("gpp", "ra"))
    d = ro.seed_states(f, ["variable", "lat_idx", "lon_idx"], ["ra"], 1998, value="value")
    return rounded(d.select("variable", "lat_idx", "lon_idx", "year", "month", "value"), "value")


@query("r06_carry_months", f"""
WITH RECURSIVE {FM}, x AS (SELECT {KS}, year, month, value, row_number() OVER (PARTITION BY {KS}, year ORDER BY month) AS i, avg(value) OVER (PARTITION BY {KS}) AS s0 FROM field),
r(source, lat_idx, lon_idx, year, month, i, state) AS (SELECT {KS}, year, month, i, 0.5 * s0 + value FROM x WHERE i = 1
  UNION ALL SELECT x.source, x.lat_idx, x.lon_idx, x.year, x.month, x.i, 0.5 * r.state + x.value FROM r JOIN x ON x.source = r.source AND x.lat_idx = r.lat_idx AND x.lon_idx = r.lon_idx AND x.year = r.year AND x.i = r.i + 1)
SELECT {KS}, year, month, round(state, 6) AS state FROM r""")
def carry_months(spark, sf):
    f = ad.field_month(spark, sf)
    start = f.groupBy(*K).agg(F.avg("value").alias("start"))
    return rounded(ro.carry_months(f.join(start, K), K, 0.5), "state")


_NUDGES = ("original", "z_shrink", "z_mirror", "z_adaptive")
_Z = "((value - mean) / std)"
_NUDGE_SQL = {
    "original": f"mean + (0.3 * std - {_Z}) * std",
    "z_shrink": f"mean + 0.7 * {_Z} * std",
    "z_mirror": f"mean + greatest(-3.0, least(3.0, {_Z})) * std",
    "z_adaptive": f"mean + CASE WHEN abs({_Z}) <= 3 THEN 0.7 * {_Z} ELSE sign({_Z}) * (3.0 - (3.0 - abs({_Z})) * 0.7) END * std",
}


@query("r07_nudge_states", f"""
WITH {ad.field_vars_sql("source", "scenario", "cell", "year")}, st AS (SELECT variable, avg(value) AS mean, stddev_pop(value) AS std FROM field GROUP BY ALL)
""" + " UNION ALL ".join(f"SELECT '{m}' AS mode, variable, source, scenario, lat_idx, lon_idx, year, round(CASE WHEN variable IN ('gpp', 'ra') THEN {_NUDGE_SQL[m]} ELSE value END, 4) AS value FROM field JOIN st USING (variable)" for m in _NUDGES))
def nudge_states(spark, sf):
    f = ad.field_vars(spark, sf, "source", "scenario", "cell", "year")
    st = ag.finish_moments(ag.moments(f))
    return rounded(ro.nudge_by_modes(f, st, ["gpp", "ra"], 0.3, _NUDGES), "value", n=4)


SPEC = "monthly:pre=-20%, annual:lai=0.5,spfh=-20%,weekly:tmp=2,monthly:tmp=x, monthly:tmp=-3,monthly:pre=-50%"
_FORCING = ("CASE l_returnflag WHEN 'A' THEN 'pre' WHEN 'N' THEN 'tmp' ELSE 'lai' END")


@query("r08_apply_offsets", f"""
WITH f AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'annual' ELSE 'monthly' END AS scope, {_FORCING} AS variable, l_suppkey, CAST(year(l_shipdate) AS INT) AS year, avg(l_extendedprice / 365.2425) - 100 AS value FROM lineitem GROUP BY ALL)
SELECT scope, variable, l_suppkey, year, round(CASE variable WHEN 'pre' THEN greatest(value * 0.5, 0) WHEN 'tmp' THEN value - 3 ELSE greatest(value + 0.5, 0) END, 6) AS value FROM f""")
def apply_offsets(spark, sf):
    v = F.when(F.col("l_returnflag") == "A", "pre").when(F.col("l_returnflag") == "N", "tmp").otherwise("lai")
    scope = F.when(F.col("l_returnflag") == "R", "annual").otherwise("monthly")
    f = ad.table(spark, sf, "lineitem").groupBy(scope.alias("scope"), v.alias("variable"), "l_suppkey", F.year("l_shipdate").alias("year")).agg(
        (F.avg(F.col("l_extendedprice") / 365.2425) - 100).alias("value"))
    rules = ro.parse_offsets(spark.createDataFrame([(SPEC,)], "spec string"))
    return rounded(ro.apply_offsets(f, rules), "value")


@query("r09_parse_offsets", """
WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'daily:' WHEN 'O' THEN 'Monthly: ' ELSE '' END || 'pre=' || CAST(o_custkey % 50 - 25 AS VARCHAR) || CASE WHEN o_custkey % 2 = 0 THEN '%' ELSE '' END AS e1,
  CASE WHEN o_orderkey % 3 = 0 THEN 'annual:lai=1.5' ELSE 'weekly:tmp=2' END AS e2, o_orderstatus, o_custkey FROM orders)
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'daily' ELSE 'monthly' END AS scope, 'pre' AS variable, CASE WHEN o_custkey % 2 = 0 THEN 'percent' ELSE 'add' END AS mode, CAST(o_custkey % 50 - 25 AS DOUBLE) AS value
FROM s WHERE o_orderstatus IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'annual', 'lai', 'add', 1.5 FROM s WHERE o_orderkey % 3 = 0""")
def parse_offsets(spark, sf):
    o = ad.table(spark, sf, "orders")
    scope = F.when(F.col("o_orderstatus") == "F", "daily:").when(F.col("o_orderstatus") == "O", "Monthly: ").otherwise("")
    number = (F.pmod("o_custkey", F.lit(50)) - 25).cast("string")
    sign = F.when(F.pmod("o_custkey", F.lit(2)) == 0, "%").otherwise("")
    second = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "annual:lai=1.5").otherwise("weekly:tmp=2")
    specs = o.select("o_orderkey", F.concat(scope, F.lit("pre="), number, sign, F.lit(" , "), second).alias("spec"))
    return ro.parse_offsets(specs, keys=["o_orderkey"])


@query("r10_offset_sweeps", f"""
WITH {ad.field_sql("source", "year")}, t AS (SELECT unnest(range(-5, 6)) AS o), p AS (SELECT -10 * unnest(range(0, 11)) AS o)
SELECT 'tmp' AS variable, source, year, CAST(o AS DOUBLE) AS "offset", round(value + o, 6) AS value FROM field, t
UNION ALL SELECT 'pre', source, year, CAST(o AS DOUBLE), round(greatest(value * (1 + o / 100.0), 0), 6) FROM field, p""")
def offset_sweeps(spark, sf):
    f = ad.field(spark, sf, "source", "year")
    t = ro.sweep_offsets(f.withColumn("variable", F.lit("tmp")), "tmp", ro.TEMPERATURE_SWEEP, "add")
    p = ro.sweep_offsets(f.withColumn("variable", F.lit("pre")), "pre", ro.PRECIPITATION_SWEEP, "percent")
    return rounded(t.unionByName(p), "value")


def _cumulative(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(value=frame["value"].cumsum())[[*K, "t", "value"]]


@query("ud01_apply_series", f"""
WITH {FM}, k AS (SELECT *, value * 2 AS v2 FROM field)
SELECT {KS}, t, round(sum(v2) OVER (PARTITION BY {KS} ORDER BY t), 5) AS value FROM k""")
def apply_series_query(spark, sf):
    steps = [lambda d: d.withColumn("value", F.col("value") * 2),
             lambda d: apply_series(d, K, _cumulative, "source string, lat_idx int, lon_idx int, t int, value double")]
    return rounded(apply_steps(ad.field_month(spark, sf), steps), "value", n=5)
