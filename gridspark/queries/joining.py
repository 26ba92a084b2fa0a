"""Label alignment."""

from pyspark.sql import functions as F

from gridspark.functions.geo import HALF_DEGREE
from gridspark.functions.sizing import one_row
from gridspark.operators import aggregates as ag, joins as jn
from gridspark.operators.asof import asof_join
from gridspark.queries.registry import TILE, query, rounded
from gridspark.sources import adapters as ad

K = ad.MONTHLY_KEYS
KS = ", ".join(K)
ON = [*K, "year"]
_Y = ("source", "cell", "year")


def _two(spark, sf):
    a = ad.field(spark, sf, *_Y).withColumnRenamed("value", "label")
    b = ad.field(spark, sf, *_Y, measure="npp").withColumnRenamed("value", "predicted")
    return a, b


_TWO = f"{ad.field_sql(*_Y, name='a')}, {ad.field_sql(*_Y, measure='npp', name='b')}"


@query("j01_align_exact", f"""
WITH {_TWO} SELECT {KS}, year, round(a.value, 6) AS label, round(b.value, 6) AS predicted FROM a JOIN b USING ({KS}, year)""")
def align_exact(spark, sf):
    return rounded(jn.align_exact(*_two(spark, sf), ON), "label", "predicted")


@query("j02_align_inner", f"""
WITH {_TWO}, p AS (SELECT * REPLACE (CAST(year + 1 AS INT) AS year) FROM b)
SELECT {KS}, year, round(a.value, 6) AS label, round(p.value, 6) AS predicted FROM a JOIN p USING ({KS}, year)""")
def align_inner(spark, sf):
    a, b = _two(spark, sf)
    return rounded(jn.align_inner(a, b.withColumn("year", F.col("year") + 1), ON), "label", "predicted")


@query("j03_merge_variables", f"""
WITH {ad.field_wide_sql(*_Y)} SELECT {KS}, year, round(gpp, 6) AS gpp, round(CASE WHEN year <> 1998 THEN ra END, 6) AS ra FROM wide""")
def merge_variables(spark, sf):
    f = ad.field_vars(spark, sf, *_Y, variables=("gpp", "ra")).filter("NOT (variable = 'ra' AND year = 1998)")
    return rounded(jn.merge_variables(f, ON, ["gpp", "ra"]), "gpp", "ra")


@query("j04_reindex", f"""
WITH {ad.field_month_sql()}, y AS (SELECT DISTINCT year FROM field), ax AS (SELECT CAST(year * 100 + unnest(range(1, 13)) AS INT) AS ym FROM y),
s AS (SELECT DISTINCT {KS} FROM field), f AS (SELECT {KS}, CAST(year * 100 + month AS INT) AS ym, value FROM field)
SELECT {KS}, ym, round(value, 6) AS value FROM s CROSS JOIN ax LEFT JOIN f USING ({KS}, ym)""")
def reindex(spark, sf):
    f = ad.field_month(spark, sf).withColumn("ym", (F.col("year") * 100 + F.col("month")).cast("int"))
    span = one_row(f.agg(F.min("year").alias("a"), F.max("year").alias("b")))
    years = F.explode(F.sequence(span["a"], span["b"]))
    target = f.select(*K).distinct().withColumn("year", years).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    target = target.select(*K, (F.col("year") * 100 + F.col("month")).cast("int").alias("ym"))
    return rounded(jn.reindex(target, f.select(*K, "ym", "value"), [*K, "ym"]), "value")


@query("j05_overwrite_shared", f"""
WITH {ad.field_gaps_sql()}, s AS (SELECT {KS}, t, value * 2 AS v FROM field WHERE year BETWEEN 1997 AND 1999)
SELECT {KS}, t, round(CASE WHEN s.t IS NOT NULL THEN s.v ELSE f.value END, 6) AS value FROM (SELECT *, t AS t0 FROM field) f LEFT JOIN s USING ({KS}, t)""")
def overwrite_shared(spark, sf):
    f = ad.field_gaps(spark, sf)
    src = f.filter("year BETWEEN 1997 AND 1999").withColumn("value", F.col("value") * 2)
    return rounded(jn.overwrite_shared(f.select(*K, "t", "value"), src, [*K, "t"]), "value")


@query("j06_nearest_mask", f"""
WITH {ad.CELLS_SQL}, pts AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 20.0 - 90.0 + 0.013 AS lat, (c_custkey * 11 % 80) / 10.0 - 4.0 + 0.017 AS lon FROM customer),
i AS (SELECT c_custkey, least(359, greatest(0, CAST(floor((lat + 89.75) / 0.5 + 0.5) AS INT))) AS lat_idx,
  CAST(((CAST(floor(lon / 0.5 + 0.5) AS BIGINT) % 720) + 720) % 720 AS INT) AS lon_idx FROM pts)
SELECT c_custkey, lat_idx, lon_idx, tvt FROM i LEFT JOIN cells USING (lat_idx, lon_idx)""")
def nearest_mask(spark, sf):
    k = F.col("c_custkey")
    pts = ad.table(spark, sf, "customer").select(
        k, (F.pmod(k * 37, F.lit(3600)) / 20.0 - 90.0 + 0.013).alias("lat"), (F.pmod(k * 11, F.lit(80)) / 10.0 - 4.0 + 0.017).alias("lon"))
    d = jn.nearest_mask(pts, ad.cells(spark, sf), "lat", "lon", HALF_DEGREE, code="tvt")
    return d.select("c_custkey", "lat_idx", "lon_idx", "tvt")


@query("j07_common_time_range", f"""
WITH {ad.field_month_sql()}, r AS (SELECT source, min(t) AS lo, max(t) AS hi FROM field GROUP BY source),
c AS (SELECT max(lo) AS lo, min(hi) AS hi FROM r) SELECT source, t, round(avg(value), 6) AS value FROM field, c WHERE t BETWEEN lo AND hi GROUP BY ALL""")
def common_time_range(spark, sf):
    d = jn.crop_to_common(ad.field_month(spark, sf))
    return rounded(d.groupBy("source", "t").agg(F.avg("value").alias("value")), "value")


@query("j08_complete_groups", """
WITH g AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o,
  count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f_path,
  max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o_path, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p_path FROM orders GROUP BY ALL)
SELECT o_custkey, year, f_path AS "F", o_path AS "O", p_path AS "P" FROM g WHERE f = 1 AND o = 1 AND p = 1""")
def complete_groups(spark, sf):
    o = ad.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return jn.member_columns(o, ["o_custkey", "year"], ["F", "O", "P"], "o_totalprice", member="o_orderstatus")


@query("j09_broadcast_climatology", f"""
WITH {ad.field_month_sql()}, c AS (SELECT {KS}, month, avg(value) AS climatology FROM field GROUP BY ALL)
SELECT {KS}, year, month, round(value, 6) AS value, round(climatology, 6) AS climatology FROM field JOIN c USING ({KS}, month)""")
def broadcast_climatology(spark, sf):
    f = ad.field_month(spark, sf)
    c = ag.monthly_climatology(f, K).withColumnRenamed("value", "climatology")
    return rounded(jn.broadcast_climatology(f, c, K).drop("t"), "value", "climatology")


@query("j10_union_of_keys", f"""
WITH {ad.field_sql("source", "year")}, k AS (SELECT * FROM field WHERE NOT (source = 'M2' AND year < 1997) AND NOT (source = 'M1' AND year > 1999))
SELECT year, {", ".join(f"round(max(CASE WHEN source = 'M{i}' THEN value END), 6) AS M{i}" for i in range(4))} FROM k GROUP BY year""")
def union_of_keys(spark, sf):
    f = ad.field(spark, sf, "source", "year").filter("NOT (source = 'M2' AND year < 1997) AND NOT (source = 'M1' AND year > 1999)")
    models = ["M0", "M1", "M2", "M3"]
    return rounded(ag.report_table(f, "year", "source", models), *models)


@query("j11_insert_external", f"""
WITH {ad.field_sql("source", "year")}, x AS (SELECT CAST(year(o_orderdate) + 2 AS INT) AS year, avg(o_totalprice / 365.2425) AS external FROM orders GROUP BY 1)
SELECT source, year, round(value, 6) AS value, round(external, 6) AS external FROM field LEFT JOIN x USING (year)""")
def insert_external(spark, sf):
    x = ad.table(spark, sf, "orders").groupBy((F.year("o_orderdate") + 2).alias("year")).agg(
        F.avg(F.col("o_totalprice") / 365.2425).alias("external"))
    return rounded(jn.insert_external(ad.field(spark, sf, "source", "year"), x, ["year"], "external"), "value", "external")


@query("j12_skip_tiles", f"""
WITH {ad.field_month_sql()}, {ad.CELLS_SQL}, done AS (SELECT {TILE} AS tile_id FROM cells GROUP BY 1 HAVING avg(value) > 3.5),
f AS (SELECT *, {TILE} AS tile_id FROM field)
SELECT CAST(tile_id AS INT) AS tile_id, count(*) AS n, round(avg(value), 6) AS value FROM f WHERE tile_id NOT IN (SELECT tile_id FROM done) GROUP BY 1""")
def skip_tiles(spark, sf):
    tile = HALF_DEGREE.tile_id("lat_idx", "lon_idx")
    done = ad.cells(spark, sf).groupBy(tile.alias("tile_id")).agg(F.avg("value").alias("v")).filter("v > 3.5")
    d = jn.skip_tiles(ad.field_month(spark, sf).withColumn("tile_id", tile), done)
    return rounded(d.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")


# Irregular axes: order dates against ship dates, a third of all rows under one key.
_IRREGULAR = """a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE 'M' || CAST(o_custkey % 50 AS VARCHAR) END AS source, CAST(date_diff('day', DATE '1992-01-01', o_orderdate) AS INT) AS t FROM orders),
b AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE 'M' || CAST(l_suppkey % 50 AS VARCHAR) END AS source, CAST(date_diff('day', DATE '1992-01-01', l_shipdate) AS INT) AS t, max(l_extendedprice) AS value
  FROM lineitem WHERE l_partkey % 7 = 0 GROUP BY ALL)"""


def _irregular(spark, sf):
    day = lambda c: F.datediff(c, F.lit("1992-01-01").cast("date"))
    key = lambda row, of: F.when(F.pmod(row, F.lit(3)) == 0, "hot").otherwise(F.concat(F.lit("M"), F.pmod(of, F.lit(50)).cast("string")))
    a = ad.table(spark, sf, "orders").select("o_orderkey", key("o_orderkey", "o_custkey").alias("source"), day("o_orderdate").alias("t"))
    b = ad.table(spark, sf, "lineitem").filter(F.pmod("l_partkey", F.lit(7)) == 0).select(
        key("l_orderkey", "l_suppkey").alias("source"), day("l_shipdate").alias("t"), F.col("l_extendedprice").alias("value"))
    return a, b


@query("t19_hold_irregular", f"""
WITH {_IRREGULAR} SELECT o_orderkey, a.source, a.t, CASE WHEN a.t - b.t <= 5 THEN b.t END AS t_right, CASE WHEN a.t - b.t <= 5 THEN value END AS value FROM a ASOF LEFT JOIN b ON a.source = b.source AND a.t >= b.t""")
def hold_irregular(spark, sf):
    """The last value at or before each step, no older than five days."""
    return asof_join(*_irregular(spark, sf), "t", ["source"], "backward", tolerance=5)


@query("j04_next_on_axis", f"""
WITH {_IRREGULAR} SELECT o_orderkey, a.source, a.t, b.t AS t_right, value FROM a ASOF LEFT JOIN b ON a.source = b.source AND a.t <= b.t""")
def next_on_axis(spark, sf):
    return asof_join(*_irregular(spark, sf), "t", ["source"], "forward")


@query("j06_nearest_on_axis", f"""
WITH {_IRREGULAR}, p AS (SELECT o_orderkey, a.source, a.t, b.t AS t0, value AS v0 FROM a ASOF LEFT JOIN b ON a.source = b.source AND a.t >= b.t),
n AS (SELECT o_orderkey, b.t AS t1, value AS v1 FROM a ASOF LEFT JOIN b ON a.source = b.source AND a.t <= b.t),
h AS (SELECT *, t0 IS NOT NULL AND (t1 IS NULL OR t - t0 <= t1 - t) AS back FROM p JOIN n USING (o_orderkey))
SELECT o_orderkey, source, t, CASE WHEN back THEN t0 ELSE t1 END AS t_right, CASE WHEN back THEN v0 ELSE v1 END AS value FROM h""")
def nearest_on_axis(spark, sf):
    return asof_join(*_irregular(spark, sf), "t", ["source"], "nearest")
