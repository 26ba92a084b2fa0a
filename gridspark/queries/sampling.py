"""Samples, top-k, assignment and set operations."""

from pyspark.sql import functions as F

from gridspark.operators import sampling as sa, scores as sc
from gridspark.queries.registry import hash_sql, query, rounded
from gridspark.sources import adapters as ad

_ID = ["l_orderkey", "l_linenumber", "l_suppkey", "y"]


_DRAW_ID = ("l_orderkey", "l_linenumber", "l_suppkey", "cents")


@query("q01_uniform_sample", f"""
WITH {ad.PAIRS_SQL}, c AS (SELECT *, CAST(round(y * 100) AS BIGINT) AS cents FROM pairs)
SELECT variable, l_orderkey, l_linenumber, l_suppkey, y, yhat FROM c
QUALIFY row_number() OVER (PARTITION BY variable ORDER BY {hash_sql(*_DRAW_ID, seed=123)}, {", ".join(_DRAW_ID)}) <= 1000""")
def uniform_sample(spark, sf):
    """1000 pairs per variable by seeded hash."""
    d = ad.pairs(spark, sf).withColumn("cents", F.round(F.col("y") * 100).cast("long"))
    return sa.uniform_sample(d, ["variable"], _DRAW_ID, 1000, seed=123).select("variable", *_ID, "yhat")


@query("q01_keyed_sample", f"""
WITH {ad.PAIRS_SQL}, k AS (SELECT *, (l_orderkey * 7919 + l_linenumber * 31) % 10007 AS k FROM pairs)
SELECT variable, k, l_orderkey, l_linenumber, l_suppkey, y, yhat FROM k QUALIFY row_number() OVER (PARTITION BY variable ORDER BY k, l_orderkey, l_linenumber, l_suppkey, y, yhat) <= 500""")
def keyed_sample(spark, sf):
    k = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31, F.lit(10007))
    d = ad.pairs(spark, sf).withColumn("k", k)
    d = sa.keyed_sample(d, ["variable"], ["k", *_ID, "yhat"], 500)
    return d.select("variable", "k", *_ID, "yhat")


def _regions_sql(region: str) -> str:
    """The first 1000 of a large region; of a small one 1000 draws, each hashed to a position."""
    return f"""
SELECT '{region}' AS regions, region, lat_idx, lon_idx, CAST(pos AS INT) AS draw FROM {region}_r WHERE m >= 1000 AND pos <= 1000
UNION ALL SELECT '{region}', region, lat_idx, lon_idx, CAST(d AS INT) FROM {region}_r, (SELECT unnest(range(1, 1001)) AS d) WHERE m < 1000 AND pos = {hash_sql("region", "d", seed=7)} % m + 1"""


def _ranked_sql(region: str) -> str:
    return (f"{region}_r AS (SELECT {region} AS region, lat_idx, lon_idx, count(*) OVER (PARTITION BY {region}) AS m, "
            f"row_number() OVER (PARTITION BY {region} ORDER BY {hash_sql('lat_idx', 'lon_idx', seed=7)}, lat_idx, lon_idx) AS pos FROM cells)")


@query("q02_sample_per_region", f"""
WITH {ad.CELLS_SQL}, {_ranked_sql("tvt")}, {_ranked_sql("land")} {_regions_sql("tvt")} UNION ALL {_regions_sql("land")}""")
def sample_per_region(spark, sf):
    c = ad.cells(spark, sf)
    parts = [sa.sample_per_region(c, r, ["lat_idx", "lon_idx"], 1000, seed=7).select(
        F.lit(r).alias("regions"), F.col(r).alias("region"), "lat_idx", "lon_idx", "draw") for r in ("tvt", "land")]
    return sa.concatenate(parts)


@query("q03_sample_fraction", f"""
SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {hash_sql("o_orderkey", seed=3)}, o_orderkey) <= greatest(1, round(count(*) OVER () * 0.1))""")
def sample_fraction(spark, sf):
    return sa.sample_fraction(ad.table(spark, sf, "orders"), ["o_orderkey"], 0.1, seed=3).select("o_orderkey")


@query("q04_top_k_latest", """
WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT o_custkey, o_orderkey, o_totalprice FROM l ORDER BY o_totalprice, o_custkey LIMIT 4""")
def top_k_latest(spark, sf):
    return sa.top_k_latest(ad.table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 4).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("q05_best_row", """
SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) = 1""")
def best_row(spark, sf):
    return sa.best_row(ad.table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"])


@query("q06_first_step", f"""
WITH {ad.field_month_sql()} SELECT source, lat_idx, lon_idx, t, round(value, 6) AS value FROM field QUALIFY t = min(t) OVER (PARTITION BY source)""")
def first_step(spark, sf):
    d = sa.first_step(ad.field_month(spark, sf), ["source"])
    return rounded(d.select("source", "lat_idx", "lon_idx", "t", "value"), "value")


@query("q07_round_robin", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INT) AS shard FROM orders")
def round_robin(spark, sf):
    return sa.round_robin(ad.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("q07_contiguous_blocks", """
SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // CAST(ceil(count(*) OVER () / 7.0) AS BIGINT) AS INT) AS shard FROM orders""")
def contiguous_blocks(spark, sf):
    return sa.contiguous_blocks(ad.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("u01_concatenate", f"""
WITH {ad.field_sql("source", "cell", "year")}, n AS (SELECT 'N' || source AS source, lat_idx, lon_idx, year + 7 AS year, value FROM field), u AS (SELECT * FROM field UNION ALL SELECT * FROM n)
SELECT source, CAST(year AS INT) AS year, count(*) AS n, round(avg(value), 6) AS value FROM u GROUP BY ALL""")
def concatenate(spark, sf):
    f = ad.field(spark, sf, "source", "cell", "year")
    later = f.withColumns({"source": F.concat(F.lit("N"), "source"), "year": F.col("year") + 7})
    d = sa.concatenate([f, later]).groupBy("source", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    return rounded(d, "value")


@query("u02_tag_and_append", """
SELECT 'orders' AS experiment, o_orderstatus AS model, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'lines', l_linestatus, count(*) FROM lineitem GROUP BY ALL""")
def tag_and_append(spark, sf):
    o = ad.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    l = ad.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return sc.tag_and_append({"orders": o, "lines": l})


@query("u03_common_values", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_values(spark, sf):
    c = ad.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    s = ad.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return sa.common_values(c, s, "nation")


@query("u04_wanted_minus_present", """
SELECT c_custkey AS custkey, status FROM customer, (SELECT unnest(['F', 'O', 'P']) AS status) EXCEPT SELECT o_custkey, o_orderstatus FROM orders""")
def wanted_minus_present(spark, sf):
    every = F.explode(F.array(*[F.lit(s) for s in "FOP"])).alias("status")
    w = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), every)
    p = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"))
    return sa.wanted_minus_present(w, p, ["custkey", "status"])


@query("u05_first_of_flagged", """
WITH f AS (SELECT o_orderkey, o_orderpriority, o_custkey % 25 AS region, o_orderstatus = 'F' AS flag FROM orders)
SELECT o_orderkey, o_orderpriority, region, flag FROM f WHERE NOT flag
UNION ALL (SELECT * FROM f WHERE flag QUALIFY row_number() OVER (PARTITION BY o_orderpriority, region ORDER BY o_orderkey) = 1)""")
def first_of_flagged(spark, sf):
    d = ad.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.pmod("o_custkey", F.lit(25)).alias("region"),
                                             (F.col("o_orderstatus") == "F").alias("flag"))
    return sc.first_of_flagged(d, ["o_orderpriority", "region"], F.col("flag"), ["o_orderkey"])


@query("u06_stitch_runs", """
WITH r AS (SELECT o_custkey AS epoch, o_orderkey AS ts, o_totalprice AS loss, o_orderstatus AS run FROM orders)
SELECT epoch, ts, loss, run FROM r QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY ts DESC) = 1""")
def stitch_runs(spark, sf):
    o = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("epoch"), F.col("o_orderkey").alias("ts"),
                                             F.col("o_totalprice").alias("loss"), F.col("o_orderstatus").alias("run"))
    runs = sa.concatenate([o.filter(F.col("run") == s) for s in "FOP"])
    return sc.stitch_runs(runs)
