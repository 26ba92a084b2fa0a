"""Incremental ingestion."""

from pyspark.sql import functions as F

from gridspark.queries.registry import query, rounded
from gridspark.session import scratch_path
from gridspark.sources import adapters as ad
from gridspark.streaming import ingest, pieces


def _ingested(spark, sf, name):
    """Run the lineitem file through the stream as field rows of two variables."""
    schema = ad.table(spark, sf, "lineitem").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").option("maxFilesPerTrigger", 1_000).parquet(sf)

    def to_field(batch):
        d = batch.select("l_suppkey", F.year("l_shipdate").alias("year"), (F.col("l_extendedprice") / 365.2425).alias("gpp"),
                         (F.col("l_quantity") / 7.302).alias("lai"))
        return d.unpivot(["l_suppkey", "year"], ["gpp", "lai"], "variable", "value")

    path = scratch_path(spark, name)
    ingest.ingest_pieces(spark, stream, f"{path}/table", f"{path}/checkpoint", to_field)
    return f"{path}/table"


_FIELD = """f AS (SELECT 'gpp' AS variable, CAST(year(l_shipdate) AS INT) AS year, l_extendedprice / 365.2425 AS value FROM lineitem
  UNION ALL SELECT 'lai', CAST(year(l_shipdate) AS INT), l_quantity / 7.302 FROM lineitem)"""


@query("st01_ingest_pieces", f"WITH {_FIELD} SELECT variable, year, count(*) AS n, round(avg(value), 6) AS value FROM f GROUP BY ALL")
def ingest_pieces(spark, sf):
    d = ingest.read_ingested(spark, _ingested(spark, sf, "st01"))
    return rounded(d.groupBy("variable", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), "value")


@query("st01_running_moments", f"""
WITH {_FIELD} SELECT variable, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM f GROUP BY ALL""")
def running_moments(spark, sf):
    d = ingest.running_moments(spark, _ingested(spark, sf, "st01m"))
    return rounded(rounded(d.select("variable", "n", "mean", "std", "min", "max"), "mean", "min", "max"), "std", n=4)


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _editions(wave, path):
    """One file holds an edition whole. Editions that share a task have writers of their own, so their
    rows pass through it and are not sorted in its memory first."""
    spark = wave.sparkSession
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, 20)
    try:
        wave.repartition("version", "piece").write.mode("append").partitionBy("version", "piece").parquet(path)
    finally:
        spark.conf.set(_WRITERS, before)


@query("st01_keyed_moments", """
WITH p AS (SELECT l_orderkey % 6 AS piece, CAST(year(l_shipdate) AS INT) AS year, l_extendedprice / 365.2425 AS gpp, l_quantity / 7.302 AS lai FROM lineitem),
f AS (SELECT 'gpp' AS variable, piece, year, gpp AS value FROM p UNION ALL SELECT 'lai', piece, year, lai FROM p),
k AS (SELECT variable, year, CASE WHEN piece < 2 THEN 2 * value ELSE value END AS value FROM f WHERE piece >= 2 OR year < 1996)
SELECT variable, year, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM k GROUP BY ALL""")
def keyed_moments(spark, sf):
    """Six pieces; then two of them anew, doubled and without their later years, and one again as it was."""
    d = ad.table(spark, sf, "lineitem").select((F.pmod("l_orderkey", F.lit(6))).cast("int").alias("piece"), F.year("l_shipdate").alias("year"),
                                               (F.col("l_extendedprice") / 365.2425).alias("gpp"), (F.col("l_quantity") / 7.302).alias("lai"))
    d = d.unpivot(["piece", "year"], ["gpp", "lai"], "variable", "value")
    path = scratch_path(spark, "pieces")
    schema = "year int, variable string, value double, version long, piece int"
    again = d.filter("piece < 2 AND year < 1996").withColumns({"value": 2 * F.col("value"), "version": F.lit(2)}).unionByName(
        d.filter("piece = 2").withColumn("version", F.lit(1)))
    for wave in (d.withColumn("version", F.lit(1)), again):
        _editions(wave, f"{path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
        pieces.keyed_moments(stream, f"{path}/out", f"{path}/checkpoint")
    out = pieces.current_moments(spark, f"{path}/out").select("variable", "year", "n", "mean", "std", "min", "max")
    return rounded(rounded(out, "mean", "min", "max"), "std", n=4)
