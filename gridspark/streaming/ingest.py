"""Incremental ingestion of field pieces, with running moments per variable.

Each micro-batch writes its rows and its partial moments below its own batch number. A
batch that is run again after a lost executor or a restart overwrites the same
partitions, so results do not depend on how often it ran.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.operators.aggregates import merge_moments, moments


def ingest_pieces(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str,
                  to_field=None, keys=("variable",), whole_years: bool = False) -> None:
    """Run all waiting pieces of ``stream`` (a readStream frame) into ``path``. How many files a
    micro-batch takes is the reader's ``maxFilesPerTrigger``.

    ``to_field`` turns raw rows of a batch into field rows (variable, year, ..., value).
    With ``whole_years`` every piece holds its (variable, year) completely, and a piece
    that comes again replaces the earlier one; otherwise pieces add up.
    """
    unit = ["variable", "year"] if whole_years else ["batch_id"]

    def sink(batch: DataFrame, batch_id: int) -> None:
        d = to_field(batch) if to_field else batch
        if not whole_years:
            d = d.withColumn("batch_id", F.lit(batch_id))

        def put(df, where, parts):
            # One file per partition where it is small, several where it is hot.
            (df.hint("rebalance", *[F.col(c) for c in parts]).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/{where}"))

        d = d.persist()  # both tables come from one evaluation of the batch
        try:
            put(d, "field", unit if whole_years else [*unit, "variable", "year"])
            put(moments(d, list(dict.fromkeys([*keys, *unit]))), "moments", unit)
        finally:
            d.unpersist()

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/field").drop("batch_id")


def running_moments(spark: SparkSession, path: str, keys=("variable",)) -> DataFrame:
    """Moments over everything ingested, from the partial moments alone."""
    return merge_moments(spark.read.parquet(f"{path}/moments"), keys)
