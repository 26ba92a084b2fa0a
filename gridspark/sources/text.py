"""Text inputs: annual series, numbered log lines."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridspark.functions.sizing import one_row


def parse_annual_series(lines: DataFrame, text: str = "value", keep: int = 123) -> DataFrame:
    """Two-column text (year, value) to rows; the last ``keep`` years stay.

    A line that is not two numbers is left out. The year cut is relative to the last
    year, found by an aggregate over a few hundred rows.
    """
    p = F.split(F.trim(text), r"\s+")
    d = lines.select(F.try_element_at(p, F.lit(1)).try_cast("int").alias("year"),
                     F.try_element_at(p, F.lit(2)).try_cast("double").alias("value"))
    d = d.filter(F.col("year").isNotNull() & F.col("value").isNotNull())
    rn = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("year").desc()))
    return d.withColumn("__rn", rn).filter(F.col("__rn") <= keep).drop("__rn")


def read_annual_series(spark: SparkSession, path: str, keep: int = 123) -> DataFrame:
    return parse_annual_series(spark.read.text(path), keep=keep)


def series_to_cells(series: DataFrame, cells: DataFrame) -> DataFrame:
    """The same annual values on every cell; the series, a value per year, travels as one
    row and each cell opens it."""
    whole = series.agg(F.collect_list(F.struct("year", "value")).alias("s"))
    return cells.withColumn("__s", F.explode(one_row(whole)["s"])).select(*cells.columns, "__s.year", "__s.value")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzipped logs with their file and a line order.

    ``line_no`` grows with the position in the file: a text file's splits are numbered in
    order, so (partition, row) order is line order inside a file.
    """
    d = spark.read.text(path).withColumnRenamed("value", "line")
    return d.withColumns({"file": F.input_file_name(), "line_no": F.monotonically_increasing_id()})
