"""Contiguous shards of near-equal bytes from prefix sums over partition totals."""

from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions.sizing import stored

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    Rows are laid out in the order of (hash of the text, doc_id): equal texts lie side by side and
    share a shard unless a cut falls among them, and a text that fills a third of the table is cut
    into several shards like any other stretch. Rows are range-partitioned by that order and
    stored; each partition's bytes and rows are totalled, the totals' prefix sums give every
    partition its start, and sums inside a partition give every row its place. A row belongs to
    the shard in which its middle byte falls, so a shard's size differs from the equal share by no
    more than the documents at its two ends. ``slot`` counts from 0 without a gap. Size is the
    UTF-8 bytes (none for null) plus ``overhead``; a null text has a null crc32. Equal rows are
    interchangeable. No rows give no rows. The law is ``bytes``, so ``grown_shard`` is null.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
                       F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "h", "doc_id").withColumn("part", F.spark_partition_id())
    rows = stored(rows, "shard-rows")
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    starts = totals.select("part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("byte0"),
                           F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("row0"), F.sum("size").over(W.partitionBy()).alias("total"))
    inside = W.partitionBy("part").orderBy("h", "doc_id", "size")
    rows = rows.withColumns({"before": F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                             "at": F.row_number().over(inside)})
    rows = rows.join(F.broadcast(starts), "part")  # a row for each of the partitions
    middle = (F.col("byte0") + F.col("before")).cast("decimal(38,0)") * 2 + F.col("size")
    shard = F.floor(middle * shards / (F.col("total").cast("decimal(38,0)") * 2)).cast("int")
    rows = stored(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("row0") + F.col("at") - 1).alias("place")), "shard-places")
    first = rows.groupBy("shard").agg(F.min("place").alias("first"))
    return rows.join(F.broadcast(first), "shard").select(  # a row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
