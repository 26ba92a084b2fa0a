"""Mixing sources to target weights: capped water-filling and seeded repetitions. DataFrame operations only."""

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions.sizing import broadcast_counted, stored
from gridspark.llm.names import free_names

WEIGHTS = (5, 2, 1)
WORD = "[^\\x20\\x09-\\x0D]+"
#: A bucket of the seeded order holds about so many rows; more rows of a source give more buckets.
BUCKET_ROWS = 2_000


def seeded_key(seed: str, *cols):
    """A 60-bit number from the md5 of the columns' text; null counts as empty."""
    text = F.concat(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def water_fill(sizes: DataFrame, max_epochs: int = 3, weights=WEIGHTS) -> DataFrame:
    """Add ``target`` to a table (source, source_size) with one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the total size;
    a target stops at ``max_epochs`` times its source's size and the excess goes to the others by
    weight until none is above. With sources ordered by size over weight the resharing ends where
    the level (what is left, over the weights left) no longer exceeds the next source's cap.
    No rows give no rows; a source without words gets 0.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumns({"weight": w, "cap": F.col("source_size") * max_epochs})
    t = t.withColumn("fill", F.col("cap") / F.col("weight"))
    before = W.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    over = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("level", left / over)
    t = t.withColumn("water", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"])
    return t.withColumn("target", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight"))).drop("cap", "fill", "level", "water")


def plan_mix(docs: DataFrame, max_epochs: int = 3, weights=WEIGHTS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, key, source_size, target, taken, whole, extra) for each row of ``docs``.

    Size is the number of words, 0 for a null or empty text. A source's target, rounded to whole
    words, is taken as whole repetitions of every document plus one further repetition in the
    seeded order of ``doc_id`` until the rest is used up; the last document of it may give a part.
    So the taken words of a source are its rounded target, and no document passes ``max_epochs``
    times its size. Equal rows share a key, so their order does not show. Null ids and sources are
    values like any other.

    Order inside a source comes from buckets of the key: their sums are combined before the
    shuffle, and only rows of one bucket are sorted together, so a source that holds a third of
    all rows is spread over tasks.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select("doc_id", "source", size.alias("size"), seeded_key(seed, "doc_id").alias("key")), "mix-sizes")
    per = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    most = per.agg(F.max("n")).first()[0] or 1
    bits = min(20, math.ceil(math.log2(most / BUCKET_ROWS))) if most > BUCKET_ROWS else 0
    rows = rows.withColumn("bucket", F.shiftright("key", 60 - bits))
    goals = water_fill(per.drop("n"), max_epochs, weights)
    goals = goals.withColumn("goal", F.floor(F.col("target") + 0.5))
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0))
    goals = goals.withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size"))
    goals = goals.withColumnRenamed("source", "s")
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base"))
    sums = sums.join(broadcast_counted(goals), F.col("source").eqNullSafe(F.col("s")))
    sums = sums.select("s", F.col("bucket").alias("b"), "base", "source_size", "target", "whole", "rest")
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(broadcast_counted(sums), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    extra = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("base") - F.col("before")))
    rows = rows.withColumn("extra", extra)
    return rows.select("doc_id", "source", "size", "key", "source_size", "target",
                       (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), "whole", "extra")


def mix_documents(docs: DataFrame, max_epochs: int = 3, weights=WEIGHTS, seed: str = "mix") -> DataFrame:
    """The mix as rows of ``docs``, each as often as its source's plan repeats it: whole
    repetitions, and one more for those in the seeded order up to the document of which the plan
    takes at least half. All columns stay. The plan comes back as one row a source (whole
    repetitions, last key), so texts are not shuffled."""
    plan = plan_mix(docs, max_epochs, weights, seed)
    whole, cut, of, times, time = free_names(docs.columns, "_whole", "_cut", "_source", "_times", "_time")
    cuts = plan.groupBy("source").agg(F.max("whole").alias(whole), F.max(F.when(
        (F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("size")), F.col("key"))).alias(cut))
    cuts = stored(cuts.withColumnRenamed("source", of), "mix-cuts")
    once_more = F.coalesce((seeded_key(seed, "doc_id") <= F.col(cut)).cast("int"), F.lit(0))
    out = docs.join(broadcast_counted(cuts), F.col("source").eqNullSafe(F.col(of)))
    out = out.withColumn(times, (F.col(whole) + once_more).cast("int")).filter(F.col(times) > 0)
    return out.withColumn(time, F.explode(F.sequence(F.lit(1), times))).select(*[docs[c] for c in docs.columns])


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
named AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM per),
levels AS (
  SELECT *, cap / w AS fill,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM named WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, fill) AS water FROM levels WHERE level <= fill),
goals AS (
  SELECT source, source_size, least(cap::DOUBLE, water * w) AS target, floor(least(cap::DOUBLE, water * w) + 0.5)::BIGINT AS goal
  FROM levels, water),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * size + greatest(0, least(size,
     goal - CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM ordered JOIN goals ON ordered.source IS NOT DISTINCT FROM goals.source
"""
