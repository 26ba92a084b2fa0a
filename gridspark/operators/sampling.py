"""Samples, top-k, assignment to groups and set operations."""

from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions.ranking import hash_key, hash_smallest, ordered_rank, smallest_k
from gridspark.functions.sizing import broadcast_counted, stored


def uniform_sample(df: DataFrame, keys, id_cols, k: int, seed: int = 0) -> DataFrame:
    """Uniform sample of k rows per key: the k smallest seeded hashes of the row ids."""
    return hash_smallest(df, keys, id_cols, lambda total: F.lit(k), seed)


def keyed_sample(df: DataFrame, keys, order, k: int) -> DataFrame:
    """k rows per key in the order of given sampling keys."""
    return smallest_k(df, keys, order, k).drop("rn")


def sample_per_region(df: DataFrame, region: str, id_cols, n: int, seed: int = 0) -> DataFrame:
    """n rows per region: without replacement where the region is large enough, otherwise
    n independent draws with replacement. Only the n chosen rows of a region are ranked."""
    chosen = hash_smallest(df, [region], id_cols, lambda total: F.lit(n), seed)
    every = W.partitionBy(region)
    ranked = (chosen.withColumn("__h", hash_key(*id_cols, seed=seed))
              .withColumns({"draw": F.row_number().over(every.orderBy("__h", *id_cols)),
                            "__n": F.count(F.lit(1)).over(every)}).drop("__h"))
    large = ranked.filter(F.col("__n") == n)
    small = ranked.filter(F.col("__n") < n)
    draws = (small.groupBy(region).agg(F.max("__n").alias("__m"))
             .withColumn("__d", F.explode(F.sequence(F.lit(1), F.lit(n))))
             .withColumn("draw", (F.pmod(hash_key(region, "__d", seed=seed), F.col("__m")) + 1).cast("int")))
    again = small.join(draws, [region, "draw"]).withColumn("draw", F.col("__d"))
    cols = [*df.columns, "draw"]
    return large.select(*cols).unionByName(again.select(*cols))


def sample_fraction(df: DataFrame, id_cols, fraction: float, seed: int = 0, keys=()) -> DataFrame:
    """Exactly round(fraction * N) rows, at least one, in a seeded random order."""
    return hash_smallest(df, keys, id_cols, lambda n: F.greatest(F.lit(1), F.round(n * fraction)), seed)


def top_k_latest(df: DataFrame, key: str, latest: str, value: str, k: int, ascending: bool = True) -> DataFrame:
    """Best k rows by value after keeping the latest row of each key."""
    rest = [c for c in df.columns if c != key]
    last = (df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(latest)).alias("__r")).select(key, "__r.*"))
    order = F.col(value).asc() if ascending else F.col(value).desc()
    return last.orderBy(order, key).limit(k)


def best_row(df: DataFrame, keys, value: str, columns) -> DataFrame:
    """Columns of the row with the smallest value per key."""
    agg = F.min_by(F.struct(*columns), F.col(value)).alias("__r")
    d = df.groupBy(*keys).agg(agg, F.min(value).alias(value)) if keys else df.agg(agg, F.min(value).alias(value))
    return d.select(*keys, value, "__r.*")


def first_step(df: DataFrame, keys, t: str = "t") -> DataFrame:
    """Rows of the first time step per key; the table of first steps is stored and
    measured, so the field is filtered where it lies."""
    lo = stored(df.groupBy(*keys).agg(F.min(t).alias(t)), "first")
    return df.join(broadcast_counted(lo), [*keys, t], "left_semi")


def round_robin(df: DataFrame, order: str, k: int, out: str = "shard") -> DataFrame:
    """Item i (from 0, in order) goes to shard i mod k."""
    r = ordered_rank(df, [], order, out="rn")
    return r.withColumn(out, F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).drop("rn", "rn_of")


def contiguous_blocks(df: DataFrame, order: str, k: int, balanced: bool = False, out: str = "shard") -> DataFrame:
    """k contiguous parts of ceil(N/k) items, the last ones shorter or empty; ``balanced``
    gives the first N mod k parts one item more than the others instead."""
    r = ordered_rank(df, [], order, out="rn")
    i, n = F.col("rn") - 1, F.col("rn_of")
    if balanced:
        base, rem = F.floor(n / k), F.pmod(n, F.lit(k))
        cut = rem * (base + 1)
        shard = F.when(i < cut, F.floor(i / (base + 1))).otherwise(rem + F.floor(F.try_divide(i - cut, base)))
    else:
        shard = F.floor(i / F.ceil(n / k))
    return r.withColumn(out, shard.cast("int")).drop("rn", "rn_of")


def concatenate(parts: list[DataFrame]) -> DataFrame:
    """Fields one after the other along time or member."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def wanted_minus_present(wanted: DataFrame, present: DataFrame, on) -> DataFrame:
    return wanted.select(*on).distinct().join(present.select(*on).distinct(), list(on), "left_anti")
