"""Exact ranks, samples and quantiles of groups too large for one task.

A window over a whole group sorts the group in one task. Here rows are put into
order-preserving buckets; only bucket counts, combined map-side, are accumulated per
group, and a sort happens inside one bucket at most. The count tables are stored and
measured, then broadcast, so the rows themselves are not shuffled to meet them.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridspark.functions.sizing import broadcast_counted, one_row, stored

SPLITS = 64


def hash_key(*cols, seed: int = 0) -> Column:
    """Reproducible pseudo-random sort key of 60 bits: the head of an MD5 over the columns as
    text, which any engine can repeat. A missing value counts as an empty text."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def hash_bucket(h, bits: int = 10) -> Column:
    """Bucket from the leading bits of a hash key; keeps the order of the hash."""
    h = F.col(h) if isinstance(h, str) else h
    return F.shiftright(h, 60 - bits)


def attach(df: DataFrame, summary: DataFrame, keys) -> DataFrame:
    """Join a stored summary on its keys, a NULL key being a group of its own."""
    if not keys:  # then the summary is one row
        d = df.withColumn("__row", one_row(summary))
        return d.withColumns({c: F.col(f"__row.{c}") for c in summary.columns}).drop("__row")
    l, r = df.alias("l"), broadcast_counted(summary).alias("r")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    extra = [F.col(f"r.{c}") for c in summary.columns if c not in keys]
    return l.join(r, on).select("l.*", *extra)


def _bucket_offsets(df: DataFrame, keys, bucket: str, name: str) -> DataFrame:
    """Rows per (group, bucket), rows of the group before the bucket, and group size."""
    cum = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1) if keys \
        else W.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__n").over(cum), F.lit(0)),
                               "__total": F.sum("__n").over(whole)})
    return stored(sizes, name)


def _rank_in_buckets(df, keys, order, bucket, out) -> DataFrame:
    offsets = _bucket_offsets(df, keys, bucket, "offsets").drop("__n")
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    d = attach(df.withColumn("__pos", F.row_number().over(inside)), offsets, [*keys, bucket])
    return (d.withColumns({out: F.col("__before") + F.col("__pos"), f"{out}_of": F.col("__total")})
            .drop("__pos", "__before", "__total", bucket))


def hash_rank(df: DataFrame, keys, id_cols, seed: int = 0, out: str = "rn") -> DataFrame:
    """1-based rank of each row in a seeded pseudo-random order per group, plus the
    group size in ``<out>_of``."""
    d = (df.withColumn("__h", hash_key(*id_cols, seed=seed))
         .withColumn("__b", hash_bucket("__h")))
    order = [F.col("__h"), *[F.col(c) for c in id_cols]]
    return _rank_in_buckets(d, list(keys), order, "__b", out).drop("__h")


#: Rows of a bucket that one task sorts, about.
BUCKET_ROWS = 20_000


def hash_smallest(df: DataFrame, keys, id_cols, how_many, seed: int = 0, keep_hash: str | None = None) -> DataFrame:
    """The rows of smallest seeded hash per group: ``how_many(total)`` of them, with their hash in the
    column ``keep_hash`` where one is named.

    Group sizes give a threshold of the hash below which a few more rows than wanted lie; one
    pass keeps those, and only they are ranked: whole buckets below the boundary stay unsorted. A
    group that comes out short, which the threshold makes unlikely, sends all to another pass with
    a higher one. Samples of shards that kept their hash merge by :func:`merge_smallest`.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total")) if keys else df.agg(F.count(F.lit(1)).alias("__total"))
    sizes = stored(sizes.withColumn("__want", F.least(how_many(F.col("__total")).cast("long"), F.col("__total"))), "sizes")
    hashed = df.withColumn("__h", hash_key(*id_cols, seed=seed))
    slack = 1
    while True:
        most = F.col("__want") + slack * (5 * F.sqrt(F.col("__want")) + 20)
        limit = F.when(most >= F.col("__total"), 1.0).otherwise(most / F.col("__total")) * float(1 << 60)
        near = attach(hashed, sizes.withColumn("__limit", limit).drop("__total"), keys).filter(F.col("__h") < F.col("__limit"))
        bucket = F.floor(F.col("__h") / F.col("__limit") * F.ceil(F.col("__want") / BUCKET_ROWS))
        near = stored(near.withColumn("__b", bucket).drop("__limit"), "near")
        got = near.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"), F.max("__want").alias("__want"))
        before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
        got = stored(got.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), "buckets")
        have = F.sum("__n").alias("__have")
        short = _attach_left(sizes, got.groupBy(*keys).agg(have) if keys else got.agg(have), keys).filter("coalesce(__have, 0) < __want")
        if short.isEmpty():
            break
        slack *= 16
    first = F.min(F.struct("__b", (F.col("__want") - F.col("__before")).alias("__need"))).alias("__e")
    beyond = got.filter(F.col("__before") + F.col("__n") > F.col("__want"))
    edge = (beyond.groupBy(*keys).agg(first) if keys else beyond.agg(first)).select(*keys, F.col("__e.__b").alias("__edge"), F.col("__e.__need").alias("__need"))
    d = _attach_left(near, stored(edge, "edges"), keys)
    rows = [*df.columns, *([F.col("__h").alias(keep_hash)] if keep_hash else [])]
    below = d.filter(F.col("__edge").isNull() | (F.col("__b") < F.col("__edge")))
    inside = W.partitionBy(*keys, "__b").orderBy("__h", *id_cols)
    at = d.filter(F.col("__b") == F.col("__edge")).withColumn("__pos", F.row_number().over(inside)).filter(F.col("__pos") <= F.col("__need"))
    return below.select(*rows).unionByName(at.select(*rows))


def _attach_left(df: DataFrame, summary: DataFrame, keys) -> DataFrame:
    """As :func:`attach`, but rows of a group that the summary lacks stay."""
    extra = [c for c in summary.columns if c not in keys]
    if not keys:
        row = one_row(summary)
        return df.withColumns({c: row[c] for c in extra})
    return df.alias("l").join(broadcast_counted(summary).alias("r"), _equal("l", "r", keys), "left").select("l.*", *[F.col(f"r.{c}") for c in extra])


def merge_smallest(samples: DataFrame, keys, id_cols, k: int, kept: str, salts: int = 64) -> DataFrame:
    """The k rows of smallest hash ``kept`` from the samples of shards, each of k rows or all it had."""
    return smallest_k(samples, keys, [F.col(kept), *[F.col(c) for c in id_cols]], k, salts).drop("rn")


def _index_in(cuts: str, n: int, value: Column) -> Column:
    """How many of the first n cut points lie below the value."""
    total = F.lit(0)
    for i in range(n):
        total = total + (value > F.get(F.col(cuts), F.lit(i))).cast("int")
    return F.coalesce(total, F.lit(0))


def _cuts(df: DataFrame, keys, value: str, probs, accuracy: int) -> DataFrame:
    """Stored per-group table: approximate quantiles, and these between min and max."""
    sketch = [F.percentile_approx(value, list(probs), accuracy).alias("__cuts"),
              F.min(value).alias("__min"), F.max(value).alias("__max")]
    cuts = stored(df.groupBy(*keys).agg(*sketch) if keys else df.agg(*sketch), "cuts")
    edges = F.concat(F.array("__min"), F.col("__cuts"), F.array("__max"))
    return cuts.withColumn("__edges", edges).drop("__min", "__max")


def _located(df: DataFrame, keys, value: str, cuts: DataFrame, n: int, parts: int) -> DataFrame:
    """Order-preserving bucket ``__b``: the interval between two cuts, in equal parts."""
    x = attach(df, cuts, keys).withColumn("__i", _index_in("__cuts", n, F.col(value)))
    lo, hi = F.get("__edges", F.col("__i")), F.get("__edges", F.col("__i") + 1)
    share = F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0)
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts)))
    return x.withColumn("__b", (F.col("__i") * parts + part).cast("long")).drop("__cuts", "__edges", "__i")


def ordered_rank(df: DataFrame, keys, order_col: str, tie_cols=(), out: str = "rn", parts: int = 1000) -> DataFrame:
    """1-based rank by a numeric column per group, plus the group size in ``<out>_of``.

    Each of 64 approximate quantile intervals is cut into equal parts, so a bucket that
    is sorted by one task holds about N/64000 rows of a group.
    """
    keys = list(keys)
    d = df.withColumn("__o", F.col(order_col).cast("double"))
    ps = [i / SPLITS for i in range(1, SPLITS)]
    d = _located(d, keys, "__o", _cuts(d, keys, "__o", ps, 2_000), len(ps), parts).drop("__o")
    order = [F.col(order_col), *[F.col(c) for c in tie_cols]]
    return _rank_in_buckets(d, keys, order, "__b", out)


#: Items a quantile sketch keeps per level, and how far around a rank its bracket reaches, about three times the sketch's error.
SKETCH_ITEMS = 4096
SKETCH_SLACK = 0.004


def quantile_sketches(df: DataFrame, keys, col: str) -> DataFrame:
    """(keys, sketch, n, min, max) of present values in one pass, mergeable; groups without a value have n = 0."""
    v = F.col(col).cast("double")
    aggs = [F.kll_sketch_agg_double(v, SKETCH_ITEMS).alias("sketch"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def merge_sketches(shards: DataFrame, keys) -> DataFrame:
    """The sketches of all rows from those of shards."""
    aggs = [F.kll_merge_agg_double("sketch", SKETCH_ITEMS).alias("sketch"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max")]
    return shards.groupBy(*keys).agg(*aggs) if keys else shards.agg(*aggs)


def exact_quantiles(df: DataFrame, keys, col: str, probs, names, parts: int = 1000, sketches: DataFrame | None = None) -> DataFrame:
    """Linear-interpolation quantiles of few but arbitrarily large groups, without
    holding a group in one task and without shuffling its rows.

    A sketch per group (``sketches``, where they are stored already) gives a bracket around every
    wanted rank. One pass counts the rows between brackets and keeps the values inside them, equal
    ones as a count. These few are counted in equal parts, and only the parts that hold a rank are
    sorted. Where a rank is outside its bracket the pass is run again with wider ones.
    """
    keys = list(keys)
    known = sketches if sketches is not None else stored(quantile_sketches(df, keys, col), "sketches")
    known = known.filter("n > 0")
    d = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("__v"))
    slack, found, left = SKETCH_SLACK, None, known
    while True:
        here = stored(_picked_ranks(d, keys, left, probs, slack, parts), "ranks")
        short = here.filter("__v is null").select(*keys).distinct() if keys else here.filter("__v is null")
        good = here.filter("__v is not null")
        found = good if found is None else found.unionByName(good)
        if slack >= 1 or short.isEmpty():
            break
        # The ranks that were found are kept; those of the groups that miss one are looked for again.
        slack *= 8
        if keys:
            found = found.alias("l").join(short.alias("r"), _equal("l", "r", keys), "left_anti").select("l.*")
            left = known.alias("l").join(short.alias("r"), _equal("l", "r", keys), "left_semi").select("l.*")
        else:
            found = None
    aggs = []
    for p, name in zip(probs, names):
        pos = p * (F.col("__total") - 1)
        lo = F.max(F.when(F.col("__rank") == F.floor(pos), F.col("__v")))
        hi = F.max(F.when(F.col("__rank") == F.ceil(pos), F.col("__v")))
        aggs.append((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(name))
    return found.groupBy(*keys).agg(*aggs) if keys else found.agg(*aggs)


def _equal(left: str, right: str, keys):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def _picked_ranks(d: DataFrame, keys, known: DataFrame, probs, slack: float, parts: int) -> DataFrame:
    """(keys, __total, __rank, __v) for the ranks that the probabilities need; __v is null where a bracket missed."""
    ends = []
    for p in probs:
        low = F.kll_sketch_get_quantile_double("sketch", F.lit(max(0.0, p - slack))) if p > slack else F.col("min")
        high = F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, p + slack))) if p + slack < 1 else F.col("max")
        ends += [low, high]
    brackets = stored(known.select(*keys, F.col("n").alias("__total"), F.array(*ends).alias("__ends"), F.array_sort(F.array(*ends)).alias("__cuts")), "brackets")
    x = attach(d, brackets, keys)
    v, inside = F.col("__v"), F.lit(False)
    for i in range(len(probs)):
        inside = inside | v.between(F.get("__ends", F.lit(2 * i)), F.get("__ends", F.lit(2 * i + 1)))
    slot = _index_in("__cuts", 2 * len(probs), v)
    # A value that a bracket holds is at the end of its slot or alone in it with others like it, so it follows those only counted.
    counted = x.groupBy(*keys, slot.alias("__slot"), F.when(inside, v).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counted = attach(stored(counted, "slots"), brackets, keys)
    lo, hi = F.get("__cuts", F.col("__slot") - 1), F.get("__cuts", F.col("__slot"))
    share = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0)
    part = F.when(v.isNull(), -1).otherwise(F.least(F.lit(parts - 1), F.floor(F.coalesce(share, F.lit(0.0)) * parts).cast("int")))
    counted = counted.withColumn("__part", part).drop("__ends", "__cuts")
    sizes = counted.groupBy(*keys, "__slot", "__part", "__total").agg(F.sum("__c").alias("__n"))
    over = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__slot", "__part").rowsBetween(W.unboundedPreceding, -1)  # a few thousand parts a group
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0)))
    ranks = F.flatten(F.array(*[F.array(F.floor(p * (F.col("__total") - 1)), F.ceil(p * (F.col("__total") - 1))) for p in probs]))
    hits = F.array_distinct(F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n"))))
    wanted = stored(sizes.withColumn("__hits", hits).filter(F.size("__hits") > 0).select(*keys, "__slot", "__part", "__before", "__hits"), "wanted")
    few = attach(counted, wanted, [*keys, "__slot", "__part"])
    here = W.partitionBy(*keys, "__slot", "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("__before") + F.sum("__c").over(here)
    few = few.withColumn("__end", end).withColumn("__rank", F.explode(F.filter(
        "__hits", lambda r: (r < F.col("__end")) & (r >= F.col("__end") - F.col("__c")))))
    return few.select(*keys, "__total", "__rank", "__v")


def smallest_k(df: DataFrame, keys, order, k: int, salts: int = 64) -> DataFrame:
    """The k first rows per group; every salt keeps its own k first, then they meet."""
    keys = list(keys)
    d = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    part = W.partitionBy(*keys, "__salt").orderBy(*order)
    d = d.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= k).drop("rn", "__salt")
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return d.withColumn("rn", F.row_number().over(whole.orderBy(*order))).filter(F.col("rn") <= k)
