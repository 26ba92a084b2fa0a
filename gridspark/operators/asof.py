"""As-of and nearest joins on irregular axes, as a merge over sorted ranges.

Rows of both sides are sorted together by key and position into ranges, so one key may fill many
ranges and equal positions are split by a hash. In a range every row sees the last right row before it;
the last one of each range is carried over its border, past ranges without any.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridspark.functions.sizing import broadcast_counted, stored

#: Rows that one range holds, about.
RANGE_ROWS = 1_000_000


def asof_join(left: DataFrame, right: DataFrame, on: str, by=(), direction: str = "backward", tolerance: float | None = None,
              columns=None, ranges: int | None = None) -> DataFrame:
    """Every row of ``left`` with the ``columns`` (all others, unless listed) of the row of ``right`` that has the
    same ``by`` and is nearest on ``on``: at or before it ('backward'), at or after it ('forward'), or on
    either side ('nearest', the earlier one of two as near). The position met is added as ``<on>_right``.

    With ``tolerance`` rows further away do not count. Missing keys are equal, a missing position meets
    nothing. Of several right rows at one position the largest by its columns stands for all. Rows
    of ``left`` without a partner keep missing values.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    by = list(by)
    columns = [c for c in right.columns if c not in (on, *by)] if columns is None else list(columns)
    spark = left.sparkSession
    at = F.struct(F.col(on).alias("at"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    kind = dict(left.dtypes)[on]
    one = right.filter(F.col(on).isNotNull()).groupBy(*by, F.col(on).cast(kind).alias(on)).agg(F.max(F.struct(*columns) if columns else F.lit(True)).alias("__c"))
    one = one.select(*by, on, *([F.col("__c")[c].alias(c) for c in columns] if columns else []))
    key = [F.col(c).alias(f"b{i}") for i, c in enumerate(by)]
    row = F.struct(*left.columns)
    queries = left.select(*key, F.col(on).alias("at"), F.lit(False).alias("is_right"), F.xxhash64(F.to_json(row)).alias("tie"), row.alias("row"))
    found = one.select(*key, F.col(on).alias("at"), F.lit(True).alias("is_right"), F.lit(0).cast("long").alias("tie"), at.alias("found"))
    keys = [f"b{i}" for i in range(len(by))]
    both = queries.unionByName(found, allowMissingColumns=True)
    # Backward, a right row at the same position stands before the left one; forward, behind it.
    sides = {"backward": [True], "forward": [False], "nearest": [True, False]}[direction]
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-left.count() // RANGE_ROWS))
    order = [*keys, "at", F.when(F.col("is_right"), 0 if sides == [True] else 2).otherwise(1), "tie"]
    if sides == [True, False]:  # at the same position both directions find the right row in front
        order[-2] = F.when(F.col("is_right"), 0).otherwise(1)
    sort = [c if isinstance(c, Column) else F.col(c) for c in order]
    dealt = both.repartitionByRange(ranges, *sort).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "asof")
    seen = F.when(F.col("is_right"), F.struct(*keys, "found"))
    borders = _borders(dealt, seen, sort, ranges, sides)
    out = dealt.join(broadcast_counted(stored(borders, "borders")), "part", "left")
    for backward in sides:
        out = _carried(out, seen, sort, backward)
    out = out.filter(~F.col("is_right"))
    same = lambda side: _all([F.col(f"{side}.{k}").eqNullSafe(F.col(k)) for k in keys])
    hits = []
    for backward in sides:
        side = "before" if backward else "after"
        away = F.col("at") - F.col(f"{side}.found.at") if backward else F.col(f"{side}.found.at") - F.col("at")
        ok = F.col(side).isNotNull() & F.col("at").isNotNull() & same(side)
        if tolerance is not None:
            ok = ok & (away.cast("double") <= tolerance)
        hits.append((F.when(ok, F.col(f"{side}.found")), F.when(ok, away)))
    if len(hits) == 1:
        hit = hits[0][0]
    else:
        (b, db), (a, da) = hits
        hit = F.when(db.isNull(), a).when(da.isNull() | (db <= da), b).otherwise(a)
    out = out.withColumn("hit", hit)
    return out.select("row.*", F.col("hit.at").alias(f"{on}_right"), *[F.col(f"hit.c{i}").alias(c) for i, c in enumerate(columns)])


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _borders(dealt: DataFrame, seen: Column, sort, ranges: int, sides) -> DataFrame:
    """One row a range: the last right row of the ranges before it (``before_border``), the first one of
    those after it (``after_border``), past ranges without any. Only right rows are read, once for both."""
    place, right = F.struct(*sort), dealt.filter("is_right").groupBy("part")
    names = {True: "before_border", False: "after_border"}
    ends = right.agg(*[(F.max_by if backward else F.min_by)(seen, place).alias(names[backward]) for backward in sides])
    ends = dealt.sparkSession.range(ranges).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    over = {backward: W.partitionBy(F.lit(0)).orderBy(F.col("part").asc() if backward else F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1) for backward in sides}
    return ends.select("part", *[F.last(names[backward], ignorenulls=True).over(over[backward]).alias(names[backward]) for backward in sides])


def _carried(rows: DataFrame, seen: Column, sort, backward: bool) -> DataFrame:
    """Add ``before`` (or ``after``): the last right row up to each row (the first from it on).

    Both look back, forward over rows in reversed order: a frame that ends at its row is carried from
    row to row, one that begins there would be read anew for each.
    """
    name = "before" if backward else "after"
    way = (lambda c: c.asc()) if backward else (lambda c: c.desc())
    here = W.partitionBy("part").orderBy(*[way(c) for c in sort]).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(seen, ignorenulls=True).over(here), F.col(f"{name}_border"))).drop(f"{name}_border")


def hold_last(df: DataFrame, axis: DataFrame, keys, t: str = "t", value: str = "value", tolerance: float | None = None) -> DataFrame:
    """The series of every key on the steps of ``axis`` (keys and ``t``): each step takes the last value at or
    before it; irregular steps on either side."""
    present = df.filter(F.col(value).isNotNull()).select(*keys, t, value)
    return asof_join(axis.select(*keys, t), present, t, keys, "backward", tolerance)


def nearest_step(df: DataFrame, axis: DataFrame, keys, t: str = "t", value: str = "value", tolerance: float | None = None) -> DataFrame:
    """As :func:`hold_last` with the value nearest in time, the earlier of two as near."""
    present = df.filter(F.col(value).isNotNull()).select(*keys, t, value)
    return asof_join(axis.select(*keys, t), present, t, keys, "nearest", tolerance)
