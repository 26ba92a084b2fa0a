"""Masks, land fractions and train/validation/test splits."""

from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions.geo import GridSpec, HALF_DEGREE
from gridspark.functions.ranking import hash_rank
from gridspark.functions.sizing import broadcast_bounded, one_row, per_cell
from gridspark.schema import CELL, split_rules_table


def finite_mask(df: DataFrame, axis: DataFrame, cell=CELL, value: str = "value", first_n: int | None = None,
                order: str = "t") -> DataFrame:
    """1 where the cell is present at every step of ``axis``, optionally only at the first n.

    ``axis`` has the steps in column ``order``; a step without a row is missing."""
    steps = axis.select(order).distinct()
    if first_n is not None:
        steps = steps.orderBy(order).limit(first_n)
    span = one_row(steps.agg(F.count(order).alias("n"), F.max(order).alias("last")))
    d = df.withColumn("__v", F.when(F.col(order) <= span["last"], F.col(value)))
    d = d.groupBy(*cell).agg(F.count("__v").alias("__n"))
    return d.withColumn("finite_mask", (F.col("__n") == span["n"]).cast("int")).drop("__n")


def threshold_mask(df: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    """1 where value >= threshold; missing gives 0."""
    m = F.coalesce(F.col(value) >= threshold, F.lit(False)).cast("int")
    return df.withColumn("mask", m)


def combine_masks(masks: list[DataFrame], cell=CELL, value: str = "mask") -> DataFrame:
    """AND of masks: 1 where every mask is at least 0.5 at all its steps.

    A cell that some mask lacks fails the job, since the grids must match.
    """
    d = None
    for i, m in enumerate(masks):
        part = m.select(*cell, F.coalesce(value, F.lit(0)).alias("__v"), F.lit(i).alias("__m"))
        d = part if d is None else d.unionByName(part)
    seen = F.lit(0)
    for i in range(len(masks)):
        seen = seen + F.max(F.when(F.col("__m") == i, 1).otherwise(0))
    out = d.groupBy(*cell).agg((F.min("__v") >= 0.5).cast("int").alias("mask"), seen.alias("__n"))
    bad = F.raise_error(F.lit("the masks do not share one grid")).cast("int")
    return out.withColumn("mask", F.when(F.col("__n") == len(masks), F.col("mask"))
                          .otherwise(bad)).drop("__n")


def ocean_to_land(df: DataFrame, value: str = "value") -> DataFrame:
    """Land fraction = 1 - ocean fraction, kept inside [0, 1]."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col(value)))
    return df.withColumn("land_fraction", F.when(F.col(value).isNotNull(), v))


def consensus_land_fraction(df: DataFrame, cell=CELL, value: str = "value") -> DataFrame:
    """Mean land fraction over models, 0 as soon as one model says 0; above 0.9 is land."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))
    v = F.when(v > 0.9, 1.0).otherwise(v)
    return df.groupBy(*cell).agg(
        F.when(F.min(v) == 0, 0.0).otherwise(F.avg(v)).alias("land_fraction"))


def apply_mask(df: DataFrame, mask: DataFrame, codes, code: str = "tvt", value: str = "value",
               keep_rows: bool = True, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Keep values whose cell code is listed; other rows become missing or, with
    ``keep_rows=False``, go away. The mask has one row per cell, so it is broadcast."""
    m = per_cell(mask.select(*CELL, code), grid)
    if not keep_rows:
        m = m.filter(F.col(code).isin(*codes)).drop(code)
        return df.join(broadcast_bounded(m, grid.n_cells), CELL, "left_semi")
    d = df.join(broadcast_bounded(m.withColumnRenamed(code, "__code"), grid.n_cells), CELL, "left")
    return d.withColumn(value, F.when(F.col("__code").isin(*codes), F.col(value))).drop("__code")


def split_longitude_bands(cells: DataFrame, centres=tuple(range(0, 360, 30)), p_test: float = 0.2,
                          p_val: float = 0.1, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Split code per land cell from columns around ``centres`` (degrees east).

    Rings of growing column distance go to test until its land count reaches its share,
    then to validation, the rest to training; -1 off land. ``cells`` needs a ``land``
    flag. The running sum sees at most nlon/2+1 rings.
    """
    cols = [int(round((c % 360.0 - grid.lon0) / grid.dlon)) % grid.nlon for c in centres]
    dist = F.least(*[
        F.least(F.pmod(F.col("lon_idx") - c, F.lit(grid.nlon)),
                F.pmod(c - F.col("lon_idx"), F.lit(grid.nlon))) for c in cols]) \
        if len(cols) > 1 else F.least(F.pmod(F.col("lon_idx") - cols[0], F.lit(grid.nlon)),
                                      F.pmod(cols[0] - F.col("lon_idx"), F.lit(grid.nlon)))
    d = cells.withColumn("ring", dist.cast("int"))
    every = W.partitionBy(F.lit(0))
    rings = d.groupBy("ring").agg(F.sum("land").alias("n"))
    rings = (rings
             .withColumn("before", F.coalesce(F.sum("n").over(
                 every.orderBy("ring").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("land", F.sum("n").over(every))
             .withColumn("is_test", F.col("before") < F.floor(F.col("land") * p_test))
             .withColumn("test_n", F.sum(F.when(F.col("is_test"), F.col("n")).otherwise(0)).over(every)))
    is_val = (F.col("before") - F.col("test_n")) < F.floor(F.col("land") * p_val)
    rings = rings.select("ring", F.when(F.col("is_test"), 2).when(is_val, 1).otherwise(0).alias("__code"))
    out = d.join(broadcast_bounded(rings, grid.nlon), "ring", "left")
    return out.withColumn("tvt", F.when(F.col("land") == 1, F.col("__code")).otherwise(-1)).drop("__code", "ring")


def split_locations(cells: DataFrame, code: str = "tvt", block: int = 70, seed: int = 42,
                    id_cols=CELL) -> DataFrame:
    """Locations of each split in a seeded random order, cut to whole blocks."""
    r = hash_rank(cells.filter(F.col(code) >= 0), [code], id_cols, seed=seed, out="loc_id")
    full = F.floor(F.col("loc_id_of") / block) * block
    return r.filter(F.col("loc_id") <= full).drop("loc_id_of")


def assign_splits(df: DataFrame, code: str = "tvt", year: str = "year", periods=None) -> DataFrame:
    """Split and period of every (cell code, year); the rules are 18 rows at most."""
    rules = split_rules_table(df.sparkSession, periods).withColumnRenamed("tvt", "__code")
    on = ((F.col(code) == F.col("__code")) & (F.col(year) >= F.col("first_year"))
          & (F.col(year) <= F.col("last_year")))
    return df.join(F.broadcast(rules), on).drop("__code", "first_year", "last_year")


def mask_code_counts(cells: DataFrame, code: str = "tvt") -> DataFrame:
    """Cells per code and their share of land (codes >= 0)."""
    d = cells.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    land = F.sum(F.when(F.col(code) >= 0, F.col("n")).otherwise(0)).over(W.partitionBy(F.lit(0)))
    return d.withColumn("share_of_land", F.when(F.col(code) >= 0, F.try_divide("n", land)))


# Region ids of the score tables.
REGION_IDS = {0: ("train", 0), 1: ("val", 1), 2: ("test", 2)}
NO_REGION = -999


def region_ids(cells: DataFrame, code: str = "tvt") -> DataFrame:
    """Region id and label of every cell, -999 outside the splits."""
    rid, label = F.lit(NO_REGION), F.lit(None).cast("string")
    for c, (name, i) in REGION_IDS.items():
        rid = F.when(F.col(code) == c, i).otherwise(rid)
        label = F.when(F.col(code) == c, name).otherwise(label)
    return cells.withColumns({"region_id": rid.cast("int"), "region": label})
