"""Gap filling."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.functions import noleap as nl
from gridspark.functions.geo import GridSpec, HALF_DEGREE
from gridspark.functions.sizing import broadcast_bounded
from gridspark.schema import CELL


def land_climatology(df: DataFrame, cell=CELL, value: str = "value", land: str = "land") -> DataFrame:
    """Twelve monthly means per land cell; a month without data stays as a missing row."""
    found = (df.filter(F.col(land) == 1).groupBy(*cell, "month").agg(F.avg(value).alias(value)))
    months = (found.select(*cell).distinct()
              .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))))
    return months.join(found, [*cell, "month"], "left")


def spatial_fill(df: DataFrame, keys, k: int = 3, eligible: str = "land", value: str = "value",
                 grid: GridSpec = HALF_DEGREE, compat: bool = False) -> DataFrame:
    """Fill missing eligible cells with the mean of the k x k block around them, edge rows
    and columns repeated; donors are eligible cells with a value.

    ``compat=True`` divides by the whole block, counting missing donors as 0. Only the
    missing cells open into offsets, and they are joined by equality.
    """
    r = k // 2
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                        for i in range(-r, r + 1) for j in range(-r, r + 1)])

    def clamp(c, n):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("int")

    holes = df.filter(F.col(value).isNull() & (F.col(eligible) == 1)).select(*keys, *CELL)
    wanted = (holes.withColumn("__o", F.explode(offsets))
              .withColumns({"__ti": F.col("lat_idx"), "__tj": F.col("lon_idx")})
              .withColumns({"lat_idx": clamp(F.col("__ti") + F.col("__o.i"), grid.nlat),
                            "lon_idx": clamp(F.col("__tj") + F.col("__o.j"), grid.nlon)})
              .drop("__o"))
    donors = (df.filter(F.col(value).isNotNull() & (F.col(eligible) == 1))
              .select(*keys, *CELL, F.col(value).alias("__v")))
    total = F.sum("__v") / float(k * k) if compat else F.avg("__v")
    means = (wanted.join(donors, [*keys, *CELL])
             .groupBy(*keys, F.col("__ti").alias("lat_idx"), F.col("__tj").alias("lon_idx"))
             .agg(total.alias("__fill")))
    d = df.join(means, [*keys, *CELL], "left")
    if compat:
        hole = F.col(value).isNull() & (F.col(eligible) == 1)
        d = d.withColumn("__fill", F.when(hole, F.coalesce("__fill", F.lit(0.0))))
    return d.withColumn(value, F.coalesce(value, "__fill")).drop("__fill")


def neighbour_month_fill(clim: DataFrame, cell=CELL, eligible: str = "land", value: str = "value") -> DataFrame:
    """Fill a still missing month with the mean of the present ones of the months around
    it, December meeting January. A cell has twelve rows, held as one map."""
    months = F.map_from_entries(F.collect_list(F.struct("month", value)).over(W.partitionBy(*cell)))
    d = clim.withColumn("__m", months)
    prev = F.try_element_at("__m", nl.prev_month("month"))
    after = F.try_element_at("__m", nl.next_month("month"))
    mean = F.when(prev.isNotNull() & after.isNotNull(), (prev + after) / 2).otherwise(F.coalesce(prev, after))
    hole = F.col(value).isNull() & (F.col(eligible) == 1)
    return d.withColumn(value, F.when(hole, mean).otherwise(F.col(value))).drop("__m")


def climatology_fill(df: DataFrame, clim: DataFrame, cell=CELL, value: str = "value",
                     years: tuple[int, int] | None = None) -> DataFrame:
    """Fill missing values with the cell's climatology of that month, optionally only
    inside a range of years."""
    d = df.join(clim.select(*cell, "month", F.col(value).alias("__c")), [*cell, "month"], "left")
    fill = F.coalesce(value, "__c")
    if years:
        fill = F.when(F.col("year").between(*years), fill).otherwise(F.col(value))
    return d.withColumn(value, fill).drop("__c")


def template_overwrite(df: DataFrame, template: DataFrame, keys, doy: str = "doy",
                       value: str = "value") -> DataFrame:
    """Overwrite the whole series of every key that holds a missing value by a day-of-year
    template; ``template`` has the cell, ``doy`` and the value."""
    holes = F.count(F.when(F.col(value).isNull(), 1)).over(W.partitionBy(*keys))
    t = template.select(*CELL, doy, F.col(value).alias("__t"))
    d = df.withColumn("__bad", holes > 0).join(t, [*CELL, doy], "left")
    return d.withColumn(value, F.when(F.col("__bad"), F.col("__t")).otherwise(F.col(value))).drop("__bad", "__t")


def nearest_source(cells: DataFrame, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """(lat_idx, lon_idx, src_lat, src_lon, steps) for every cell of the grid: the cell of ``cells`` that is
    reached from it in the fewest steps to one of eight neighbours, east and west meeting, poles
    not; of several the one with the smallest row, then column. Without cells there are no rows.

    The search starts from all cells at once and spreads ring by ring; it holds one grid, no more.
    """
    def search(frame: pd.DataFrame) -> pd.DataFrame:
        none = grid.nlat * grid.nlon
        source = np.full((grid.nlat, grid.nlon), none)
        source[frame["lat_idx"], frame["lon_idx"]] = frame["lat_idx"] * grid.nlon + frame["lon_idx"]
        steps = np.where(source < none, 0, -1)
        ring = 0
        while (steps < 0).any():
            ring += 1
            best = np.minimum(source, np.minimum(np.roll(source, 1, 1), np.roll(source, -1, 1)))
            wide = best.copy()
            wide[1:] = np.minimum(wide[1:], best[:-1])
            wide[:-1] = np.minimum(wide[:-1], best[1:])
            new = (steps < 0) & (wide < none)
            source[new], steps[new] = wide[new], ring
        at = np.indices(source.shape).reshape(2, -1)
        return pd.DataFrame({"lat_idx": at[0], "lon_idx": at[1], "src_lat": source.ravel() // grid.nlon, "src_lon": source.ravel() % grid.nlon, "steps": steps.ravel()}).astype("int32")

    inside = cells.filter(F.col("lat_idx").between(0, grid.nlat - 1) & F.col("lon_idx").between(0, grid.nlon - 1)).select(*CELL).distinct()
    return inside.groupBy().applyInPandas(search, "lat_idx int, lon_idx int, src_lat int, src_lon int, steps int")


def nearest_template(locations: DataFrame, template: DataFrame, lat: str = "lat", lon: str = "lon",
                     grid: GridSpec = HALF_DEGREE, empty: str = "nearest") -> DataFrame:
    """Day-of-year template of each location, taken from the nearest cell of the template's
    grid. Where that cell has no template, ``empty`` says what holds: the nearest cell that has one
    ('nearest'), a failed job ('fail'), or no row ('drop')."""
    there = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    where = locations.withColumns({"lat_idx": F.when(there, grid.lat_index(lat)), "lon_idx": F.when(there, grid.lon_index(lon))})
    if empty == "drop":
        return where.join(template, list(CELL))
    if empty == "fail":
        have = template.select(*CELL).distinct().withColumn("__has", F.lit(True))
        where = where.join(have, list(CELL), "left")
        gone = F.raise_error(F.lit("a location's cell has no template")).cast("boolean")
        where = where.withColumn("__has", F.coalesce(F.col("__has"), gone)).filter("__has").drop("__has")
        return where.join(template, list(CELL))
    if empty != "nearest":
        raise ValueError(f"unknown rule {empty!r}")
    found = broadcast_bounded(nearest_source(template, grid).drop("steps"), grid.n_cells)
    where = where.join(found, list(CELL), "left")
    source = template.withColumnsRenamed({"lat_idx": "src_lat", "lon_idx": "src_lon"})
    return where.join(source, ["src_lat", "src_lon"], "left").drop("src_lat", "src_lon")


def fill_all(df: DataFrame, keys, eligible: str = "land", value: str = "value", grid: GridSpec = HALF_DEGREE,
             rounds: int | None = None) -> DataFrame:
    """:func:`spatial_fill` of 3 x 3 blocks again and again, until no eligible cell is missing or can be filled,
    or ``rounds`` times: what one round has filled gives to the next. A map is one value of
    ``keys``; one without any value stays as it is. A task holds one map."""
    keys, names = list(keys), df.columns

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame["lat_idx"].to_numpy(), frame["lon_idx"].to_numpy()
        field = np.full((grid.nlat, grid.nlon), np.nan)
        field[y, x] = frame[value].astype(float)
        land = np.zeros(field.shape, bool)
        land[y, x] = frame[eligible] == 1
        hole = land & np.isnan(field)
        done = 0
        while hole.any() and (rounds is None or done < rounds):
            gives = land & ~np.isnan(field)
            sums = []
            for a in (np.where(gives, field, 0.0), gives.astype(float)):
                a = np.pad(a, 1, mode="edge")
                a = a[:-2] + a[1:-1] + a[2:]
                sums.append(a[:, :-2] + a[:, 1:-1] + a[:, 2:])
            new = hole & (sums[1] > 0)
            if not new.any():
                break
            field[new] = sums[0][new] / sums[1][new]
            hole &= ~new
            done += 1
        frame[value] = field[y, x]
        return frame[names]

    return df.groupBy(*keys).applyInPandas(fill, df.schema)
