"""Coordinates, regridding, tiles, zones and cell lookup."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridspark.functions import geo
from gridspark.functions.geo import GridSpec, HALF_DEGREE
from gridspark.functions.sizing import broadcast_bounded, broadcast_counted


def cells_table(spark: SparkSession, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """One row per grid cell with its static geometry."""
    f = spark.range(grid.n_cells).withColumnRenamed("id", "flat_idx")
    lat_idx, lon_idx = grid.unflat("flat_idx")
    d = f.select(F.col("flat_idx").cast("int"), lat_idx.alias("lat_idx"), lon_idx.alias("lon_idx"))
    return add_geometry(d, grid)


def add_geometry(df: DataFrame, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Latitude, longitude, exact area, tile and zone from the cell indices."""
    return df.withColumns({
        "lat": grid.lat("lat_idx"), "lon": grid.lon("lon_idx"), "area_m2": grid.area("lat_idx"),
        "tile_id": grid.tile_id("lat_idx", "lon_idx"), "zone": geo.zone(grid.lat("lat_idx"))})


def normalise_coordinates(df: DataFrame, lat: str, lon: str, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Snap points to exact cell centres with longitudes in [0, 360)."""
    d = df.withColumns({"lat_idx": grid.lat_index(lat), "lon_idx": grid.lon_index(lon)})
    return d.withColumns({"lat": grid.lat("lat_idx"), "lon": grid.lon("lon_idx")})


def nearest_cell(points: DataFrame, lat: str, lon: str, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Index of the nearest cell of a regular grid, either longitude convention."""
    return points.withColumns({"lat_idx": grid.lat_index(lat), "lon_idx": grid.lon_index(lon)})


def gather_points(df: DataFrame, points: DataFrame, cell=("lat_idx", "lon_idx")) -> DataFrame:
    """Series of the listed cells, pairwise; ``points`` carries the cell and a loc_id."""
    return df.join(broadcast_counted(points), list(cell))


def _axis_weights(spark, n_dst, dst0, dst_step, n_src, src0, src_step, wrap, names):
    """Two source positions and their weights per target position (at most 2*n_dst rows)."""
    src, dst, w = names
    pos = (F.lit(dst0) + F.col("id") * dst_step - src0) / src_step
    pos = F.round(pos, 9)
    if not wrap:
        pos = F.greatest(F.lit(0.0), F.least(F.lit(float(n_src - 1)), pos))
    low = F.floor(pos)
    frac = pos - low
    pairs = F.array(F.struct(low.alias("i"), (1 - frac).alias("w")),
                    F.struct((low + 1).alias("i"), frac.alias("w")))
    d = (spark.range(n_dst).select(F.col("id").cast("int").alias(dst), F.explode(pairs).alias("p"))
         .select(dst, F.pmod(F.col("p.i"), F.lit(n_src)).cast("int").alias(src), F.col("p.w").alias(w))
         .filter(F.col(w) > 0))
    return d.withColumn(f"n_{w}", F.count(F.lit(1)).over(W.partitionBy(dst)))


def regrid_bilinear(df: DataFrame, keys, src: GridSpec, dst: GridSpec, value: str = "value") -> DataFrame:
    """Bilinear interpolation to another regular grid.

    Longitude wraps; a latitude beyond the outer source row takes that row. A target is
    missing when a neighbour of positive weight is absent or missing. The two weight
    tables are bounded by the grid, so the field is shuffled once, in the final sum.
    """
    spark = df.sparkSession
    lat_w = _axis_weights(spark, dst.nlat, dst.lat0, dst.dlat, src.nlat, src.lat0, src.dlat,
                          False, ("lat_idx", "to_lat", "wy"))
    lon_w = _axis_weights(spark, dst.nlon, dst.lon0, dst.dlon, src.nlon, src.lon0, src.dlon,
                          True, ("lon_idx", "to_lon", "wx"))
    d = (df.join(broadcast_bounded(lat_w, 2 * dst.nlat), "lat_idx")
         .join(broadcast_bounded(lon_w, 2 * dst.nlon), "lon_idx"))
    out = d.groupBy(*keys, "to_lat", "to_lon").agg(
        F.sum(F.col(value) * F.col("wy") * F.col("wx")).alias("__s"),
        F.count(value).alias("__n"), F.max(F.col("n_wy") * F.col("n_wx")).alias("__need"))
    return out.select(
        *keys, F.col("to_lat").alias("lat_idx"), F.col("to_lon").alias("lon_idx"),
        F.when(F.col("__n") == F.col("__need"), F.col("__s")).alias(value))


def tile_bounds(df: DataFrame, grid: GridSpec = HALF_DEGREE) -> DataFrame:
    """Half-open index range of the cells present in each tile."""
    return df.groupBy(grid.tile_id("lat_idx", "lon_idx").alias("tile_id")).agg(
        F.min("lat_idx").alias("lat_from"), (F.max("lat_idx") + 1).alias("lat_to"),
        F.min("lon_idx").alias("lon_from"), (F.max("lon_idx") + 1).alias("lon_to"))


def tiles_by_land(cells: DataFrame, grid: GridSpec = HALF_DEGREE, land: str = "land") -> DataFrame:
    """Land cells per tile and whether the tile has none."""
    return (cells.groupBy(grid.tile_id("lat_idx", "lon_idx").alias("tile_id"))
            .agg(F.sum(land).alias("land_cells"))
            .withColumn("ocean_only", F.col("land_cells") == 0))


def axis_bounds(coords: DataFrame, axis: str, lo: float | None = None, hi: float | None = None,
                keys=()) -> DataFrame:
    """Cell edges half a median step around every centre, clamped to [lo, hi] if given.

    ``coords`` has one row per coordinate of an axis, so the window is a few hundred rows.
    """
    every = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    d = coords.withColumn("__d", F.col(axis) - F.lag(axis).over(every.orderBy(axis)))
    half = F.median("__d").over(every) / 2
    d = d.withColumns({"lower": F.col(axis) - half, "upper": F.col(axis) + half}).drop("__d")
    if lo is not None:
        d = d.withColumn("lower", F.greatest(F.col("lower"), F.lit(lo)))
    if hi is not None:
        d = d.withColumn("upper", F.least(F.col("upper"), F.lit(hi)))
    return d


def vertical_mean(df: DataFrame, keys, thickness: str, value: str = "value") -> DataFrame:
    """Thickness-weighted mean over layers, missing layers left out."""
    v, w = F.col(value), F.col(thickness)
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w))).alias(value))


def grid_mismatches(a: DataFrame, b: DataFrame, coords) -> DataFrame:
    """Coordinates found on one side only."""
    x = a.select(*coords).distinct().withColumn("__a", F.lit(1))
    y = b.select(*coords).distinct().withColumn("__b", F.lit(1))
    d = x.join(y, list(coords), "full_outer").filter("__a IS NULL OR __b IS NULL")
    return d.select(*coords, F.when(F.col("__a").isNull(), "left").otherwise("right")
                    .alias("missing_in"))


def box_mean(df: DataFrame, keys, lat_bounds, lon_bounds, grid: GridSpec = HALF_DEGREE,
             value: str = "value") -> DataFrame:
    """Mean over a latitude/longitude box per key."""
    inside = geo.in_box(grid.lat("lat_idx"), grid.lon("lon_idx"), *lat_bounds, *lon_bounds)
    return df.filter(inside).groupBy(*keys).agg(F.avg(value).alias(value))
