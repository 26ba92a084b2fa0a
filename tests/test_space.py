"""Grid, masks, splits and fills on toy grids."""

import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.functions.geo import GridSpec
from gridspark.operators import fill as fi, masks as mk, space as sp
from gridspark.queries import QUERIES


def test_cell_areas_sum_to_the_sphere(spark):
    total = sp.cells_table(spark).agg(F.sum("area_m2")).first()[0]
    assert math.isclose(total, 4 * math.pi * geo.EARTH_RADIUS_M**2, rel_tol=1e-9)


def test_tiles(spark):
    c = sp.cells_table(spark)
    r = c.agg(F.count("*"), F.countDistinct("tile_id"), F.max("tile_id")).first()
    assert tuple(r) == (259_200, 288, 287)
    b = sp.tile_bounds(c).filter("tile_id = 25").first()
    assert (b.lat_from, b.lat_to, b.lon_from, b.lon_to) == (30, 60, 30, 60)


def test_zone_edges(spark):
    lats = [-90.0, -60.0, -35.0, -15.0, 14.99, 15.0, 35.0, 60.0, 89.75, 90.0]
    d = spark.createDataFrame([(x,) for x in lats], "lat double")
    got = [r[0] for r in d.select(geo.zone("lat")).collect()]
    assert got == [0, 3, 2, 1, 1, 2, 3, 4, 4, 0]
    bands = [r[0] for r in d.select(geo.lat_band("lat")).collect()]
    assert bands[0] == -89.5 and bands[4] == 14.5 and bands[-1] is None


def test_nearest_cell_wraps(spark):
    pts = spark.createDataFrame([(0.1, -0.2), (0.1, 359.8), (89.99, 179.6), (-90.0, -180.0)], "lat double, lon double")
    got = [(r.lat_idx, r.lon_idx) for r in sp.nearest_cell(pts, "lat", "lon").collect()]
    assert got == [(180, 0), (180, 0), (359, 359), (0, 360)]


def test_bilinear_is_exact_on_a_plane_and_strict(spark):
    src = GridSpec(4, 6, lat0=0.0, lon0=0.0, dlat=2.0, dlon=60.0)
    dst = GridSpec(7, 12, lat0=0.0, lon0=0.0, dlat=1.0, dlon=30.0)
    rows = [(i, j, float(i)) for i in range(4) for j in range(6)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, value double")
    got = {(r.lat_idx, r.lon_idx): r.value for r in sp.regrid_bilinear(df, [], src, dst).collect()}
    assert len(got) == 84
    assert all(math.isclose(v, i / 2, abs_tol=1e-12) for (i, _), v in got.items())
    gap = df.withColumn("value", F.when((F.col("lat_idx") != 1) | (F.col("lon_idx") != 0), F.col("value")))
    got = {(r.lat_idx, r.lon_idx): r.value for r in sp.regrid_bilinear(gap, [], src, dst).collect()}
    gone = {k for k, v in got.items() if v is None}
    assert gone == {(i, j) for i in (1, 2, 3) for j in (11, 0, 1)}  # longitude wraps


def brute_bands(land, centres, p_test, p_val, grid):
    """The split, cell by cell: grow rings until the share is reached."""
    total = sum(land.values())
    code = {c: -1 for c in land}
    radius = 0
    for value, target in ((2, int(total * p_test)), (1, int(total * p_val))):
        taken = 0
        while taken < target and radius < grid.nlon:
            for centre in centres:
                for off in (-radius, radius):
                    column = (int(round(centre / grid.dlon)) + off) % grid.nlon
                    for cell, flag in land.items():
                        if cell[1] == column and flag and code[cell] == -1:
                            code[cell] = value
                            taken += 1
            radius += 1
    return {c: (0 if code[c] == -1 and land[c] else code[c]) for c in land}


@pytest.mark.parametrize("p_test,p_val", [(0.2, 0.1), (0.5, 0.3), (0.0, 0.1), (0.1, 0.0)])
def test_longitude_band_split(spark, p_test, p_val):
    grid = GridSpec(6, 24, lat0=-75.0, lon0=0.0, dlat=30.0, dlon=15.0)
    land = {(i, j): int((i * 7 + j * 3) % 4 != 0) for i in range(6) for j in range(24)}
    df = spark.createDataFrame([(i, j, f) for (i, j), f in land.items()], "lat_idx int, lon_idx int, land int")
    centres = (0, 90, 240)
    d = mk.split_longitude_bands(df, centres, p_test, p_val, grid)
    got = {(r.lat_idx, r.lon_idx): r.tvt for r in d.collect()}
    assert got == brute_bands(land, centres, p_test, p_val, grid)


def test_split_locations_whole_blocks(spark):
    d = spark.range(500).select(F.pmod("id", F.lit(20)).cast("int").alias("lat_idx"), F.floor(F.col("id") / 20).cast("int").alias("lon_idx"),
                                F.when(F.col("id") < 350, 0).when(F.col("id") < 360, 1).otherwise(-1).alias("tvt"))
    a = mk.split_locations(d, block=70, seed=1)
    ids = sorted(r.loc_id for r in a.collect())
    assert ids == list(range(1, 351))
    assert [tuple(r) for r in a.orderBy("loc_id").collect()] == [tuple(r) for r in mk.split_locations(d.repartition(7), block=70, seed=1).orderBy("loc_id").collect()]
    assert [tuple(r) for r in a.orderBy("loc_id").collect()] != [tuple(r) for r in mk.split_locations(d, block=70, seed=2).orderBy("loc_id").collect()]


def test_combined_masks_need_one_grid(spark):
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "lat_idx int, lon_idx int, mask int")
    b = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "lat_idx int, lon_idx int, mask int")
    assert {(r.lon_idx, r.mask) for r in mk.combine_masks([a, b]).collect()} == {(0, 1), (1, 0)}
    with pytest.raises(Exception, match="share one grid"):
        mk.combine_masks([a, b.limit(1)]).collect()


GRID = GridSpec(3, 4)


def _field(spark, values):
    rows = [(i, j, values.get((i, j)), 1) for i in range(3) for j in range(4)]
    return spark.createDataFrame(rows, "lat_idx int, lon_idx int, value double, land int")


def test_spatial_fill_takes_present_neighbours(spark):
    df = _field(spark, {(1, 0): 2.0, (1, 2): 4.0, (0, 1): 6.0})
    got = {(r.lat_idx, r.lon_idx): r.value for r in fi.spatial_fill(df, [], grid=GRID).collect()}
    assert got[(1, 1)] == 4.0
    # The corner sees (0,0)x4, (0,1)x2, (1,0)x2, (1,1)x1 with edges repeated.
    assert got[(0, 0)] == (6.0 * 2 + 2.0 * 2) / 4
    assert got[(2, 3)] == 4.0
    compat = {(r.lat_idx, r.lon_idx): r.value for r in fi.spatial_fill(df, [], grid=GRID, compat=True).collect()}
    assert math.isclose(compat[(1, 1)], 12.0 / 9) and math.isclose(compat[(0, 0)], 16.0 / 9)


def test_month_neighbours_wrap(spark):
    rows = [(0, 0, m, None if m in (1, 5, 6) else float(m), 1) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, month int, value double, land int")
    got = {r.month: r.value for r in fi.neighbour_month_fill(df).collect()}
    assert (got[1], got[5], got[6]) == ((12 + 2) / 2, 4.0, 7.0)


def test_template_overwrites_the_whole_series(spark):
    df = spark.createDataFrame([("a", 0, 0, 1, 1.0), ("a", 0, 0, 2, None), ("b", 0, 0, 1, 5.0), ("b", 0, 0, 2, 6.0)],
                               "k string, lat_idx int, lon_idx int, doy int, value double")
    t = spark.createDataFrame([(0, 0, 1, 10.0), (0, 0, 2, 20.0)], "lat_idx int, lon_idx int, doy int, value double")
    got = {(r.k, r.doy): r.value for r in fi.template_overwrite(df, t, ["k"]).collect()}
    assert got == {("a", 1): 10.0, ("a", 2): 20.0, ("b", 1): 5.0, ("b", 2): 6.0}


@pytest.mark.parametrize("turn", [1, -1])
def test_land_fraction_on_the_threshold_in_any_order(spark, tmp_path, turn):
    """Ten quantities whose mean over 27 is 0.9 exactly; added up as they stand, it comes out above."""
    q = [1.0, 8.0, 29.0, 46.0, 29.0, 23.0, 20.0, 35.0, 26.0, 26.0][::turn]
    rows = spark.createDataFrame([(7, 1, v) for v in q], "l_suppkey long, l_linenumber int, l_quantity double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.land_fraction for r in QUERIES["m05_consensus_land_fraction"](spark, str(tmp_path)).collect()] == [0.9]
