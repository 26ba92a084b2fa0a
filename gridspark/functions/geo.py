"""Grid geometry as column arithmetic, so most of it needs no dimension join."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Earth radius in metres; zone code and half-open latitude bands.
EARTH_RADIUS_M = 6_371_000.0
ZONES = (
    (1, -15.0, 15.0),   # tropics
    (2, 15.0, 35.0),    # subtropics
    (2, -35.0, -15.0),
    (3, 35.0, 60.0),    # temperate
    (3, -60.0, -35.0),
    (4, 60.0, 90.0),    # boreal
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class GridSpec:
    """Regular global grid: latitude south to north, longitude from lon0 eastwards."""

    nlat: int = 360
    nlon: int = 720
    lat0: float = -89.75
    lon0: float = 0.0
    dlat: float = 0.5
    dlon: float = 0.5
    tile: int = 30

    @property
    def n_cells(self) -> int:
        return self.nlat * self.nlon

    @property
    def tiles_per_row(self) -> int:
        return -(-self.nlon // self.tile)

    @property
    def n_tiles(self) -> int:
        return self.tiles_per_row * -(-self.nlat // self.tile)

    def lat(self, lat_idx) -> Column:
        return self.lat0 + _col(lat_idx) * self.dlat

    def lon(self, lon_idx) -> Column:
        return self.lon0 + _col(lon_idx) * self.dlon

    def lat_index(self, lat) -> Column:
        """Nearest row, clamped to the grid; a point half-way goes to the upper row."""
        i = F.floor((_col(lat) - self.lat0) / self.dlat + 0.5)
        return F.greatest(F.lit(0), F.least(F.lit(self.nlat - 1), i)).cast("int")

    def lon_index(self, lon) -> Column:
        """Nearest column for either longitude convention, wrapping at the date line."""
        i = F.floor((_col(lon) - self.lon0) / self.dlon + 0.5)
        return F.pmod(i, F.lit(self.nlon)).cast("int")

    def flat(self, lat_idx, lon_idx) -> Column:
        return (_col(lat_idx) * self.nlon + _col(lon_idx)).cast("int")

    def unflat(self, flat_idx) -> tuple[Column, Column]:
        f = _col(flat_idx)
        return F.floor(f / self.nlon).cast("int"), F.pmod(f, F.lit(self.nlon)).cast("int")

    def tile_id(self, lat_idx, lon_idx) -> Column:
        row = F.floor(_col(lat_idx) / self.tile)
        col = F.floor(_col(lon_idx) / self.tile)
        return (row * self.tiles_per_row + col).cast("int")

    def area(self, lat_idx) -> Column:
        """Exact cell area in m2 between the two bounding parallels."""
        lat, half = self.lat(lat_idx), self.dlat / 2
        band = F.sin(F.radians(lat + half)) - F.sin(F.radians(lat - half))
        return F.lit(EARTH_RADIUS_M**2 * math.radians(self.dlon)) * band

    def area_cos(self, lat_idx) -> Column:
        """Cosine approximation of the cell area in m2."""
        k = EARTH_RADIUS_M**2 * math.radians(self.dlat) * math.radians(self.dlon)
        return F.lit(k) * F.cos(F.radians(self.lat(lat_idx)))


HALF_DEGREE = GridSpec()


def lon360(lon) -> Column:
    return F.pmod(_col(lon), F.lit(360.0))


def lon180(lon) -> Column:
    return F.pmod(_col(lon) + 180.0, F.lit(360.0)) - 180.0


def zone(lat) -> Column:
    """Climate zone code; 0 outside every band."""
    lat, e = _col(lat), F.lit(0)
    for code, lo, hi in ZONES:
        e = F.when((lat >= lo) & (lat < hi), code).otherwise(e)
    return e.cast("int")


def lat_band(lat) -> Column:
    """Centre of the 1-degree band [k, k+1); missing at 90 and outside [-90, 90)."""
    lat = _col(lat)
    return F.when((lat >= -90) & (lat < 90), F.floor(lat) + 0.5)


def in_box(lat, lon, lat_min, lat_max, lon_min, lon_max) -> Column:
    """Inclusive box; a negative longitude bound switches the box to 0..360."""
    lat, lon = _col(lat), lon360(lon)
    lo, hi = lon_min, lon_max
    if lo < 0 or hi < 0:
        lo, hi = lo % 360.0, hi % 360.0
    inside = (lon >= lo) & (lon <= hi) if lo <= hi else (lon >= lo) | (lon <= hi)
    return (lat >= lat_min) & (lat <= lat_max) & inside
