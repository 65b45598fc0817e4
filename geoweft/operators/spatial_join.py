"""Band join of points: an equi-join on grid cells followed by the exact band predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metres per degree.
METRES_PER_DEGREE_LON = 111320.0
METRES_PER_DEGREE_LAT = 110540.0


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance with the cosine of the mean latitude."""
    east = (lon2 - lon1) * METRES_PER_DEGREE_LON * F.cos(F.radians((lat2 + lat1) / 2.0))
    north = (lat2 - lat1) * METRES_PER_DEGREE_LAT
    return F.sqrt(F.pow(east, F.lit(2)) + F.pow(north, F.lit(2)))


def usable(lon: Column, lat: Column) -> Column:
    """Finite, in degrees; false (not null) for missing values."""
    ok = ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180, 180) & lat.between(-90, 90)
    return F.coalesce(ok, F.lit(False))


def _band(lat: Column, dlat: float) -> Column:
    return F.floor(lat / dlat).cast("long")


def _row_width(band: Column, radius_m: float, dlat: float) -> Column:
    """Cell width in degrees of longitude in a latitude band, a function of the band alone: the widest reach of any left
    point that may meet the band. Each band has its own width, so points near a pole don't widen all other cells."""
    edge = F.greatest(F.abs(band * dlat), F.abs((band + 1) * dlat)) + dlat
    cos = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.least(radius_m / F.greatest(METRES_PER_DEGREE_LON * cos, F.lit(1.0)), F.lit(360.0))


def band_join(left: DataFrame, right: DataFrame, radius_m: float, left_xy: tuple[str, str] = ("longitude", "latitude"), right_xy: tuple[str, str] = ("right_longitude", "right_latitude")) -> DataFrame:
    """Rows of left and right with |dlat| <= r/110540 and |dlon| <= r/max(111320*|cos(lat left)|, 1).

    Points right of the join sit in one cell of a grid sized by the radius; every left point meets the (at most 3 x 3) cells
    around it, and the exact predicates decide. Cell width is fixed by the latitude band, so no statistics are needed.
    Rows with unusable locations drop out; column names of both sides must differ. A cell with very many points of both
    sides is split by the adaptive skew join, as the join is a plain sort-merge or hash join on the cell.
    """
    if not radius_m > 0 or not math.isfinite(radius_m):
        raise ValueError("the radius must be positive")
    (lx, ly), (rx, ry) = left_xy, right_xy
    dlat = radius_m / METRES_PER_DEGREE_LAT
    cols = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if cols:
        raise ValueError(f"both sides have the columns {sorted(cols)}")
    l_lon, l_lat, r_lon, r_lat = F.col(lx), F.col(ly), F.col(rx), F.col(ry)
    reach = radius_m / F.greatest(METRES_PER_DEGREE_LON * F.abs(F.cos(F.radians(l_lat))), F.lit(1.0))
    rights = right.where(usable(r_lon, r_lat)).withColumn("_band", _band(r_lat, dlat))
    rights = rights.withColumn("_cell", F.floor(r_lon / _row_width(F.col("_band"), radius_m, dlat)).cast("long"))
    lefts = left.where(usable(l_lon, l_lat)).withColumn("_b", F.explode(F.sequence(_band(l_lat - dlat, dlat), _band(l_lat + dlat, dlat))))
    width = _row_width(F.col("_b"), radius_m, dlat)
    lefts = lefts.withColumn("_c", F.explode(F.sequence(F.floor((l_lon - reach) / width).cast("long"), F.floor((l_lon + reach) / width).cast("long"))))
    exact = (F.abs(r_lat - l_lat) <= radius_m / METRES_PER_DEGREE_LAT) & (F.abs(r_lon - l_lon) <= reach)
    joined = lefts.join(rights, (F.col("_b") == F.col("_band")) & (F.col("_c") == F.col("_cell"))).where(exact)
    return joined.drop("_b", "_c", "_band", "_cell")
