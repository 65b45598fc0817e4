"""Points near other points, and the region around each point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.functions.wkb import decode, inside_rings, rings_of
from geoweft.operators.spatial_join import band_join, distance_m, usable
from geoweft.session import cut


def points_near_points(points: DataFrame, others: DataFrame, radius_m: float, point_id: str = "record_id", other_id: str = "other_id") -> DataFrame:
    """Distinct pairs (point_id, other_id) at most radius_m apart by the equirectangular distance of the mean latitude.

    points and others hold an id, longitude and latitude; further columns are ignored. Rows with a null id or an unusable
    location (null, not finite, out of range) take part in no pair; empty inputs give no rows; repeated rows give one pair.
    Both sides are reduced to distinct positions before the grid join, so a position that holds many records of one id is
    joined once; ids come back by an equi-join on the position. The cosine of the mean latitude may be larger than that of
    the own latitude by the width of a band, so the grid reach has a margin that the exact distance then cuts.
    """
    left = points.select(F.col(point_id).alias("_pid"), F.col("longitude").alias("_x"), F.col("latitude").alias("_y")).where(F.col("_pid").isNotNull() & usable(F.col("_x"), F.col("_y"))).distinct()
    right = others.select(F.col(other_id).alias("_oid"), F.col("longitude").alias("_ox"), F.col("latitude").alias("_oy")).where(F.col("_oid").isNotNull() & usable(F.col("_ox"), F.col("_oy"))).distinct()
    left_at = left.select(F.col("_x").alias("_px"), F.col("_y").alias("_py")).distinct()
    right_at = right.select(F.col("_ox").alias("_qx"), F.col("_oy").alias("_qy")).distinct()
    margin = radius_m * (1 + 1e-3)
    meets = band_join(left_at, right_at, margin, ("_px", "_py"), ("_qx", "_qy")).where(distance_m(F.col("_px"), F.col("_py"), F.col("_qx"), F.col("_qy")) <= radius_m)
    pairs = meets.join(left, (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y"))).join(right, (F.col("_qx") == F.col("_ox")) & (F.col("_qy") == F.col("_oy")))
    return pairs.select(F.col("_pid").alias(point_id), F.col("_oid").alias(other_id)).distinct()


@F.pandas_udf(T.BooleanType())
def _contains(x: pd.Series, y: pd.Series, rings: pd.Series) -> pd.Series:
    out = np.zeros(len(x), bool)
    cache: dict[bytes, list] = {}
    codes, uniques = pd.factorize(rings, use_na_sentinel=True)
    for k, wkb in enumerate(uniques):
        at = np.flatnonzero(codes == k)
        if wkb not in cache:
            g = decode(wkb)
            cache[wkb] = rings_of(g) if g and g[0].endswith("POLYGON") else []
        out[at] = inside_rings(cache[wkb], x.to_numpy()[at], y.to_numpy()[at])
    return pd.Series(out)


CELLS = T.ArrayType(T.StructType([T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), T.StructField("edge", T.BooleanType())]))


def region_cells(wkb: bytes, size: float) -> list[tuple[int, int, bool]]:
    """(column, row, edge) of the grid cells that a (multi)polygon meets: edge where its boundary may pass, else inside."""
    g = decode(wkb)
    rings = rings_of(g) if g and g[0].endswith("POLYGON") else []
    rings = [r for r in rings if len(r)]
    if not rings or not all(np.isfinite(r).all() for r in rings):
        return []
    low, high = np.floor(np.array([-180.0, -90.0]) / size).astype(int), np.floor(np.array([180.0, 90.0]) / size).astype(int)
    cell = lambda v, k: int(min(max(np.floor(v / size), low[k]), high[k]))
    edges: set[tuple[int, int]] = set()
    for r in rings:
        for (ax, ay), (bx, by) in zip(r[:-1].tolist(), r[1:].tolist(), strict=True):
            if ay > by:
                ax, ay, bx, by = bx, by, ax, ay
            for y in range(cell(ay, 1), cell(by, 1) + 1):  # row by row, the columns that the edge crosses there
                t0, t1 = ((max(ay, y * size) - ay) / (by - ay), (min(by, (y + 1) * size) - ay) / (by - ay)) if by > ay else (0.0, 1.0)
                x0, x1 = sorted((ax + t0 * (bx - ax), ax + t1 * (bx - ax)))
                slack = 1e-9 * max(1.0, abs(x0), abs(x1))
                edges.update((x, y) for x in range(cell(x0 - slack, 0), cell(x1 + slack, 0) + 1))
    every = np.concatenate(rings)
    (x0, y0), (x1, y1) = every.min(axis=0), every.max(axis=0)
    x0, y0, x1, y1 = cell(x0, 0), cell(y0, 1), cell(x1, 0), cell(y1, 1)
    out = [(x, y, True) for x, y in sorted(edges)]
    columns = np.arange(x0, x1 + 1)
    for y in range(y0, y1 + 1):  # a cell without boundary is inside or outside as its centre is
        inner = inside_rings(rings, (columns + 0.5) * size, np.full(len(columns), (y + 0.5) * size))
        out += [(int(x), y, False) for x in columns[inner] if (int(x), y) not in edges]
    return out


def _region_cells(wkb: Column, size: float) -> Column:
    @F.pandas_udf(CELLS)
    def cells(geometries: pd.Series) -> pd.Series:
        return pd.Series([[{"cx": x, "cy": y, "edge": e} for x, y, e in region_cells(g, size)] for g in geometries], dtype=object)

    return cells(wkb)


def regions_around_points(points: DataFrame, regions: DataFrame, cell_degrees: float = 0.1, point_id: str = "record_id", region_id: str = "region_id") -> DataFrame:
    """Distinct pairs (point_id, region_id) where the polygon, holes left out, contains the point.

    regions holds an id and a WKB (multi)polygon; other geometry, null and damaged WKB contain nothing. Unusable locations
    and null ids take part in no pair. Every region is written to the grid cells that it meets, by a number and without its
    geometry; a point is in one cell. A cell without boundary decides by itself; only points in cells of the boundary meet
    the geometry, for the exact even-odd test. Only distinct positions are tested. cell_degrees is the only parameter and
    affects speed alone.
    """
    left = points.select(F.col(point_id).alias("_pid"), F.col("longitude").alias("_x"), F.col("latitude").alias("_y")).where(F.col("_pid").isNotNull() & usable(F.col("_x"), F.col("_y"))).distinct()
    at = left.select(F.col("_x").alias("_px"), F.col("_y").alias("_py")).distinct()
    at = at.withColumn("_cx", F.floor(F.col("_px") / cell_degrees).cast("long")).withColumn("_cy", F.floor(F.col("_py") / cell_degrees).cast("long"))
    shapes = regions.select(F.col(region_id).alias("_rid"), F.col("geometry").alias("_wkb")).where(F.col("_rid").isNotNull() & F.col("_wkb").isNotNull())
    shapes = shapes.withColumn("_shape", F.xxhash64("_rid", "_wkb")).dropDuplicates(["_shape"])
    cells = shapes.select("_rid", "_shape", F.explode(_region_cells(F.col("_wkb"), cell_degrees)).alias("c"))
    near = at.join(cells, (F.col("_cx") == F.col("c.cx")) & (F.col("_cy") == F.col("c.cy"))).select("_px", "_py", "_rid", "_shape", F.col("c.edge").alias("_edge"))
    near = cut(near)
    tested = near.where("_edge").select("_px", "_py", "_shape").join(shapes, "_shape").where(_contains(F.col("_px"), F.col("_py"), F.col("_wkb"))).select("_px", "_py", "_rid")
    inside = near.where("not _edge").select("_px", "_py", "_rid").unionByName(tested)
    pairs = inside.join(left, (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y")))
    return pairs.select(F.col("_pid").alias(point_id), F.col("_rid").alias(region_id)).distinct()


def nearby(points: DataFrame, linked: DataFrame, regions: DataFrame, radius_m: float = 75.0) -> DataFrame:
    """(record_id, relation, other_id): relation 'near' to linked rows whose own match distance lies in [0, radius_m], and
    'within' for the regions around. Null or negative match distances and null ids are no partners."""
    partners = linked.where(F.col("gers_match_distance_m").between(0, radius_m)).select(F.col("record_id").alias("other_id"), "longitude", "latitude")
    near = points_near_points(points, partners, radius_m).select("record_id", F.lit("near").alias("relation"), "other_id")
    areas = regions.select(F.col("id").alias("region_id"), "geometry")
    within = regions_around_points(points, areas).select("record_id", F.lit("within").alias("relation"), F.col("region_id").alias("other_id"))
    return near.unionByName(within)
