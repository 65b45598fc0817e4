import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.functions import wkb
from geoweft.operators.proximity import nearby, points_near_points, region_cells, regions_around_points
from geoweft.operators.spatial_join import band_join, distance_m

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("lat", [0.0, 36.0, 80.0, 89.9])
def test_band_join_equals_nested_loop(spark, lat):
    rng = random.Random(int(lat))
    radius = 500.0
    dlat = radius / 110540.0
    at = lambda: (rng.randint(-8, 8) * dlat / 2, lat + rng.randint(-8, 8) * dlat / 2 if lat < 89 else lat - rng.random() * dlat)
    left = spark.createDataFrame([(i, *at()) for i in range(150)], "i int, longitude double, latitude double")
    right = spark.createDataFrame([(j, *at()) for j in range(150)], "j int, rx double, ry double")
    got = band_join(left, right, radius, right_xy=("rx", "ry")).select("i", "j")
    exact = (F.abs(F.col("ry") - F.col("latitude")) <= radius / 110540.0) & (F.abs(F.col("rx") - F.col("longitude")) <= radius / F.greatest(111320.0 * F.abs(F.cos(F.radians("latitude"))), F.lit(1.0)))
    want = left.crossJoin(right).where(exact).select("i", "j")
    g, w = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert g == w and len(g) == len(set(g)) and w


def test_band_join_refuses_bad_input(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "i int, longitude double, latitude double")
    with pytest.raises(ValueError):
        band_join(df, df, 10.0)
    with pytest.raises(ValueError):
        band_join(df, df, 0.0)


POINT = "record_id string, longitude double, latitude double, extra int"
OTHER = "other_id string, longitude double, latitude double, extra int"


def test_points_near_points_edge_cases(spark):
    step = 60 / 110540.0
    left = spark.createDataFrame([("a", 1.0, 50.0, 1), ("a", 1.0, 50.0, 2), (None, 1.0, 50.0, 1), ("b", None, 50.0, 1), ("c", NAN, 50.0, 1), ("d", INF, 50.0, 1), ("e", 200.0, 50.0, 1), ("f", 1.0, 50.0 + step, 1)], POINT)
    right = spark.createDataFrame([("x", 1.0, 50.0, 1), ("x", 1.0, 50.0, 1), ("y", 1.0, 50.0 - step, 1), (None, 1.0, 50.0, 1), ("z", 1.0, None, 1)], OTHER)
    got = sorted(map(tuple, points_near_points(left, right, 75.0).collect()))
    assert got == [("a", "x"), ("a", "y"), ("f", "x")]
    assert points_near_points(left.where("false"), right, 75.0).count() == 0 and points_near_points(left, right.where("false"), 75.0).count() == 0


def test_points_near_points_brute_force(spark):
    rng = random.Random(8)
    pts = [(f"p{i}", rng.uniform(10, 10.02), rng.uniform(59.99, 60.01), 0) for i in range(300)]
    oth = [(f"q{i}", rng.uniform(10, 10.02), rng.uniform(59.99, 60.01), 0) for i in range(300)]
    left, right = spark.createDataFrame(pts, POINT), spark.createDataFrame(oth, OTHER)
    got = set(map(tuple, points_near_points(left, right, 150.0).collect()))
    cross = left.selectExpr("record_id", "longitude x", "latitude y").crossJoin(right)
    want = set(map(tuple, cross.where(distance_m(F.col("x"), F.col("y"), F.col("longitude"), F.col("latitude")) <= 150.0).select("record_id", "other_id").collect()))
    assert got == want and want


def test_regions_and_nearby(spark):
    ring = lambda *p: np.array([*p, p[0]], float)
    holed = wkb.encode(("POLYGON", [[ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 2), (2, 2), (2, 1))]]))
    regions = spark.createDataFrame([("r", holed, "x"), ("r", holed, "x"), ("n", None, "x"), ("bad", b"\x01", "x"), (None, holed, "x"), ("point", wkb.encode(("POINT", [np.array([[1.0, 1.0]])])), "x")], "id string, geometry binary, longitude string")
    points = spark.createDataFrame([("in", 3.0, 3.0, 1), ("hole", 1.5, 1.5, 1), ("out", 5.0, 5.0, 1), ("null", None, 3.0, 1), ("nan", NAN, 3.0, 1)], POINT)
    assert list(map(tuple, regions_around_points(points, regions.select(F.col("id").alias("region_id"), "geometry")).collect())) == [("in", "r")]
    linked = spark.createDataFrame([("l1", 3.0, 3.0, 10.0), ("l2", 3.0, 3.0, 80.0), ("l3", 3.0, 3.0, -1.0), ("l4", 3.0, 3.0, None)], "record_id string, longitude double, latitude double, gers_match_distance_m double")
    assert sorted(map(tuple, nearby(points, linked, regions).collect())) == [("in", "near", "l1"), ("in", "within", "r")]


@pytest.mark.parametrize("size", [0.05, 0.3, 7.0])
def test_marked_cells_decide_as_the_polygon(size):
    rng = np.random.default_rng(5)
    for _ in range(12):
        angles = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 25)))
        r = rng.uniform(0.2, 2.5, len(angles))
        outer = np.column_stack([10 + r * np.cos(angles), -3 + r * np.sin(angles)])
        hole = np.column_stack([10 + 0.1 * np.cos(angles), -3 + 0.1 * np.sin(angles)])
        rings = [np.vstack([o, o[:1]]) for o in (outer, hole)]
        cells = {(x, y): edge for x, y, edge in region_cells(wkb.encode(("POLYGON", [rings])), size)}
        xy = np.column_stack([rng.uniform(7, 13, 4000), rng.uniform(-6, 0, 4000)])
        truth = wkb.inside_rings(rings, xy[:, 0], xy[:, 1])
        for (x, y), inside in zip(xy, truth, strict=True):
            edge = cells.get((int(np.floor(x / size)), int(np.floor(y / size))))
            assert edge or (edge is False) == inside
    assert region_cells(wkb.encode(("POLYGON", [[np.array([[0, 0], [np.nan, 1], [1, 1], [0, 0]])]])), 0.1) == [] and region_cells(b"x", 0.1) == []
