import struct

import numpy as np
from pyspark.sql import functions as F

from geoweft.functions import wkb
from geoweft.options import Extent

BOX = (0.0, 0.0, 10.0, 10.0)


def polygon(*rings):
    return "POLYGON", [[np.array([*r, r[0]], float) for r in rings]]


def area(g):
    return sum(abs(wkb._area(p[0])) - sum(abs(wkb._area(h)) for h in p[1:]) for p in g[1])


SQUARE = [(-5, -5), (15, -5), (15, 15), (-5, 15)]


def test_round_trip_all_types():
    line = np.array([[0, 0], [1, 2], [3, 4]], float)
    for g in [("POINT", [line[:1]]), ("LINESTRING", [line]), polygon([(0, 0), (1, 0), (1, 1)]), ("MULTIPOINT", [line[:1], line[1:2]]), ("MULTILINESTRING", [line, line + 1]), ("MULTIPOLYGON", [*polygon(SQUARE)[1], *polygon([(20, 0), (21, 0), (21, 1)])[1]])]:
        again = wkb.decode(wkb.encode(g))
        assert again[0] == g[0] and all(np.array_equal(a, b) for a, b in zip(wkb.rings_of(again), wkb.rings_of(g), strict=True))


def test_big_endian_dimensions_and_damage():
    assert wkb.decode(struct.pack(">BIdd", 0, 1, 3.0, 4.0))[1][0].tolist() == [[3.0, 4.0]]
    assert wkb.decode(struct.pack("<BIddd", 1, 1001, 3.0, 4.0, 5.0))[1][0].tolist() == [[3.0, 4.0]]
    assert wkb.decode(struct.pack("<BIIdd", 1, 0x20000001, 4326, 3.0, 4.0))[1][0].tolist() == [[3.0, 4.0]]
    for bad in (None, b"", b"\x01", b"\x01\x01\x00\x00\x00\x00", b"\x01\x63\x00\x00\x00"):
        assert wkb.decode(bad) is None


def test_clip_polygons():
    inside = polygon([(1, 1), (3, 1), (3, 3), (1, 3)])
    assert area(wkb.clip_box(inside, BOX)) == 4
    assert wkb.clip_box(polygon([(20, 20), (30, 20), (30, 30)]), BOX) is None
    assert area(wkb.clip_box(polygon(SQUARE), BOX)) == 100
    holed = polygon(SQUARE, [(2, 2), (2, 4), (4, 4), (4, 2)])
    assert area(wkb.clip_box(holed, BOX)) == 96
    crossing_hole = polygon(SQUARE, [(-2, 2), (-2, 4), (4, 4), (4, 2)])
    assert area(wkb.clip_box(crossing_hole, BOX)) == 92
    comb = polygon([(-5, 1), (5, 1), (5, 3), (-1, 3), (-1, 5), (5, 5), (5, 7), (-5, 7)])
    parts = wkb.clip_box(comb, BOX)
    assert parts[0] == "MULTIPOLYGON" and len(parts[1]) == 2 and area(parts) == 20


def test_clip_is_idempotent_and_within():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.sort(rng.uniform(0, 2 * np.pi, 9))
        star = polygon([(5 + r * np.cos(t), 5 + r * np.sin(t)) for t, r in zip(a, rng.uniform(2, 12, 9), strict=True)])
        once = wkb.clip_box(star, BOX)
        if once is None:
            continue
        b = wkb.bounds(once)
        assert b[0] >= -1e-9 and b[1] >= -1e-9 and b[2] <= 10 + 1e-9 and b[3] <= 10 + 1e-9
        assert abs(area(wkb.clip_box(once, BOX)) - area(once)) < 1e-9
        grid = rng.uniform(0, 10, (4000, 2))
        share = wkb.inside_rings(star[1][0], grid[:, 0], grid[:, 1]).mean() * 100
        assert abs(area(once) - share) < 8


def test_clip_lines_and_points():
    line = ("LINESTRING", [np.array([[-5, 5], [5, 5], [5, 20], [8, 20], [8, 5]], float)])
    parts = wkb.clip_box(line, BOX)
    assert parts[0] == "MULTILINESTRING" and [p.tolist() for p in parts[1]] == [[[0, 5], [5, 5], [5, 10]], [[8, 10], [8, 5]]]
    assert wkb.clip_box(("LINESTRING", [np.array([[-1, 11], [1, 9], [-1, 7]], float)]), BOX)[0] == "LINESTRING"
    points = ("MULTIPOINT", [np.array([[1.0, 1.0]]), np.array([[11.0, 1.0]])])
    assert len(wkb.clip_box(points, BOX)[1]) == 1
    assert wkb.intersects_box(polygon(SQUARE), BOX) and not wkb.intersects_box(polygon([(20, 20), (30, 20), (30, 30)]), BOX)
    assert wkb.intersects_box(("LINESTRING", [np.array([[-1, 5], [11, 5]], float)]), BOX)


def test_columns(spark):
    rows = [(wkb.encode(("POINT", [np.array([[3.0, 4.0]])])),), (wkb.encode(polygon(SQUARE)),), (None,), (b"\x01\x02",), (struct.pack(">BIdd", 0, 1, 1.0, 2.0),)]
    df = spark.createDataFrame(rows, "geometry binary")
    got = df.select(wkb.geometry_type(F.col("geometry")).alias("t"), wkb.point_xy(F.col("geometry")).alias("p"), wkb.geometry_bounds(F.col("geometry")).alias("b")).collect()
    assert [r.t for r in got] == ["POINT", "POLYGON", None, None, "POINT"]
    assert [(r.p.x, r.p.y) for r in got] == [(3, 4), (None, None), (None, None), (None, None), (1, 2)]
    assert tuple(got[1].b) == (-5, 15, -5, 15) and got[2].b.xmin is None
    met = df.where(wkb.intersects_extent(F.col("geometry"), Extent(0, 0, 5, 5)))
    assert met.count() == 3
    cut = met.select(wkb.clip_extent(F.col("geometry"), Extent(0, 0, 5, 5)).alias("g")).collect()
    assert area(wkb.decode(cut[1].g)) == 25


def test_projection(spark):
    lon, lat = wkb.project_to_wgs84(F.lit(-13358338.895), F.lit(4300621.372), 3857)
    r = spark.range(1).select(lon.alias("x"), lat.alias("y")).first()
    assert abs(r.x + 120) < 1e-6 and abs(r.y - 36) < 1e-3
