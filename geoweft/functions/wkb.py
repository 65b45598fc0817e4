"""WKB geometry in numpy: decoding, bounds, type names, rectangle predicates and rectangle clipping.

A decoded geometry is ``(name, parts)``: for points and lines ``parts`` is a list of coordinate arrays, for polygons a list
of polygons, each a list of rings (shell first). Z and M values are dropped. Null, empty or damaged WKB decodes to None.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WKB codes.
NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
CODES = {name: code for code, name in NAMES.items()}

Geometry = tuple[str, list]


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def header(self) -> tuple[str, int, int]:
        order = "<" if self.data[self.at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", self.data, self.at + 1)
        self.at += 5
        dims = 2
        if code & 0x20000000:  # EWKB with an SRID
            self.at += 4
        dims += bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        dims += (0, 1, 1, 2)[code // 1000]
        return order, code % 1000, dims

    def count(self, order: str) -> int:
        (n,) = struct.unpack_from(order + "I", self.data, self.at)
        self.at += 4
        return n

    def coords(self, order: str, n: int, dims: int) -> np.ndarray:
        if self.at + 8 * n * dims > len(self.data):
            raise ValueError("short WKB")
        xy = np.frombuffer(self.data, order + "f8", n * dims, self.at).reshape(n, dims)[:, :2].astype(float)
        self.at += 8 * n * dims
        return xy

    def geometry(self) -> Geometry:
        order, code, dims = self.header()
        name = NAMES[code]
        if name == "POINT":
            xy = self.coords(order, 1, dims)
            return name, [] if np.isnan(xy).any() else [xy]
        if name == "LINESTRING":
            xy = self.coords(order, self.count(order), dims)
            return name, [xy] if len(xy) else []
        if name == "POLYGON":
            rings = [self.coords(order, self.count(order), dims) for _ in range(self.count(order))]
            return name, [rings] if rings and len(rings[0]) else []
        members = [self.geometry() for _ in range(self.count(order))]
        if name == "GEOMETRYCOLLECTION":
            return name, members
        return name, [part for _, parts in members for part in parts]


def decode(data: bytes | None) -> Geometry | None:
    if not data:
        return None
    try:
        return _Reader(bytes(data)).geometry()
    except (ValueError, KeyError, IndexError, struct.error):
        return None


def _simple(name: str, part) -> bytes:
    head = struct.pack("<BI", 1, CODES[name])
    if name == "POINT":
        return head + np.asarray(part, "<f8").tobytes()
    if name == "LINESTRING":
        return head + struct.pack("<I", len(part)) + np.asarray(part, "<f8").tobytes()
    return head + struct.pack("<I", len(part)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in part)


def encode(geometry: Geometry) -> bytes:
    name, parts = geometry
    if name == "GEOMETRYCOLLECTION":
        return struct.pack("<BII", 1, 7, len(parts)) + b"".join(encode(g) for g in parts)
    if name.startswith("MULTI"):
        return struct.pack("<BII", 1, CODES[name], len(parts)) + b"".join(_simple(name[5:], p) for p in parts)
    if not parts:
        return struct.pack("<BIdd", 1, 1, np.nan, np.nan) if name == "POINT" else struct.pack("<BII", 1, CODES[name], 0)
    return _simple(name, parts[0])


def rings_of(geometry: Geometry) -> list[np.ndarray]:
    name, parts = geometry
    if name == "GEOMETRYCOLLECTION":
        return [c for member in parts for c in rings_of(member)]
    return [ring for poly in parts for ring in poly] if name.endswith("POLYGON") else list(parts)


def bounds(geometry: Geometry | None) -> tuple[float, float, float, float] | None:
    """xmin, ymin, xmax, ymax; None for an empty geometry."""
    arrays = rings_of(geometry) if geometry else []
    if not arrays:
        return None
    xy = np.concatenate(arrays)
    return (*xy.min(axis=0), *xy.max(axis=0))


def inside_rings(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings, so holes are out. Points exactly on a boundary have either result."""
    odd = np.zeros(len(x), bool)
    for ring in rings:
        x1, y1 = ring[:-1, 0], ring[:-1, 1]
        x2, y2 = ring[1:, 0], ring[1:, 1]
        for ax, ay, bx, by in zip(x1, y1, x2, y2, strict=True):
            if ay == by:
                continue
            hit = (ay > y) != (by > y)
            odd ^= hit & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def _segments_meet_box(xy: np.ndarray, box: tuple) -> bool:
    return any(_clip_segment(a, b, box) is not None for a, b in zip(xy[:-1], xy[1:], strict=True))


def intersects_box(geometry: Geometry | None, box: tuple[float, float, float, float]) -> bool:
    """True if the geometry and the closed box (xmin, ymin, xmax, ymax) share a point."""
    if geometry is None:
        return False
    name, parts = geometry
    xmin, ymin, xmax, ymax = box
    if name == "GEOMETRYCOLLECTION":
        return any(intersects_box(member, box) for member in parts)
    for part in parts:
        rings = part if name.endswith("POLYGON") else [part]
        for xy in rings:
            if ((xy[:, 0] >= xmin) & (xy[:, 0] <= xmax) & (xy[:, 1] >= ymin) & (xy[:, 1] <= ymax)).any():
                return True
            if not name.endswith("POINT") and _segments_meet_box(xy, box):
                return True
        if name.endswith("POLYGON") and inside_rings(part, np.array([xmin]), np.array([ymin]))[0]:
            return True
    return False


def _clip_segment(a: np.ndarray, b: np.ndarray, box: tuple) -> tuple[float, float] | None:
    """Parameter range of the segment within the closed box (Liang and Barsky)."""
    t0, t1 = 0.0, 1.0
    dx, dy = b[0] - a[0], b[1] - a[1]
    for p, q in ((-dx, a[0] - box[0]), (dx, box[2] - a[0]), (-dy, a[1] - box[1]), (dy, box[3] - a[1])):
        if p == 0:
            if q < 0:
                return None
            continue
        r = q / p
        if p < 0:
            t0 = max(t0, r)
        else:
            t1 = min(t1, r)
        if t0 > t1:
            return None
    return t0, t1


def _clip_line(xy: np.ndarray, box: tuple) -> list[np.ndarray]:
    pieces: list[list[np.ndarray]] = []
    for a, b in zip(xy[:-1], xy[1:], strict=True):
        span = _clip_segment(a, b, box)
        if span is None or span[0] == span[1]:
            continue
        p, q = (a + t * (b - a) if 0 < t < 1 else (a if t <= 0 else b) for t in span)
        if pieces and span[0] == 0 and np.array_equal(pieces[-1][-1], p):
            pieces[-1].append(q)
        else:
            pieces.append([p, q])
    return [np.array(p) for p in pieces]


def _area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return 0.5 * float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]))


def _clip_half_plane(polygon: list[np.ndarray], axis: int, limit: float, sign: int) -> list[list[np.ndarray]]:
    """The parts of a polygon where sign * (coordinate - limit) >= 0.

    Kept boundary chains of all rings end on the cutting line; sorted along it, their ends bound the interior in consecutive
    pairs, which closes the chains into rings. Rings without a crossing are kept whole or dropped.
    """
    whole, chains = [], []
    for ring in polygon:
        d = sign * (ring[:-1, axis] - limit)
        keep = d >= 0
        if keep.all():
            whole.append(ring)
        elif keep.any():
            n = len(d)
            for start in np.flatnonzero(keep & ~np.roll(keep, 1)):
                prev = (start - 1) % n
                points = [_cross(ring[prev], ring[start], d[prev], d[start], axis, limit)]
                k = start
                while keep[k]:
                    points.append(ring[k])
                    last, k = k, (k + 1) % n
                points.append(_cross(ring[last], ring[k], d[last], d[k], axis, limit))
                chains.append(np.array(points))
    rings = _close_chains(chains, 1 - axis)
    shells = [r for r in rings if abs(_area(r)) > 0]
    # rings without a crossing: the outermost are shells of their own, the others holes of the shell around them
    shell_whole = [whole[0]] if whole and len(polygon) and whole[0] is polygon[0] else []
    holes = [r for r in whole if not (shell_whole and r is shell_whole[0])]
    out = [[s] for s in [*shell_whole, *shells]]
    for hole in holes:
        x, y = hole[:1, 0], hole[:1, 1]
        home = [p for p in out if inside_rings([p[0]], x, y)[0]] or out[:1]
        if home:
            min(home, key=lambda p: abs(_area(p[0]))).append(hole)
    return out


def _cross(a, b, da, db, axis, limit) -> np.ndarray:
    t = da / (da - db)
    point = a + t * (b - a)
    point[axis] = limit
    return point


def _close_chains(chains: list[np.ndarray], along: int) -> list[np.ndarray]:
    ends = sorted(((c[0, along], i, 0) for i, c in enumerate(chains)), key=lambda e: e[0]) + []
    ends = sorted([*ends, *((c[-1, along], i, 1) for i, c in enumerate(chains))], key=lambda e: e[0])
    partner = {}
    for left, right in zip(ends[::2], ends[1::2], strict=True):
        partner[left[1:]], partner[right[1:]] = right[1:], left[1:]
    rings, unused = [], set(range(len(chains)))
    while unused:
        first = min(unused)
        points, at, side = [], first, 0
        while at in unused:
            unused.remove(at)
            points.append(chains[at] if side == 0 else chains[at][::-1])
            at, side = partner[at, 1 - side]
        ring = np.concatenate(points)
        rings.append(np.vstack([ring, ring[:1]]))
    return rings


def _tidy(ring: np.ndarray) -> np.ndarray:
    keep = np.r_[True, (np.diff(ring, axis=0) != 0).any(axis=1)]
    return ring[keep]


def clip_box(geometry: Geometry | None, box: tuple[float, float, float, float]) -> Geometry | None:
    """The part of the geometry within the closed box; None where nothing of the same dimension is left.

    The type may change: a line or polygon that falls apart becomes its MULTI type.
    """
    if geometry is None:
        return None
    name, parts = geometry
    xmin, ymin, xmax, ymax = box
    if name == "GEOMETRYCOLLECTION":
        members = [m for m in (clip_box(member, box) for member in parts) if m]
        return (name, members) if members else None
    if name.endswith("POINT"):
        left = [p for p in parts if xmin <= p[0, 0] <= xmax and ymin <= p[0, 1] <= ymax]
    elif name.endswith("LINESTRING"):
        left = [piece for p in parts for piece in _clip_line(p, box)]
    else:
        left = parts
        for axis, limit, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
            left = [piece for polygon in left for piece in _clip_half_plane(polygon, axis, limit, sign)]
        left = [[_tidy(r) for r in polygon] for polygon in left]
        left = [polygon for polygon in left if len(polygon[0]) >= 4 and abs(_area(polygon[0])) > 0]
    if not left:
        return None
    base = name.removeprefix("MULTI")
    return (base, left) if len(left) == 1 and not (name.startswith("MULTI") and base == "POINT") else ("MULTI" + base, left)


def to_geojson(geometry: Geometry) -> dict:
    """GeoJSON geometry object."""
    # GeoJSON type names.
    titles = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    name, parts = geometry
    if name == "GEOMETRYCOLLECTION":
        return {"type": "GeometryCollection", "geometries": [to_geojson(g) for g in parts]}
    plain = [p[0].tolist() if name.endswith("POINT") else p.tolist() if name.endswith("LINESTRING") else [r.tolist() for r in p] for p in parts]
    return {"type": titles[name], "coordinates": plain if name.startswith("MULTI") else plain[0] if plain else []}


POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
BOX_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "xmax", "ymin", "ymax")])


@F.pandas_udf(POINT_TYPE)
def _point_xy(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for wkb in batches:
        n = len(wkb)
        xy = np.full((n, 2), np.nan)
        ok = np.zeros(n, bool)
        # the fixed 21 bytes of a little-endian point are read at once; whatever else goes through the walker
        plain = np.fromiter((w is not None and len(w) == 21 and w[:5] == b"\x01\x01\x00\x00\x00" for w in wkb), bool, n)
        if plain.any():
            xy[plain] = np.frombuffer(b"".join(w[5:] for w in wkb[plain]), "<f8").reshape(-1, 2)
            ok |= plain & ~np.isnan(xy).any(axis=1)
        for i in np.flatnonzero(~plain):
            g = decode(wkb.iat[i])
            if g and g[0] == "POINT" and g[1]:
                xy[i], ok[i] = g[1][0][0], True
        yield pd.DataFrame({"x": pd.Series(xy[:, 0]).where(ok, None), "y": pd.Series(xy[:, 1]).where(ok, None)})


def point_xy(geometry: Column) -> Column:
    """Struct (x, y) of a WKB point; nulls for null, empty, damaged and non-point geometry."""
    return _point_xy(geometry)


@F.pandas_udf(T.StringType())
def _type_name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for wkb in batches:
        yield pd.Series([NAMES.get(_code(w)) for w in wkb], dtype=object)


def _code(w: bytes | None) -> int | None:
    if w is None or len(w) < 5:
        return None
    return (int.from_bytes(w[1:5], "little" if w[0] == 1 else "big") & 0x0FFFFFFF) % 1000


def geometry_type(geometry: Column) -> Column:
    """POINT, LINESTRING, ... from the WKB header; null for null or unknown codes."""
    return _type_name(geometry)


@F.pandas_udf(BOX_TYPE)
def _bounds(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for wkb in batches:
        rows = [bounds(decode(w)) or (None,) * 4 for w in wkb]
        yield pd.DataFrame([(r[0], r[2], r[1], r[3]) for r in rows], columns=["xmin", "xmax", "ymin", "ymax"], dtype="float64")


def geometry_bounds(geometry: Column) -> Column:
    """Struct (xmin, xmax, ymin, ymax); its members are null for null and empty geometry."""
    return _bounds(geometry)


def intersects_extent(geometry: Column, extent) -> Column:
    """True if the geometry meets the extent; false for null."""
    box = (extent.xmin, extent.ymin, extent.xmax, extent.ymax)

    @F.pandas_udf(T.BooleanType())
    def meets(wkb: pd.Series) -> pd.Series:
        return pd.Series([intersects_box(decode(w), box) for w in wkb], dtype=bool)

    return meets(geometry)


def clip_extent(geometry: Column, extent) -> Column:
    """The geometry within the extent as WKB, null where nothing is left."""
    box = (extent.xmin, extent.ymin, extent.xmax, extent.ymax)

    @F.pandas_udf(T.BinaryType())
    def clip(wkb: pd.Series) -> pd.Series:
        clipped = (clip_box(decode(w), box) for w in wkb)
        return pd.Series([encode(g) if g else None for g in clipped], dtype=object)

    return clip(geometry)


# Spherical Mercator.
_MERCATOR_RADIUS = 6378137.0
_MERCATOR_WKIDS = (3857, 102100)


def needs_projection(wkid: int | None) -> bool:
    """An unknown reference (None) counts as needing projection."""
    return wkid != 4326


def project_to_wgs84(x: Column, y: Column, wkid: int | None) -> tuple[Column, Column]:
    """Longitude and latitude from WGS84 or spherical Mercator; other references raise ValueError."""
    if wkid == 4326:
        return x, y
    if wkid not in _MERCATOR_WKIDS:
        raise ValueError(f"unsupported spatial reference: {wkid}")
    return F.degrees(x / _MERCATOR_RADIUS), F.degrees(F.atan(F.sinh(y / _MERCATOR_RADIUS)))
