"""Small declarative rules on layers: draw order, labels, land-use classes, scales, estimates, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.options import Extent

# Draw ranks by type and geometry family, and by type alone.
DRAW_RANKS = {
    "place:point": 330, "division:point": 326, "address:point": 318, "connector:point": 314, "infrastructure:point": 312, "land:point": 308, "water:point": 306,
    "segment:line": 304, "division_boundary:line": 300, "infrastructure:line": 296, "water:line": 294, "land_use:line": 292, "land:line": 290,
    "building:polygon": 286, "building_part:polygon": 284, "infrastructure:polygon": 278, "division_area:polygon": 276, "division:polygon": 274, "land_use:polygon": 272, "land_cover:polygon": 268, "land:polygon": 264, "bathymetry:polygon": 260, "water:polygon": 256,
    "building": 286, "building_part": 284, "segment": 304, "address": 318, "place": 330, "water": 256, "bathymetry": 260,
}
FAMILY_RANKS = {"point": 300, "line": 200, "polygon": 100}
# Words in a layer's name and the type they tell, the first that fits.
NAME_TYPES = ("building part", "building", "land use", "land cover", "division boundary", "division area", "infrastructure", "bathymetry", "water", "land", "segment", "connector", "address", "place", "division")
# Features per square kilometre and kilobytes per feature.
DENSITIES = {"address": 500, "land": 100, "water": 50, "land_use": 40, "land_cover": 40, "bathymetry": 20, "infrastructure": 50, "building": 700, "building_part": 100, "division": 30, "division_boundary": 40, "division_area": 30, "place": 250, "connector": 150, "segment": 600}
FEATURE_KB = 2.5
# Road classes with labels.
PRIMARY_ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary")
LOCAL_ROADS = ("residential", "service", "living_street", "pedestrian", "track", "unclassified")
# Land-use groups and smallest scales of points.
LAND_USE = {"park": "park garden recreation_ground nature_reserve", "residential": "residential", "commercial": "commercial retail", "industrial": "industrial", "education": "education school university", "hospital": "hospital", "cemetery": "cemetery", "military": "military"}
POINT_SCALES = {"address": 6000, "connector": 12000, "place": 10000, "division": 40000, "infrastructure": 22000, "land": 28000}
OTHER_SCALE = 25000
# Country boxes (west, south, east, north), the first that holds the centre.
COUNTRIES = (("US", -125, 24, -66, 50), ("CA", -141, 41, -52, 84), ("MX", -118, 14, -86, 33), ("BR", -75, -34, -34, 5), ("FR", -5, 41, 10, 52), ("GB", -10, 50, 5, 61), ("DE", 6, 47, 15, 55), ("IT", 10, 36, 19, 47), ("ES", -4, 35, 5, 44), ("AU", 124, -44, 154, -10), ("NZ", 165, -48, 180, -34), ("NZ", -180, -48, -165, -34))


def _lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, null where the key isn't in it."""
    if not table:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def geometry_family(geometry_type: Column) -> Column:
    t = F.upper(geometry_type)
    return F.when(t.contains("POINT"), "point").when(t.contains("LINE"), "line").otherwise("polygon")


def layer_type(type_: Column, theme: Column, name: Column) -> Column:
    """The type, else the theme, else what the layer's name tells, else null."""
    low, told = F.lower(F.coalesce(name, F.lit(""))), F.lit(None).cast("string")
    for word in reversed(NAME_TYPES):
        told = F.when(low.contains(word), word.replace(" ", "_")).otherwise(told)
    return F.coalesce(F.nullif(F.lower(F.trim(type_)), F.lit("")), F.nullif(F.lower(F.trim(theme)), F.lit("")), told)


def draw_rank(type_: Column, theme: Column, name: Column, geometry_type: Column, style: dict[str, int] | None = None) -> Column:
    """Style's then default rank of type and family, style's then default rank of the type, else the family's."""
    kind, family = layer_type(type_, theme, name), geometry_family(geometry_type)
    exact, styled = F.concat_ws(":", kind, family), {k.lower(): v for k, v in (style or {}).items()}
    ranks = [_lookup(exact, styled), _lookup(exact, DRAW_RANKS), _lookup(kind, styled), _lookup(kind, DRAW_RANKS)]
    return F.coalesce(*[F.when(kind.isNotNull(), r) for r in ranks], _lookup(family, FAMILY_RANKS)).cast("long")


def draw_order(layers: DataFrame, style: dict[str, int] | None = None) -> DataFrame:
    """layers (theme, type, name, geometry_type) with draw_rank, top layer first."""
    ranked = layers.withColumn("draw_rank", draw_rank(F.col("type"), F.col("theme"), F.col("name"), F.col("geometry_type"), style))
    return ranked.orderBy(F.desc("draw_rank"), F.col("theme").asc_nulls_last(), F.col("type").asc_nulls_last(), F.col("name").asc_nulls_last())


def family_counts(layers: DataFrame) -> DataFrame:
    """family, n of layers by their geometry_type."""
    return layers.groupBy(geometry_family(F.col("geometry_type")).alias("family")).agg(F.count("*").alias("n")).orderBy("family")


def size_estimate(types: DataFrame) -> DataFrame:
    """features_per_km2 and kb_per_km2 of the chosen types (column type); unknown types count nothing."""
    density = F.coalesce(_lookup(F.col("type"), DENSITIES), F.lit(0))
    total = types.agg(F.coalesce(F.sum(density), F.lit(0)).cast("long").alias("features_per_km2"))
    return total.withColumn("kb_per_km2", F.col("features_per_km2") * FEATURE_KB)


def theme_types(spark: SparkSession) -> DataFrame:
    from geoweft.operators.extract import THEMES

    return spark.createDataFrame([(theme, t) for theme, types in THEMES.items() for t in types], "theme string, type string")


def layer_label(theme: str, type_: str) -> str:
    title = lambda s: " ".join(w.capitalize() for w in s.split("_"))
    return f"{title(theme)} - {title(type_)}"


def road_labels(df: DataFrame, local: bool = False) -> DataFrame:
    named = F.col("names_primary").isNotNull()
    if "names_common_key_value_value" in df.columns:
        named = named | F.col("names_common_key_value_value").isNotNull()
    return df.where(F.col("class").isin(*(LOCAL_ROADS if local else PRIMARY_ROADS)) & named)


def land_use_class(subtype: Column) -> Column:
    return _lookup(F.lower(subtype), {w: group for group, words in LAND_USE.items() for w in words.split()})


def point_min_scale(type_: str | None, profile: dict[str, int] | None = None) -> int:
    return (profile or {}).get(type_ or "", POINT_SCALES.get((type_ or "").lower(), OTHER_SCALE))


def extent_source(use_map: bool, has_map: bool, use_custom: bool, has_custom: bool) -> str:
    return "map" if use_map and has_map else "custom" if use_custom and has_custom else "none"


def country_of(extent: Extent | None) -> str | None:
    if extent is None:
        return None
    x, y = (extent.xmin + extent.xmax) / 2, (extent.ymin + extent.ymax) / 2
    return next((c for c, w, s, e, n in COUNTRIES if w <= x <= e and s <= y <= n), None)


def extent_of(df: DataFrame, longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
    """One row xmin, ymin, xmax, ymax over finite positions; nulls for none."""
    ok = df.where(~F.isnan(longitude) & ~F.isnan(latitude) & (F.abs(longitude) < float("inf")) & (F.abs(latitude) < float("inf")))
    return ok.agg(F.min(longitude).alias("xmin"), F.min(latitude).alias("ymin"), F.max(longitude).alias("xmax"), F.max(latitude).alias("ymax"))
