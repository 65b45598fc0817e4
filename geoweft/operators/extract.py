"""Extracting one type of a themed lake: pruned columns, extent, clip, flattened and provenance columns, geometry types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import provenance
from geoweft.functions.text import LIST_SEPARATOR
from geoweft.functions.wkb import clip_extent, geometry_bounds, geometry_type, intersects_extent
from geoweft.operators.linking import flattened
from geoweft.options import Extent
from geoweft.sources.readers import read_lake

# Columns that a layer of a type doesn't have.
EXCLUDED = {
    "address": "address_levels sources", "building": "sources", "building_part": "sources", "connector": "sources", "division": "capital_division_ids capital_of_divisions hierarchies local_type sources", "division_area": "sources",
    "infrastructure": "source_tags sources", "land": "source_tags sources", "land_cover": "sources", "land_use": "source_tags sources", "place": "addresses brand emails phones socials sources websites",
    "segment": "access_restrictions connectors destinations level_rules prohibited_transitions road_flags road_surface routes sources speed_limits subclass_rules width_rules", "water": "source_tags sources",
}
# Types of points, which are filtered and never clipped.
POINT_TYPES = frozenset(("address", "place", "connector"))
# Types by theme.
THEMES = {
    "addresses": ["address"], "base": ["land", "water", "land_use", "land_cover", "bathymetry", "infrastructure"], "buildings": ["building", "building_part"],
    "divisions": ["division", "division_boundary", "division_area"], "places": ["place"], "transportation": ["connector", "segment"],
}
GEOMETRY_TYPE = "geom_type"


def excluded(type_: str | None) -> frozenset[str]:
    return frozenset(EXCLUDED.get((type_ or "").lower(), "").split())


def project_columns(df: DataFrame, type_: str | None) -> DataFrame:
    """Without the type's excluded columns; geometry and bbox_* always stay. An unknown type keeps all, and so does one
    that would keep none."""
    out = excluded(type_)
    kept = [c for c in df.columns if c.lower() not in out or c.lower() == "geometry" or c.lower().startswith("bbox_")]
    return df.select(*kept) if kept else df


def in_extent(df: DataFrame, extent: Extent | None) -> DataFrame:
    """Rows whose bbox meets the extent, in four comparisons that reach the scan; all rows without extent or bbox."""
    if extent is None or "bbox" not in df.columns:
        return df
    return df.where((F.col("bbox.xmin") <= extent.xmax) & (F.col("bbox.xmax") >= extent.xmin) & (F.col("bbox.ymin") <= extent.ymax) & (F.col("bbox.ymax") >= extent.ymin))


def flatten_addresses(df: DataFrame) -> DataFrame:
    """Adds address_freeform, _locality, _region, _postcode and _country of the list of addresses where they aren't there."""
    if "addresses" not in df.columns:
        return df
    have = {c.lower() for c in df.columns}
    return df.withColumns({f"address_{f}": flattened(f) for f in ("freeform", "locality", "region", "postcode", "country") if f"address_{f}" not in have})


def _first(field: str) -> Column:
    values = F.transform(F.col("sources"), lambda s: s[field].cast("string"))
    return F.get(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(0))


def add_provenance(df: DataFrame) -> DataFrame:
    """Adds the nine source_* columns of the list of sources where they aren't there. The primary fields are each the first
    non-blank one of the list, so they may come from different sources."""
    if "sources" not in df.columns:
        return df
    names = F.transform(F.col("sources"), lambda s: s["dataset"].cast("string"))
    datasets = F.array_distinct(F.filter(names, lambda v: v.isNotNull() & (F.trim(v) != "")))
    count = F.size(F.filter("sources", lambda s: s["dataset"].isNotNull() | s["record_id"].isNotNull()))
    df = df.withColumns({"_d": _first("dataset"), "_r": _first("record_id"), "_u": _first("update_time")})
    edit, contribution = provenance.edit_url(F.col("_d"), F.col("_r")), provenance.contribution_url(F.col("_d"))
    columns = {
        "source_count": F.when(F.col("sources").isNull(), 0).otherwise(count).cast("long"), "source_datasets": F.when(F.size(datasets) > 0, F.array_join(datasets, LIST_SEPARATOR)), "source_primary_dataset": F.col("_d"), "source_primary_record_id": F.col("_r"), "source_primary_update_time": F.col("_u"),
        "source_url": F.coalesce(edit, contribution), "source_edit_url": edit, "source_contribution_url": contribution, "source_edit_platform": provenance.platform(F.col("_d")),
    }
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: c for n, c in columns.items() if n not in have}).drop("_d", "_r", "_u")


def clipped(df: DataFrame, type_: str | None, extent: Extent | None) -> DataFrame:
    """Geometry that meets the extent, cut to it with a new bbox unless the type is one of points. Without bbox the
    geometry alone decides."""
    if extent is None or "geometry" not in df.columns:
        return df
    met = df.where(intersects_extent(F.col("geometry"), extent))
    if (type_ or "").lower() in POINT_TYPES:
        return met
    cut_ = met.withColumn("geometry", clip_extent(F.col("geometry"), extent)).where("geometry is not null")
    return with_bounds(cut_) if "bbox" in df.columns else cut_


def with_bounds(df: DataFrame) -> DataFrame:
    """bbox anew from the geometry, null for null."""
    box = geometry_bounds(F.col("geometry"))
    return df.withColumn("_b", box).withColumn("bbox", F.when(F.col("_b.xmin").isNotNull(), F.struct(*[F.col(f"_b.{n}").alias(n) for n in ("xmin", "xmax", "ymin", "ymax")]))).drop("_b")


def with_geometry_type(df: DataFrame) -> DataFrame:
    return df.withColumn(GEOMETRY_TYPE, geometry_type(F.col("geometry")))


def shape(df: DataFrame, type_: str | None, extent: Extent | None = None, provenance_columns: bool = False) -> DataFrame:
    """The whole extract of a table: filter, derived columns, pruned columns, clip and geometry type, in this order: what
    the scan can do comes first, Python sees only rows that are left."""
    out = in_extent(df, extent)
    if (type_ or "").lower() == "place":
        out = flatten_addresses(out)
    if provenance_columns:
        out = add_provenance(out)
    out = clipped(project_columns(out, type_), type_, extent)
    return with_geometry_type(out) if "geometry" in out.columns else out


def load(spark: SparkSession, path: str, type_: str | None, extent: Extent | None = None, provenance_columns: bool = False) -> DataFrame:
    return shape(read_lake(spark, path), type_, extent, provenance_columns)


def geometry_type_counts(df: DataFrame) -> DataFrame:
    """geom_type, n in stacking order: polygons below lines below points below the rest."""
    t = F.col(GEOMETRY_TYPE)
    rank = F.when(t.endswith("POLYGON"), 1).when(t.endswith("LINESTRING"), 2).when(t.endswith("POINT"), 3).otherwise(99)
    counted = df.groupBy(GEOMETRY_TYPE).agg(F.count("*").alias("n"))
    return counted.orderBy(rank, F.col(GEOMETRY_TYPE).asc_nulls_last())
