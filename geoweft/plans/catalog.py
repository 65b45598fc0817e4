"""A catalog document over a folder of Parquet datasets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.functions.wkb import geometry_type
from geoweft.operators.extract import excluded

# Renamed fields, boolean fields kept as text, flattened structs, field orders, type names.
RENAMED = {"division": {"perspectives": "perspectives_mode", "norms": "norms_driving_side"}}
BOOLEANS = frozenset("has_parts is_underground is_land is_territorial is_salt is_intermittent".split())
BBOX = ("bbox_xmin", "bbox_xmax", "bbox_ymin", "bbox_ymax")
CARTOGRAPHY = ("prominence", "min_zoom", "max_zoom", "sort_key")
_BUILDING = "facade_color facade_material roof_material roof_shape roof_direction roof_orientation roof_color roof_height"
ORDERS = {
    "address": "country postcode street number unit postal_city version",
    "building": f"version level subtype class height names_primary has_parts is_underground num_floors num_floors_underground min_height min_floor {_BUILDING}",
    "building_part": f"version level height names_primary is_underground num_floors num_floors_underground min_height min_floor {_BUILDING} building_id",
    "connector": "version",
    "division": "country version cartography_prominence cartography_min_zoom cartography_max_zoom cartography_sort_key subtype class names_primary wikidata region perspectives_mode parent_division_id norms_driving_side population",
    "division_area": "country version subtype class names_primary is_land is_territorial region division_id",
    "infrastructure": "version level subtype class height surface names_primary wikidata",
    "land": "version level subtype class surface names_primary wikidata elevation",
    "land_cover": "version cartography_prominence cartography_min_zoom cartography_max_zoom cartography_sort_key subtype",
    "land_use": "version level subtype class surface names_primary wikidata",
    "place": "version names_primary categories_primary confidence brand_wikidata brand_names_primary",
    "segment": "version subtype class names_primary subclass",
    "water": "version level subtype class names_primary wikidata is_salt is_intermittent",
}
TYPES = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "date": "Date", "binary": "Binary"}
GEOMETRIES = {"POINT": "esriGeometryPoint", "MULTIPOINT": "esriGeometryPoint", "LINESTRING": "esriGeometryPolyline", "MULTILINESTRING": "esriGeometryPolyline", "POLYGON": "esriGeometryPolygon", "MULTIPOLYGON": "esriGeometryPolygon"}


def field_type(kind: T.DataType) -> str:
    """Catalog type of a Spark type; String for text, booleans, times and nested types."""
    return "Float64" if isinstance(kind, T.DecimalType) else TYPES.get(kind.simpleString(), "String")


def fields_of(schema: T.StructType, dataset: str, geometry: str = "geometry") -> list[dict]:
    """Ordered fields of a dataset: exclusions, renames, flattened structs, the four bbox fields always, brands of places."""
    found: dict[str, dict] = {}

    def add(name: str, kind: str, source: str | None = None) -> None:
        found.setdefault(name.lower(), {"name": name, "type": kind} | ({"sourceType": source} if source else {}))

    for f in schema.fields:
        if f.name.lower() in excluded(dataset):
            continue
        name = RENAMED.get(dataset.lower(), {}).get(f.name.lower(), f.name)
        low, nested = name.lower(), isinstance(f.dataType, T.StructType)
        if low == geometry:
            add(name, "Binary")
        elif low in BBOX:
            add(name, "Float32")
        elif low == "bbox":
            continue
        elif low in ("names", "categories") and nested:
            add(f"{name}_primary", "String")
        elif low == "cartography" and nested:
            for part in CARTOGRAPHY:
                add(f"cartography_{part}", "Int32")
        elif low in BOOLEANS:
            add(name, "String", "Boolean")
        else:
            add(name, field_type(f.dataType))
    for name in BBOX:
        add(name, "Float32")
    if dataset.lower() == "place":
        add("brand_wikidata", "String")
        add("brand_names_primary", "String")
    order = ORDERS.get(dataset.lower())
    listed = ["id", *BBOX, *(order.split() + ["filename", "theme", "type", geometry] if order else [])]
    first = [found.pop(n) for n in listed if n in found]
    last = [found.pop(geometry)] if geometry in found else []
    return first + sorted(found.values(), key=lambda f: f["name"].lower()) + last


def catalog_fields(frames: dict[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    return [(name, i, f["name"], f["type"]) for name, df in frames.items() for i, f in enumerate(fields_of(df.schema, name))]


def geometry_kind(spark: SparkSession, files: list[str]) -> str:
    """Type of the first non-null geometry in the first three files; Any if none is found."""
    for path in files[:3]:
        df = spark.read.parquet(path)
        if "geometry" in df.columns:
            row = df.where("geometry is not null").select(geometry_type(F.col("geometry")).alias("t")).limit(1).first()
            if row is not None and row.t is not None:
                return GEOMETRIES.get(row.t, "esriGeometryPoint")
    return "esriGeometryAny"


def build(spark: SparkSession, folder: str) -> dict:
    """The document: a dataset per sub-folder with Parquet files, its schema that of the first file by name."""
    datasets = []
    for sub in sorted(p for p in Path(folder).iterdir() if p.is_dir()):
        files = sorted(str(f) for f in sub.rglob("*.parquet") if f.is_file())
        if not files:
            continue
        fields = fields_of(spark.read.parquet(files[0]).schema, sub.name)
        entry = {"name": sub.name, "properties": {"fileformat": "parquet"}, "fields": fields}
        if any(f["name"].lower() == "geometry" for f in fields):
            entry["geometry"] = {"geometryType": geometry_kind(spark, files), "spatialReference": {"wkid": 4326}, "fields": [{"name": "geometry", "formats": ["WKB"]}]}
        datasets.append(entry)
    return {"connection": {"type": "filesystem", "properties": {"path": str(folder)}}, "datasets": datasets}


def write(document: dict, path: str) -> None:
    """Indented JSON without nulls."""

    def pruned(x):
        if isinstance(x, dict):
            return {k: pruned(v) for k, v in x.items() if v is not None}
        return [pruned(v) for v in x] if isinstance(x, list) else x

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(pruned(document), indent=2), encoding="utf-8")
