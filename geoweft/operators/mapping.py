"""Rules on field names and assembled values of local layers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.functions.text import blank_to_null, clean
from geoweft.functions.wkb import geometry_bounds, needs_projection, project_to_wgs84

# Names of id fields in order of preference, row pointers, and names of the other fields by role.
PREFERRED_IDS = "globalid guid uuid uniqueid unique_id site_id siteid address_id addressid facility_id facilityid place_id placeid asset_id assetid record_id recordid feature_id featureid unit_id unitid ng911_id ng911id loc_id locid id".split()
ROW_POINTERS = frozenset("objectid oid fid rowid esrioid".split())
ROLES = {
    "name": "name business_name poi_name label title", "address": "address full_address street_address addr situs",
    "number": "address_number address_num addressno house_number housenumber addrnum saddno situs_number number", "fraction": "address_fraction fraction saddfrac",
    "prefix": "address_prefix address_street_prefix address_direction street_direction street_dir street_pre_direction street_predirection street_pre_dir street_prefix street_predir predir pre_direction pre_dir saddpref prefix",
    "street": "address_street_name address_street address_road street_name street road saddstr streetname", "type": "address_street_type address_type street_type sttype saddsttyp street_suffix_type",
    "suffix": "address_suffix address_street_suffix address_post_direction street_suffix street_post_direction street_postdirection street_post_dir street_postdir postdir post_direction post_dir saddstsuf suffix",
    "unit": "address_unit unit apt apartment suite sunit", "city": "address_zipcity city locality town scity", "state": "address_state state region province state2", "postcode": "address_zip5 postcode postal_code zip zip5 address_zip4",
}
POSTCODE_FALLBACKS = "address_zip5 zip5 postcode postal_code zip address_zip4".split()
LOCATOR_ROLES = {
    "HouseNumber": "number housenumber house_number", "StreetName": "street street_name road name", "POIName": "name name_primary brand", "Category": "category class kind subtype",
    "City": "city locality district", "Region": "region state province admin1", "Postal": "postcode postal_code zip", "CountryCode": "country_code country",
}
_NAMESPACE = uuid.UUID("6f8f57d4-1a6b-4a51-9d0e-2f3b8f6f0a11")


def field_key(name: str | None) -> str:
    return re.sub(r"[\W_]+", "", (name or "").lower())


def is_row_pointer(name: str | None) -> bool:
    return field_key(name) in ROW_POINTERS


def preferred_id_field(fields: Iterable[str]) -> str | None:
    """A durable key: the first preferred name, else the first field by name with guid or uuid in it or id at its end; never
    a row pointer."""
    usable = [f for f in dict.fromkeys(fields) if f and f.strip() and not is_row_pointer(f)]
    by_key: dict[str, str] = {}
    for f in usable:
        by_key.setdefault(field_key(f), f)
    for name in PREFERRED_IDS:
        if field_key(name) in by_key:
            return by_key[field_key(name)]
    likely = [f for f in sorted(usable, key=str.lower) if re.search(r"guid|uuid|id$", field_key(f))]
    return likely[0] if likely else None


def id_choice(fields: Iterable[str]) -> tuple[str | None, bool]:
    """(field, generate): the durable key, or - where there is none - a row pointer if the layer has one, with generated ids."""
    fields = [f for f in fields if f]
    durable = preferred_id_field(fields)
    return (durable, False) if durable else (next((f for f in fields if is_row_pointer(f)), None), True)


def map_fields(fields: Iterable[str]) -> dict[str, str | None]:
    """Role -> field, None where no name fits."""
    by_key: dict[str, str] = {}
    for f in fields:
        by_key.setdefault(field_key(f), f)
    return {role: next((by_key[field_key(n)] for n in names.split() if field_key(n) in by_key), None) for role, names in ROLES.items()}


def locator_roles(fields: Iterable[str]) -> dict[str, str]:
    """Role -> field of a locator; exact names."""
    have = set(fields)
    return {role: hit for role, names in LOCATOR_ROLES.items() if (hit := next((n for n in names.split() if n in have), None))}


def assemble_address(df: DataFrame, fields: dict[str, str | None]) -> Column:
    """The full address if it isn't blank, else its parts in order."""
    value = lambda role: clean(F.col(fields[role])) if fields.get(role) in df.columns and fields.get(role) else F.lit("")
    parts = [blank_to_null(value(r)) for r in ("number", "fraction", "prefix", "street", "type", "suffix", "unit")]
    return F.coalesce(blank_to_null(value("address")), F.concat_ws(" ", *parts))


def assemble_postcode(df: DataFrame, field: str | None) -> Column:
    """The field's value if it has a digit, else that of the first known alias that has one, else ''."""
    have = {c.lower(): c for c in df.columns}
    names = ([field] if field in df.columns and field else []) + [have[n] for n in POSTCODE_FALLBACKS if n in have]
    return F.coalesce(*[F.when(clean(F.col(n)).rlike("[0-9]"), clean(F.col(n))) for n in names], F.lit(""))


@F.pandas_udf(T.StringType())
def _stable_uuid(keys: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else str(uuid.uuid5(_NAMESPACE, k)) for k in keys], dtype=object)


def stable_id(key: Column) -> Column:
    """A UUID that is a function of the key, so a repeated run gives the same; null for null."""
    return _stable_uuid(key.cast("string"))


def with_record_ids(df: DataFrame, id_field: str, generate: bool = False) -> DataFrame:
    """Adds record_id and source_record_key. The id is a stable UUID of the key if asked for or if the field is a row
    pointer, else the key. A blank key becomes 'row-' and a hash of the whole row: the same row gets the same, wherever it
    stands; rows that are equal in all columns share it."""
    key = F.trim(F.col(id_field).cast("string"))
    filled = F.when(key != "", key).otherwise(F.concat(F.lit("row-"), F.hex(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, t in df.dtypes if not t.startswith(("map", "variant"))]))))
    keyed = df.withColumn("source_record_key", filled)
    return keyed.withColumn("record_id", stable_id(F.col("source_record_key")) if generate or is_row_pointer(id_field) else F.col("source_record_key"))


def relate_key(id_field: str | None, generate: bool) -> str:
    return "source_record_key" if generate or is_row_pointer(id_field) else "record_id"


def mapping_preview(df: DataFrame, fields: dict[str, str | None], id_field: str | None, generate: bool = False, rows: int = 25) -> dict:
    """Samples of the first rows and what looks wrong with the mapping; a preview, so no more than ``rows`` rows are read."""
    sample = df.limit(rows).select(assemble_address(df, fields).alias("a"), assemble_postcode(df, fields.get("postcode")).alias("p"), *[(F.col(fields[r]).cast("string") if fields.get(r) else F.lit(None).cast("string")).alias(r) for r in ("postcode", "unit")]).collect()
    distinct = lambda values: list({v.lower(): v for v in reversed([v for v in values if v and v.strip()])}.values())[::-1][:3]
    warnings = []
    if not id_field:
        warnings.append("Choose a durable key or generate ids.")
    elif is_row_pointer(id_field) and not generate:
        warnings.append(f"{id_field} is a row pointer that changes when data is loaded anew.")
    if not fields.get("address") and not fields.get("street"):
        warnings.append("No address or street field is chosen.")
    written = [r.postcode for r in sample if r.postcode and r.postcode.strip()]
    if written and not any(re.search(r"\d", v) for v in written):
        warnings.append(f"{fields['postcode']} has no digits; known postcode fields are used where they have some.")
    if any(re.search(r"direction|predir|postdir|dir$", field_key(c)) for c in df.columns) and not fields.get("prefix") and not fields.get("suffix"):
        warnings.append("A field looks like a street direction, but prefix and suffix are empty.")
    if any(r.unit and r.unit.strip() for r in sample):
        warnings.append("Units are there; the target may only have base addresses.")
    return {"addresses": distinct([r.a for r in sample]), "postcodes": distinct([r.p for r in sample]), "warnings": warnings}


def layer_points(df: DataFrame, wkid: int | None = 4326) -> DataFrame:
    """df with longitude and latitude in WGS84 degrees: of a point itself, of other geometry the centre of its bounds. Rows
    with null, empty or damaged geometry or a position that isn't finite are left out."""
    if needs_projection(wkid) and wkid is None:
        raise ValueError("the layer has no spatial reference")
    boxed = df.withColumn("_b", geometry_bounds(F.col("geometry"))).where(F.col("_b.xmin").isNotNull())
    lon, lat = project_to_wgs84((F.col("_b.xmin") + F.col("_b.xmax")) / 2, (F.col("_b.ymin") + F.col("_b.ymax")) / 2, wkid)
    out = boxed.withColumn("longitude", lon).withColumn("latitude", lat).drop("_b")
    return out.where(F.col("longitude").between(-1e9, 1e9) & F.col("latitude").between(-1e9, 1e9))
