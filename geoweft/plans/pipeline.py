"""Queries over the place and area tables as they are delivered - nested names, lists of addresses, WKB geometry - and over
files that are written and read again. The SQL decodes WKB by hand and is built otherwise than the operators.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions.wkb import point_xy
from geoweft.operators import linking, mapping, rules
from geoweft.options import Extent, LinkOptions
from geoweft.plans.core import ORACLES, P3_NEAR_SQL, query, table
from geoweft.plans.reference import CANDIDATE_DOUBLES, USERS_SQL, link_pairs, place_candidates_sql, replaced, rounded, users
from geoweft.session import cut, shared_dir
from geoweft.sources import readers, writers


def _number(h: str, at: str, width: int, kind: str) -> str:
    """SQL of a little-endian number of width bytes at a place of a hex text."""
    return f"unhex(array_to_string(list_transform(range({width - 1}, -1, -1), lambda b: substr({h}, CAST({at} + 2 * b AS BIGINT), 2)), ''))::BIT::{kind}"


POINTS_SQL = f"SELECT *, {_number('h', '11', 8, 'DOUBLE')} AS lon, {_number('h', '27', 8, 'DOUBLE')} AS lat FROM (SELECT *, hex(geometry) AS h FROM overture_place WHERE geometry IS NOT NULL)"
RINGS_SQL = f"""
rings AS (
  SELECT id, h, 0 AS ring, {_number('h', '11', 4, 'INTEGER')} AS n_rings, {_number('h', '19', 4, 'INTEGER')} AS n, 27 AS pos FROM (SELECT id, hex(geometry) AS h FROM division_area)
  UNION ALL SELECT id, h, ring + 1, n_rings, {_number('h', '(pos + 32 * n)', 4, 'INTEGER')}, pos + 32 * n + 8 FROM rings WHERE ring + 1 < n_rings
), corners AS (
  SELECT id, ring, i, {_number('h', '(pos + 32 * i)', 8, 'DOUBLE')} AS x, {_number('h', '(pos + 32 * i + 16)', 8, 'DOUBLE')} AS y FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS i FROM rings)
)"""


@query("overture_points", f"SELECT id, lon AS longitude, lat AS latitude FROM ({POINTS_SQL})")
def overture_points(spark: SparkSession, directory: str) -> DataFrame:
    """Positions of all places out of their WKB points."""
    at = point_xy(F.col("geometry"))
    return table(spark, directory, "overture_place").where("geometry is not null").select("id", at.alias("p")).select("id", F.col("p.x").alias("longitude"), F.col("p.y").alias("latitude"))


def _list(field: str, distinct: bool, left: int | None = None) -> str:
    value = f"left(adr.{field}, {left})" if left else f"adr.{field}"
    kept = f"list_transform(list_filter(addresses, lambda adr: adr.{field} IS NOT NULL AND trim(adr.{field}) <> ''), lambda adr: {value})"
    kept = f"list_filter({kept}, lambda v, i: list_position({kept}, v) = i)" if distinct else kept
    return f"coalesce(array_to_string({kept}, ' | '), '')"


def _linked_sql(where: str) -> str:
    """The candidates of the records among the places as delivered."""
    flat = f"""SELECT id, coalesce(names['primary'], '') AS title, {_list('freeform', False)} AS street, {_list('locality', True)} AS town, {_list('region', True)} AS region, {_list('postcode', True, 5)} AS code, lon, lat FROM ({POINTS_SQL}), box {where}"""
    box = "box AS (SELECT min(longitude) - 75 / 50000.0 AS w, max(longitude) + 75 / 50000.0 AS e, min(latitude) - 75 / 50000.0 AS s, max(latitude) + 75 / 50000.0 AS n FROM users)"
    return f"WITH {USERS_SQL}, {box}, {link_pairs(flat)}, {place_candidates_sql()} SELECT {replaced(CANDIDATE_DOUBLES)} FROM candidates"


@query("link_overture_places", _linked_sql(""))
def link_overture_places(spark: SparkSession, directory: str) -> DataFrame:
    """The whole link of the records with the places as they are delivered: names, lists of addresses, WKB points."""
    return rounded(linking.link(users(spark, directory), table(spark, directory, "overture_place"), LinkOptions()).candidates, CANDIDATE_DOUBLES)


@query("link_clipped", "SELECT record_id, gers_id, overture_name, overture_address, gers_match_score FROM (" + _linked_sql("WHERE bbox['xmin'] <= box.e AND bbox['xmax'] >= box.w AND bbox['ymin'] <= box.n AND bbox['ymax'] >= box.s") + ") WHERE accepted")
def link_clipped(spark: SparkSession, directory: str) -> DataFrame:
    """The accepted links with the places read in the buffered extent of the records alone."""
    found = linking.link(users(spark, directory), table(spark, directory, "overture_place"), LinkOptions(clip_to_extent=True, buffer_extent=True)).accepted
    return rounded(found, CANDIDATE_DOUBLES).select("record_id", "gers_id", "overture_name", "overture_address", "gers_match_score")


ORACLES["layer_points"] = f"WITH RECURSIVE {RINGS_SQL} SELECT id, round((min(x) + max(x)) / 2, 9) AS longitude, round((min(y) + max(y)) / 2, 9) AS latitude FROM corners GROUP BY id"
ORACLES["p3_found"] = f"""
WITH RECURSIVE {RINGS_SQL}, sides AS (
  SELECT * FROM (SELECT id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM corners WINDOW w AS (PARTITION BY id, ring ORDER BY i)) WHERE x2 IS NOT NULL
), u AS (
  SELECT DISTINCT record_id, longitude, latitude FROM gers_user_input WHERE record_id IS NOT NULL AND isfinite(longitude) AND isfinite(latitude) AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90
), boxes AS (SELECT id, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n FROM corners GROUP BY id)
SELECT DISTINCT record_id, 'within' AS relation, id AS other_id FROM (
  SELECT u.record_id, u.longitude, u.latitude, b.id FROM u JOIN boxes b ON u.longitude BETWEEN b.w AND b.e AND u.latitude BETWEEN b.s AND b.n JOIN sides k ON k.id = b.id
  WHERE (k.y > u.latitude) <> (k.y2 > u.latitude) AND u.longitude < (k.x2 - k.x) * (u.latitude - k.y) / (k.y2 - k.y) + k.x GROUP BY ALL HAVING count(*) % 2 = 1)
UNION ALL SELECT record_id, 'near', other_id FROM ({P3_NEAR_SQL})"""
_UUID = mapping._NAMESPACE.hex
_SHA = f"sha1(unhex('{_UUID}') || encode(key))"
ORACLES["stable_record_ids"] = f"""
SELECT id, concat_ws('-', substr(s, 1, 8), substr(s, 9, 4), '5' || substr(s, 14, 3), substr('89ab', 1 + instr('0123456789abcdef', substr(s, 17, 1)) % 4 - if(instr('0123456789abcdef', substr(s, 17, 1)) % 4 = 0, -3, 1), 1) || substr(s, 18, 3), substr(s, 21, 12)) AS record_id, key AS source_record_key
FROM (SELECT id, key, {_SHA} AS s FROM (SELECT id, trim(id) AS key FROM gers_bridge WHERE trim(id) <> ''))"""


def _folder(spark: SparkSession) -> str:
    """A new folder for files that a query writes to read them again, beside the tables of cut()."""
    return f"{shared_dir(spark).rstrip('/')}/cuts-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@query("lake_round_trip", "SELECT id, names['primary'] AS name, hex(geometry) AS wkb, bbox['xmin'] AS xmin, 'places' AS theme, 'place' AS type FROM overture_place")
def lake_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Places written as GeoParquet into a lake's folders and read with their partitions."""
    root = _folder(spark)
    writers.write_geoparquet(table(spark, directory, "overture_place"), readers.lake_path(root, "r1", "places", "place"), "zstd")
    df = readers.read_lake(spark, readers.lake_path(root, "r1", "places", "place"), f"{root}/release/r1")
    return df.select("id", F.col("names.primary").alias("name"), F.hex("geometry").alias("wkb"), F.col("bbox.xmin").alias("xmin"), "theme", "type")


@query("lake_types", """
SELECT id, CAST(n AS BIGINT) AS n, CAST(n AS DOUBLE) AS x, part FROM (
  SELECT overture_id AS id, candidate_rank AS n, 'a' AS part FROM gers_candidates WHERE candidate_rank IS NOT NULL UNION ALL SELECT gers_id, CAST(round(gers_match_score) AS INTEGER), 'b' FROM gers_output WHERE gers_match_score IS NOT NULL)""")
def lake_types(spark: SparkSession, directory: str) -> DataFrame:
    """Files of one dataset that disagree on types, read into the types that hold all values."""
    root = _folder(spark)
    a = table(spark, directory, "gers_candidates").where("candidate_rank is not null").select(F.col("overture_id").alias("id"), F.col("candidate_rank").cast("bigint").alias("n"), F.col("candidate_rank").cast("float").alias("x"), F.lit("a").alias("part"))
    b = table(spark, directory, "gers_output").where("gers_match_score is not null").select(F.col("gers_id").alias("id"), F.round("gers_match_score").cast("int").alias("n"), F.round("gers_match_score").cast("int").alias("x"), F.lit("b").alias("part"))
    for name, df in (("a", a), ("b", b)):
        df.write.parquet(f"{root}/{name}")
    return readers.read_lake(spark, f"{root}/*")


@query("csv_round_trip", "SELECT record_id, nullif(name, '') AS name, nullif(address, '') AS address, nullif(city, '') AS city FROM gers_user_input WHERE record_id IS NOT NULL")
def csv_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Records written as CSV and read as delimited text, quotes and line breaks in cells included."""
    path = _folder(spark)
    writers.write_csv(table(spark, directory, "gers_user_input").where("record_id is not null").select("record_id", "name", "address", "city"), path)
    rows, _ = readers.read_delimited(spark, path, ["record_id", "name", "address", "city"], ",", multi_line=True)
    return rows


_POLICY = [(["OBJECTID", "GlobalID", "NAME"], "GlobalID", False), (["Shape", "SITE_ID", "OBJECTID"], "SITE_ID", False), (["OBJECTID", "Shape"], "OBJECTID", True), (["FID", "Shape"], "FID", True), (["Shape", "NAME"], None, True), (["parcelid", "OBJECTID"], "parcelid", False)]


@query("record_id_policy", "SELECT * FROM (VALUES " + ", ".join(f"('{json.dumps(f)}', {'NULL' if i is None else repr(i)}, {str(g).lower()})" for f, i, g in _POLICY) + ") AS t(fields, id_field, generate)")
def record_id_policy(spark: SparkSession, directory: str) -> DataFrame:
    """The key of layers by their fields, and whether ids are generated as no durable key is there."""
    rows = [(json.dumps(f), *mapping.id_choice(f)) for f, _, _ in _POLICY]
    return spark.createDataFrame(rows, "fields string, id_field string, generate boolean")


ORACLES["field_mapping"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{r}', {'NULL' if f is None else repr(f)})"
    for t in ("gers_user_input", "gers_output")
    for r, f in (("name", "name"), ("address", "address"), ("number", None), ("fraction", None), ("prefix", None), ("street", None), ("type", None), ("suffix", None), ("unit", None), ("city", "city"), ("state", "state"), ("postcode", "postcode"), ("id", "record_id"))
) + ") AS t(table_name, role, field)"


@query("assembled_addresses", """
SELECT record_id, coalesce(nullif(trim(regexp_replace(address, '\\s+', ' ', 'g')), ''), '') AS address, CASE WHEN regexp_matches(postcode, '[0-9]') THEN trim(regexp_replace(postcode, '\\s+', ' ', 'g')) ELSE '' END AS postcode
FROM gers_user_input WHERE record_id IS NOT NULL AND coalesce(address, '') NOT LIKE '%"%' AND coalesce(postcode, '') NOT LIKE '%"%'""")
def assembled_addresses(spark: SparkSession, directory: str) -> DataFrame:
    """Address and postcode of the records by the fields that the mapping finds."""
    df = table(spark, directory, "gers_user_input").where("record_id is not null and coalesce(address, '') not like '%\"%' and coalesce(postcode, '') not like '%\"%'")
    fields = mapping.map_fields(df.columns)
    return df.select("record_id", mapping.assemble_address(df, fields).alias("address"), mapping.assemble_postcode(df, fields["postcode"]).alias("postcode"))


_CENTRES = [("map", Extent(-119.9, 36.2, -119.1, 36.9), "US"), ("none", Extent(-30.5, -40.5, -30.0, -40.0), None)]


@query("extent_rules", "SELECT * FROM (VALUES ('map', 'US', 'Divisions - Division Area', 'Base - Land Use'), ('none', NULL, 'Divisions - Division Area', 'Base - Land Use')) AS t(source, country, label, other_label)")
def extent_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Which extent counts, the country of its centre, and the labels of layers."""
    rows = [(rules.extent_source(source == "map", source == "map", False, False), rules.country_of(e), rules.layer_label("divisions", "division_area"), rules.layer_label("base", "land_use")) for source, e, _ in _CENTRES]
    return spark.createDataFrame(rows, "source string, country string, label string, other_label string")


@query("geometry_families", "SELECT CASE WHEN k = '01' THEN 'point' WHEN k = '03' THEN 'polygon' END AS family, count(*) AS n FROM (SELECT substr(hex(geometry), 3, 2) AS k FROM division_area UNION ALL SELECT substr(hex(geometry), 3, 2) FROM overture_place) GROUP BY 1")
def geometry_families(spark: SparkSession, directory: str) -> DataFrame:
    """Rows by the family of their geometry."""
    from geoweft.operators.extract import GEOMETRY_TYPE, with_geometry_type

    both = table(spark, directory, "division_area").select("geometry").unionByName(table(spark, directory, "overture_place").select("geometry"))
    return rules.family_counts(with_geometry_type(both).withColumnRenamed(GEOMETRY_TYPE, "geometry_type"))


@query("geocode_file_input", """
SELECT row_number() OVER (ORDER BY record_id, address, coalesce(city, '')) - 1 AS row_id, trim(regexp_replace(address, '\\s+', ' ', 'g')) AS address, coalesce(trim(regexp_replace(city, '\\s+', ' ', 'g')), '') AS city
FROM gers_user_input WHERE record_id IS NOT NULL AND trim(address) <> '' AND concat_ws('', address, city) NOT LIKE '%"%'""")
def geocode_file_input(spark: SparkSession, directory: str) -> DataFrame:
    """A file of addresses read by its header's names, whole and in its order."""
    path = _folder(spark)
    df = table(spark, directory, "gers_user_input").where("record_id is not null and trim(address) <> '' and concat_ws('', address, city) not like '%\"%'")
    writers.write_csv(df.orderBy("record_id", "address", F.coalesce("city", F.lit(""))).select(F.col("address").alias("Full Address"), F.col("city").alias("S_City")), path, single=True)
    rows, _ = readers.read_geocode_file(spark, path, None)
    return cut(rows).select("row_id", "address", "city")
