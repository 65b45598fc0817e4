"""The text and link functions under SQL names, for users of spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from geoweft.functions.similarity import _jaro_winkler

_OSM = "CASE WHEN dataset IS NULL OR record_id IS NULL OR lower(dataset) NOT LIKE '%openstreetmap%' THEN NULL {} END"
_KINDS = " ".join(f"WHEN record_id RLIKE '^{c}[0-9]+(@.*)?$' THEN concat('https://www.openstreetmap.org/{k}/', regexp_extract(record_id, '^{c}([0-9]+)', 1))" for c, k in (("n", "node"), ("w", "way"), ("r", "relation")))
FUNCTIONS = {
    "normalize_text": "(v STRING) RETURNS STRING RETURN regexp_replace(lower(trim(coalesce(v, ''))), '[^a-z0-9]+', ' ')",
    "build_osm_url": f"(dataset STRING, record_id STRING) RETURNS STRING RETURN {_OSM.format(_KINDS)}",
    "distance_m": "(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE RETURN sqrt(pow((lon2 - lon1) * 111320.0D * cos(radians((lat2 + lat1) / 2.0D)), 2) + pow((lat2 - lat1) * 110540.0D, 2))",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; the SQL ones are inlined by the optimizer."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("jaro_winkler_similarity", _jaro_winkler)
    return [*FUNCTIONS, "jaro_winkler_similarity"]
