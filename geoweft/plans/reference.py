"""Queries of the extract, geocode, link, trace and catalog operators over the given tables, with their SQL.

Targets are the distinct places of gers_candidates, which have a name, an address and a position; records are those of
gers_user_input, one per record_id. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import provenance, sql, text
from geoweft.functions.similarity import jaro_winkler
from geoweft.functions.wkb import geometry_type
from geoweft.operators import extract, geocode, linking, mapping, rules, trace
from geoweft.operators.spatial_join import band_join
from geoweft.options import BridgeOptions, Extent, LinkOptions, TraceOptions
from geoweft.plans import catalog
from geoweft.plans.core import query, table
from geoweft.sources.readers import union_by_name

_TEXT = ("source_record_key", "name", "address", "city", "state", "postcode")


def users(spark: SparkSession, directory: str) -> DataFrame:
    ok = ~F.isnan("longitude") & ~F.isnan("latitude") & (F.abs("longitude") < float("inf")) & (F.abs("latitude") < float("inf"))
    rows = table(spark, directory, "gers_user_input").where(F.col("record_id").isNotNull() & ok)
    return linking.user_records(rows.groupBy("record_id").agg(*[F.min(c).alias(c) for c in (*_TEXT, "longitude", "latitude")]))


def places(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "gers_candidates").where("overture_id is not null").groupBy(F.col("overture_id").alias("id"))
    return rows.agg(F.min("overture_name").alias("name"), F.min("overture_address").alias("address"), F.min("user_city").alias("city"), F.min("user_postcode").alias("postcode"), F.min("overture_longitude").alias("longitude"), F.min("overture_latitude").alias("latitude"))


def addresses(spark: SparkSession, directory: str) -> DataFrame:
    a = F.col("address")
    number, street = F.regexp_extract(a, r"^\s*([0-9]+[A-Za-z]?)\s", 1), F.regexp_replace(a, r"^\s*[0-9]+[A-Za-z]?\s+", "")
    return places(spark, directory).select("id", number.alias("number"), street.alias("street"), "city", "postcode", "longitude", "latitude")


def norm(x: str) -> str:
    return f"regexp_replace(lower(trim(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g')"


def _digits(x: str) -> str:
    return f"left(regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g'), 5)"


def jw(a: str, b: str) -> str:
    return f"jaro_winkler_similarity({a}, {b})"


USERS_SQL = f"""
users AS (
  SELECT record_id, {', '.join(f'min({c}) AS {c}' for c in _TEXT)}, min(longitude) AS longitude, min(latitude) AS latitude
  FROM gers_user_input WHERE record_id IS NOT NULL AND isfinite(longitude) AND isfinite(latitude) GROUP BY record_id
)"""
PLACES_SQL = """
places AS (
  SELECT overture_id AS id, min(overture_name) AS name, min(overture_address) AS address, min(user_city) AS city, min(user_postcode) AS postcode, min(overture_longitude) AS longitude, min(overture_latitude) AS latitude
  FROM gers_candidates WHERE overture_id IS NOT NULL GROUP BY overture_id
)"""
ADDRESSES_SQL = r"""
addresses AS (
  SELECT id, regexp_extract(address, '^\s*([0-9]+[A-Za-z]?)\s', 1) AS number, regexp_replace(address, '^\s*[0-9]+[A-Za-z]?\s+', '') AS street, city, postcode, longitude, latitude FROM places
)"""
_PAIR_COLUMNS = """record_id, coalesce(user_name, '') AS user_name, coalesce(user_address, '') AS user_address, coalesce(user_city, '') AS user_city, coalesce(user_state, '') AS user_state, coalesce(user_postcode, '') AS user_postcode, longitude, latitude,
       id AS gers_id, id AS overture_id, title AS overture_name, street AS overture_address, lon AS overture_longitude, lat AS overture_latitude, m AS distance_m, n AS name_similarity, s AS address_similarity, f AS distance_similarity"""


def link_pairs(targets: str) -> str:
    """CTEs ``p``, the targets (id, title, street, town, region, code, lon, lat and whatever else), and ``near``, each record of
    ``users`` with the targets within 75 m, the texts of both in normal form and their likeness."""
    streets = jw(norm("r.address"), norm("p.street"))
    whole = jw(norm("concat_ws(' ', r.address, r.city, r.state, r.postcode)"), norm("concat_ws(' ', p.street, p.town, p.region, p.code)"))
    return f"""
p AS ({targets}), near AS (
  SELECT *, greatest(0.0, 1 - m / 75) AS f, if(a <> '' AND b <> '', {jw('a', 'b')}, NULL) AS n, if(c <> '' AND d <> '', greatest(one, two), NULL) AS s FROM (
    SELECT p.*, r.record_id, r.name AS user_name, r.address AS user_address, r.city AS user_city, r.state AS user_state, r.postcode AS user_postcode, r.longitude, r.latitude, {norm('r.name')} AS a, {norm('p.title')} AS b, {norm('r.address')} AS c, {norm('p.street')} AS d,
           {streets} AS one, {whole} AS two, sqrt(pow((p.lon - r.longitude) * 111320.0 * cos(radians((p.lat + r.latitude) / 2)), 2) + pow((p.lat - r.latitude) * 110540.0, 2)) AS m
    FROM users r JOIN p ON p.lat BETWEEN r.latitude - 75 / 110540.0 AND r.latitude + 75 / 110540.0 AND abs(p.lon - r.longitude) <= 75 / greatest(111320.0 * cos(radians(r.latitude)), 1)
    WHERE abs(r.latitude) <= 90 AND abs(r.longitude) <= 180 AND abs(p.lat) <= 90 AND abs(p.lon) <= 180)
  WHERE m <= 75
)"""


def place_candidates_sql(name: float = 0.86, address: float = 0.72, score: float = 72.0, k: int = 5) -> str:
    """CTE ``candidates`` over ``near``: the score by what both sides have, the k best, and what is accepted."""
    return f"""
candidates AS (
  SELECT {_PAIR_COLUMNS}, CASE WHEN n IS NULL AND s IS NULL THEN 'nearby_only' WHEN s IS NULL THEN 'name' WHEN n IS NULL THEN 'address' ELSE 'name_address' END AS match_strategy, score AS gers_match_score, place AS candidate_rank,
         (place = 1 AND score >= {score} AND coalesce(n, 1) >= {name} AND coalesce(s, 1) >= {address} AND (n IS NOT NULL OR s IS NOT NULL OR m <= 15)) AS accepted
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, m, title, id) AS place FROM (
    SELECT *, CASE WHEN n IS NULL AND s IS NULL THEN 100 * f WHEN n IS NULL OR s IS NULL THEN 80 * coalesce(n, s) + 20 * f ELSE 60 * n + 25 * s + 15 * f END AS score
    FROM near WHERE n IS NOT NULL OR s IS NOT NULL OR (a = '' AND c <> '' AND b <> '')) QUALIFY place <= {k})
)"""


def place_link_sql() -> str:
    """CTEs up to ``candidates``."""
    flat = "SELECT id, coalesce(name, '') AS title, coalesce(address, '') AS street, city AS town, '' AS region, left(postcode, 5) AS code, longitude AS lon, latitude AS lat FROM places"
    return f"WITH {USERS_SQL}, {PLACES_SQL}, {link_pairs(flat)}, {place_candidates_sql()}"


OUTPUT_SQL = """
output AS (
  SELECT u.record_id, u.source_record_key, u.name, u.address, u.city, u.state, u.postcode, u.longitude, u.latitude, a.gers_id, a.gers_match_score, a.match_strategy AS gers_match_strategy, a.distance_m AS gers_match_distance_m,
         a.name_similarity AS gers_name_similarity, a.address_similarity AS gers_address_similarity, a.overture_address, a.overture_name, a.overture_id,
         CASE WHEN a.gers_id IS NULL OR trim(a.gers_id) = '' THEN 'unmatched' WHEN a.gers_match_score < 80.0 THEN 'weak' ELSE 'linked' END AS gers_link_review
  FROM users u LEFT JOIN (SELECT * FROM candidates WHERE accepted AND candidate_rank = 1) a ON u.record_id = a.record_id
)"""
CANDIDATE_DOUBLES = ("distance_m", "name_similarity", "address_similarity", "distance_similarity", "gers_match_score")
OUTPUT_DOUBLES = ("gers_match_score", "gers_match_distance_m", "gers_name_similarity", "gers_address_similarity")


def rounded(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns if c in df.columns})


def replaced(columns: tuple[str, ...]) -> str:
    return "* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in columns) + ")"


def place_links(spark: SparkSession, directory: str) -> DataFrame:
    return linking.place_candidates(users(spark, directory), linking.place_targets(places(spark, directory)), LinkOptions())


@query("link_places", place_link_sql() + f" SELECT {replaced(CANDIDATE_DOUBLES)} FROM candidates")
def link_places(spark, directory):
    """Five best places of each record within 75 m, scored, ranked and accepted."""
    return rounded(place_links(spark, directory), CANDIDATE_DOUBLES)


ADDRESS_LINK_SQL = f"""
WITH {USERS_SQL}, {PLACES_SQL}, {ADDRESSES_SQL}, {link_pairs("SELECT id, line AS title, line AS street, nullif(city, '') AS town, '' AS region, left(postcode, 5) AS code, longitude AS lon, latitude AS lat, lower(trim(number)) AS house FROM (SELECT *, trim(concat_ws(' ', nullif(number, ''), nullif(street, ''))) AS line FROM addresses)")},
told AS (
  SELECT * EXCLUDE (n), CAST(NULL AS DOUBLE) AS n, house <> '' AND regexp_extract(lower(trim(coalesce(user_address, ''))), '^[0-9]+[a-z]?') = house AS same_house, {_digits('user_postcode')} AS mine, {_digits('code')} AS theirs FROM near WHERE s IS NOT NULL
), scored AS (
  SELECT *, mine IN ('', theirs) OR theirs = '' AS same_code, if(same_house AND same_code, 90, 70) * s + 10 * f AS score FROM told
), candidates AS (
  SELECT {_PAIR_COLUMNS}, same_house AS house_number_match, same_code AS postcode_compatible, CASE WHEN same_house AND same_code AND s >= 0.995 THEN 'exact_address' ELSE 'address' END AS match_strategy, score AS gers_match_score, place AS candidate_rank,
         (place = 1 AND score >= 72 AND s >= 0.72 AND same_house AND same_code) AS accepted
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY same_house AND same_code DESC, score DESC, m, street, id) AS place FROM scored QUALIFY place <= 5)
)"""


@query("link_addresses", ADDRESS_LINK_SQL + f" SELECT {replaced(CANDIDATE_DOUBLES)} FROM candidates")
def link_addresses(spark, directory):
    """Five best addresses of each record."""
    found = linking.address_candidates(users(spark, directory), linking.address_targets(addresses(spark, directory)), LinkOptions(target="addresses"))
    return rounded(found, CANDIDATE_DOUBLES)


def place_output(spark, directory):
    return linking.linked_output(users(spark, directory), place_links(spark, directory))


@query("link_output_review", place_link_sql() + f", {OUTPUT_SQL} SELECT {replaced(OUTPUT_DOUBLES)} FROM output")
def link_output_review(spark, directory):
    return rounded(place_output(spark, directory), OUTPUT_DOUBLES)


@query("link_bridge", place_link_sql() + """ SELECT a.gers_id AS id, a.record_id, u.source_record_key, '2026-01-01' AS update_time, 'Local layer' AS dataset, 'places' AS theme, 'place' AS type, 'link_dont_replace' AS linkage_policy,
  'authoritative_local' AS source_geometry_policy, a.match_strategy, round(a.gers_match_score, 6) AS match_score, 'unknown' AS overture_release, 'Local layer' AS source_layer, 'geoweft' AS linkage_tool
  FROM candidates a JOIN users u ON a.record_id = u.record_id WHERE a.accepted AND a.candidate_rank = 1""")  # fmt: skip
def link_bridge(spark, directory):
    """Bridge rows; the text of the score is compared as a number."""
    rows = linking.bridge_rows(users(spark, directory), place_links(spark, directory), BridgeOptions(update_time="2026-01-01"))
    return rows.withColumn("match_score", F.round(F.col("match_score").cast("double"), 6))


@query("link_strategy_counts", place_link_sql() + " SELECT coalesce(match_strategy, 'unknown') AS match_strategy, count(*) AS n FROM candidates WHERE accepted AND candidate_rank = 1 GROUP BY 1")
def link_strategy_counts(spark, directory):
    return linking.strategy_counts(place_links(spark, directory))


@query("link_signal_coverage", place_link_sql() + """ SELECT (SELECT count(*) FROM users) AS records, (SELECT count(*) FILTER (WHERE trim(name) <> '') FROM users) AS with_name, (SELECT count(*) FILTER (WHERE trim(address) <> '') FROM users) AS with_address,
  count(*) AS candidates, count(name_similarity) AS with_name_similarity, count(address_similarity) AS with_address_similarity FROM candidates""")  # fmt: skip
def link_signal_coverage(spark, directory):
    return linking.signal_coverage(users(spark, directory), place_links(spark, directory))


@query("link_summary", place_link_sql() + f", {OUTPUT_SQL} SELECT count(*) AS input_count, count(*) FILTER (WHERE gers_link_review <> 'unmatched') AS linked, count(*) FILTER (WHERE gers_link_review = 'unmatched') AS unmatched, count(*) FILTER (WHERE gers_link_review = 'weak') AS weak FROM output")
def link_summary(spark, directory):
    s = linking.link_summary(place_output(spark, directory))
    return spark.createDataFrame([(s.input_count, s.linked, s.unmatched, s.weak)], "input_count long, linked long, unmatched long, weak long")


@query("review_unmatched", place_link_sql() + f", {OUTPUT_SQL} SELECT record_id, gers_link_review FROM output WHERE gers_link_review = 'unmatched'")
def review_unmatched(spark, directory):
    return linking.review_unmatched(place_output(spark, directory)).select("record_id", "gers_link_review")


@query("review_weak", "SELECT record_id, gers_id, gers_match_score FROM gers_output WHERE gers_id IS NOT NULL AND trim(gers_id) <> '' AND gers_match_score >= 72.0 AND gers_match_score < 80.0")
def review_weak(spark, directory):
    """Weak links of the earlier run, by score as it has no review column here."""
    rows = table(spark, directory, "gers_output").drop("gers_link_review")
    return linking.review_weak(rows).select("record_id", "gers_id", "gers_match_score")


@query("review_source_keys", "SELECT overture_id, record_id, distance_m FROM gers_candidates WHERE record_id IN (SELECT record_id FROM gers_output WHERE gers_id IS NULL AND trim(record_id) <> '')")
def review_source_keys(spark, directory):
    """Candidates of the records that stayed unlinked."""
    unlinked = linking.review_unmatched(table(spark, directory, "gers_output"), review_column=None)
    return linking.review_source_keys(table(spark, directory, "gers_candidates"), "record_id", unlinked).select("overture_id", "record_id", "distance_m")


@query("relate_output", """SELECT c.record_id, c.overture_id, o.gers_id, o.gers_match_score, o.gers_link_review FROM (SELECT DISTINCT record_id, overture_id FROM gers_candidates WHERE record_id IS NOT NULL) c
  LEFT JOIN (SELECT record_id, max(gers_id) AS gers_id, max(gers_match_score) AS gers_match_score, max(gers_link_review) AS gers_link_review FROM gers_output GROUP BY record_id) o ON c.record_id = o.record_id""")  # fmt: skip
def relate_output(spark, directory):
    source = table(spark, directory, "gers_candidates").where("record_id is not null").select("record_id", "overture_id").distinct()
    one = table(spark, directory, "gers_output").groupBy("record_id").agg(*[F.max(c).alias(c) for c in ("gers_id", "gers_match_score", "gers_link_review")])
    return linking.relate(source, "record_id", one)


@query("band_join_points", f"WITH {USERS_SQL}, {PLACES_SQL} SELECT u.record_id, t.id FROM users u JOIN places t ON abs(t.latitude - u.latitude) <= 250.0 / 110540.0 AND abs(t.longitude - u.longitude) <= 250.0 / greatest(111320.0 * abs(cos(radians(u.latitude))), 1.0) WHERE u.longitude BETWEEN -180 AND 180 AND u.latitude BETWEEN -90 AND 90")
def band_join_points(spark, directory):
    """The bare band join with a radius of 250 m."""
    target = places(spark, directory).select("id", F.col("longitude").alias("tx"), F.col("latitude").alias("ty"))
    return band_join(users(spark, directory).select("record_id", "longitude", "latitude"), target, 250.0, right_xy=("tx", "ty")).select("record_id", "id")


OSM = lambda base, ds, rid: f"CASE WHEN {ds} IS NULL OR lower({ds}) NOT LIKE '%openstreetmap%' THEN NULL " + " ".join(f"WHEN regexp_matches({rid}, '^{c}[0-9]+(@.*)?$') THEN '{base(k)}' || regexp_extract({rid}, '^{c}([0-9]+)', 1)" for c, k in (("n", "node"), ("w", "way"), ("r", "relation"))) + " END"
VIEW_URL = OSM(lambda k: f"https://www.openstreetmap.org/{k}/", "b.dataset", "b.record_id")
TRACE_SQL = f"""
WITH ids AS (SELECT DISTINCT gers_id FROM gers_output WHERE trim(gers_id) <> ''),
traced AS (SELECT i.gers_id, b.dataset, b.record_id, b.update_time, b.theme, b.type, {VIEW_URL} AS source_url FROM ids i JOIN gers_bridge b ON i.gers_id = b.id WHERE b.theme = 'places' AND b.type = 'place'
           ORDER BY i.gers_id NULLS LAST, b.dataset NULLS LAST, b.record_id NULLS LAST, b.update_time NULLS LAST)
"""


def traced(spark, directory):
    return trace.trace_sources(table(spark, directory, "gers_output").select("gers_id"), table(spark, directory, "gers_bridge"), TraceOptions(max_rows=None))


@query("trace_sources", TRACE_SQL + "SELECT * FROM traced")
def trace_sources(spark, directory):
    return traced(spark, directory)


@query("trace_dataset_counts", TRACE_SQL + "SELECT min(dataset) AS dataset, count(*) AS n FROM traced WHERE trim(dataset) <> '' GROUP BY lower(dataset)")
def trace_dataset_counts(spark, directory):
    return trace.dataset_counts(traced(spark, directory))


def _platform_sql(pick: int, blank: str, other: str, ds: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE WHEN {ds} IS NULL OR trim({ds}) = '' THEN {quote(blank)} " + " ".join(f"WHEN lower({ds}) LIKE '%{p[0]}%' THEN {quote(p[pick])}" for p in provenance.PLATFORMS) + f" ELSE {other} END"


LOOSE = "CASE WHEN dataset IS NULL OR lower(dataset) NOT LIKE '%openstreetmap%' THEN NULL " + " ".join(f"WHEN regexp_matches(trim(record_id), '(?i)^{c}[0-9]+') THEN 'https://www.openstreetmap.org/edit?{k}=' || regexp_extract(trim(record_id), '(?i)^{c}([0-9]+)', 1)" for c, k in (("n", "node"), ("w", "way"), ("r", "relation"))) + " END"
DOCS = "'" + provenance.DOCUMENTATION_URL + "'"


@query("trace_enriched", TRACE_SQL + f"""SELECT gers_id, dataset, record_id, update_time, theme, type, coalesce(nullif(trim(source_url), ''), {LOOSE}) AS source_url, {LOOSE} AS edit_url, {_platform_sql(1, provenance.UNKNOWN, 'trim(dataset)', 'dataset')} AS edit_platform,
  {_platform_sql(2, provenance.DOCUMENTATION_URL, DOCS, 'dataset')} AS contribution_url, {_platform_sql(3, provenance.OTHER_INSTRUCTIONS, "'" + provenance.OTHER_INSTRUCTIONS + "'", 'dataset')} AS edit_instructions FROM traced""")  # fmt: skip
def trace_enriched(spark, directory):
    return trace.enrich_trace(traced(spark, directory))


@query("trace_ids", "SELECT min(gers_id) AS gers_id FROM gers_output WHERE trim(gers_id) <> '' GROUP BY lower(trim(gers_id))")
def trace_ids(spark, directory):
    return trace.trace_ids(table(spark, directory, "gers_output"))


def _search_places(spark, directory):
    named = table(spark, directory, "overture_place").groupBy(F.col("id").alias("_i")).agg(F.min("names.primary").alias("place_name"), F.min("categories.primary").alias("category"))
    return places(spark, directory).drop("name", "address").join(named, F.col("id") == F.col("_i")).select("id", F.col("place_name").alias("name_primary"), "category", "city", "postcode", "longitude", "latitude")


SEARCH_CTES = f"""
WITH {PLACES_SQL}, {ADDRESSES_SQL},
named AS (SELECT id, min(names['primary']) AS name_primary, min(categories['primary']) AS category FROM overture_place GROUP BY id),
a AS (SELECT trim(concat_ws(', ', nullif(trim(concat_ws(' ', nullif(number, ''), nullif(street, ''))), ''), nullif(city, ''), nullif(postcode, ''))) AS display_label, longitude, latitude,
             lower(trim(concat_ws(' ', nullif(number, ''), nullif(street, ''), nullif(city, ''), nullif(postcode, '')))) AS search_text FROM addresses),
p AS (SELECT trim(concat_ws(', ', nullif(trim(concat_ws(' ', nullif(n.name_primary, ''))), ''), nullif(city, ''), nullif(postcode, ''))) AS display_label, longitude, latitude,
             lower(trim(concat_ws(' ', nullif(n.name_primary, ''), nullif(n.category, ''), nullif(city, ''), nullif(postcode, '')))) AS search_text FROM places q JOIN named n ON q.id = n.id)
"""
_TIER = "CASE WHEN score >= 300 THEN 'exact' WHEN score >= 200 THEN 'prefix' WHEN score >= 150 THEN 'contains' ELSE 'token' END"
_CONF = "CASE WHEN score >= 280 THEN 'High' WHEN score >= 190 THEN 'Medium' ELSE 'Low' END"


def search_sql(source: str, cte: str, q: str, bias: int, limit: int) -> str:
    tokens = " AND ".join(f"contains(search_text, '{t}')" for t in q.split())
    return f"""SELECT display_label, longitude, latitude, '{source}' AS source_type, {_TIER} AS match_tier, score, {_CONF} AS confidence FROM (
      SELECT *, CASE WHEN search_text = '{q}' THEN {300 + bias} WHEN starts_with(search_text, '{q}') THEN {220 + bias} WHEN contains(search_text, '{q}') THEN {170 + bias} WHEN {tokens} THEN {120 + bias} ELSE 0 END AS score FROM {cte})
      WHERE score > 0 AND display_label <> '' ORDER BY score DESC, display_label, longitude, latitude LIMIT {limit}"""


@query("geocode_single", SEARCH_CTES + search_sql("Address", "a", "lindquor rd", 40, 25))
def geocode_single(spark, directory):
    """The best 25 addresses for a street."""
    return geocode.search(geocode.searchable(addresses(spark, directory)), "Lindquor, Rd.", "Address")


@query("geocode_merge", SEARCH_CTES + f"SELECT * FROM (({search_sql('Address', 'a', 'nimbo burger', 40, 40)}) UNION ALL ({search_sql('Place', 'p', 'nimbo burger', 0, 40)})) ORDER BY score DESC, lower(display_label), display_label, longitude, latitude LIMIT 40")
def geocode_merge(spark, directory):
    """Both sources merged, the best 40."""
    return geocode.search_all(geocode.searchable(addresses(spark, directory)), geocode.searchable(_search_places(spark, directory)), "NIMBO burger!", 40)


def _file_queries(spark, directory):
    return users(spark, directory).where(F.trim("address") != "").select(F.col("record_id").alias("row_id"), "address", "city", "state", "postcode")


_clean = lambda c: f"""trim(regexp_replace(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')), '^"+|"+$', '', 'g'))"""
GEOCODE_FILE_SQL = SEARCH_CTES.replace("WITH", f"WITH {USERS_SQL},", 1) + f""",
queries AS (SELECT record_id AS row_id, {_clean('address')} AS ad, {_clean('city')} AS ci, {_clean('state')} AS st, {_clean('postcode')} AS po FROM users WHERE trim(address) <> ''),
towns AS (SELECT *, concat_ws(', ', nullif(ci, ''), nullif(st, '')) AS town FROM queries),
rests AS (SELECT *, [concat_ws(' ', nullif(town, ''), nullif(po, '')), po, ci, town, ''] AS rest FROM towns WHERE ad <> ''),
exploded AS (SELECT row_id, unnest(range(5)) AS no, unnest(list_transform(rest, lambda x: CASE WHEN x <> '' THEN ad || ', ' || x ELSE ad END)) AS query FROM rests),
q AS (SELECT *, trim(regexp_replace(lower(query), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) AS q FROM exploded),
t AS (SELECT *, 'Address' AS source_type, 40 AS bias FROM a UNION ALL SELECT *, 'Place', 0 FROM p),
hits AS (SELECT q.row_id, q.no, q.query, t.*, bias + CASE WHEN search_text = q THEN 300 WHEN starts_with(search_text, q) THEN 220 WHEN contains(search_text, q) THEN 170 ELSE 120 END AS score
         FROM q JOIN t ON q <> '' AND display_label <> '' AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90 AND (contains(search_text, q) OR list_bool_and(list_transform(string_split(q, ' '), lambda x: contains(search_text, x))))),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY no, score DESC, lower(display_label), display_label, source_type, longitude, latitude) AS r FROM hits) WHERE r = 1)
SELECT queries.row_id, query, display_label, longitude, latitude, source_type, CASE WHEN score IS NOT NULL THEN {_TIER} END AS match_tier, CASE WHEN score IS NOT NULL THEN {_CONF} END AS confidence, score FROM queries LEFT JOIN top ON queries.row_id = top.row_id
"""


def _geocoded(spark, directory):
    return geocode.geocode_table(_file_queries(spark, directory), geocode.searchable(addresses(spark, directory)), geocode.searchable(_search_places(spark, directory)))


@query("geocode_file", GEOCODE_FILE_SQL)
def geocode_file(spark, directory):
    """Every address of a table of queries, by ever broader variants."""
    return _geocoded(spark, directory)


EXTENT = Extent(-119.9, 36.2, -119.1, 36.9)
_BOX = "bbox.xmin <= -119.1 AND bbox.xmax >= -119.9 AND bbox.ymin <= 36.9 AND bbox.ymax >= 36.2"


@query("extract_bbox_points", f"SELECT id, names['primary'] AS name FROM overture_place WHERE {_BOX}")
def extract_bbox_points(spark, directory):
    """Four comparisons on the bbox struct in the scan."""
    return extract.in_extent(table(spark, directory, "overture_place"), EXTENT).select("id", F.col("names.primary").alias("name"))


@query("extract_pruned", f"SELECT id, names['primary'] AS names_primary, categories['primary'] AS categories_primary, hex(geometry) AS wkb FROM overture_place WHERE {_BOX}")
def extract_pruned(spark, directory):
    """A whole extract of places: filtered and pruned; points aren't clipped."""
    df = extract.shape(extract.in_extent(table(spark, directory, "overture_place"), EXTENT), "place")
    return df.select("id", F.col("names.primary").alias("names_primary"), F.col("categories.primary").alias("categories_primary"), F.hex("geometry").alias("wkb"))


@query("extract_clipped")
def extract_clipped(spark, directory):
    """Areas cut to an extent, with their new bounds and type."""
    df = extract.shape(table(spark, directory, "division_area"), "division_area", EXTENT)
    return df.select("id", F.hex("geometry").alias("wkb"), "bbox", extract.GEOMETRY_TYPE)


@query("extract_geom_split", "SELECT geom_type, count(*) AS n FROM (SELECT CASE substr(hex(geometry), 3, 2) WHEN '01' THEN 'POINT' WHEN '03' THEN 'POLYGON' END AS geom_type FROM (SELECT geometry FROM division_area UNION ALL SELECT geometry FROM overture_place)) GROUP BY 1")
def extract_geom_split(spark, directory):
    both = table(spark, directory, "division_area").select("geometry").unionByName(table(spark, directory, "overture_place").select("geometry"))
    return extract.geometry_type_counts(extract.with_geometry_type(both))


@query("geometry_types", "SELECT id, CASE substr(hex(geometry), 3, 2) WHEN '01' THEN 'POINT' END AS geom_type FROM overture_place")
def geometry_types(spark, directory):
    return table(spark, directory, "overture_place").select("id", geometry_type(F.col("geometry")).alias("geom_type"))


def _kept(field: str, cut: str = "{}") -> str:
    value = cut.format("a." + field)
    return f"list_transform(list_filter(addresses, lambda a: a.{field} IS NOT NULL AND trim(a.{field}) <> ''), lambda a: {value})"


def _firsts(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@query("flatten_addresses", "SELECT id, " + ", ".join(f"nullif(array_to_string({_kept('freeform') if f == 'freeform' else _firsts(_kept(f, 'left({}, 5)' if f == 'postcode' else '{}'))}, ' | '), '') AS address_{f}" for f in ("freeform", "locality", "region", "postcode", "country")) + " FROM overture_place")
def flatten_addresses(spark, directory):
    df = extract.flatten_addresses(table(spark, directory, "overture_place"))
    return df.select("id", *[f"address_{f}" for f in ("freeform", "locality", "region", "postcode", "country")])


_source = lambda f: f"list_filter(list_transform(sources, lambda s: s.{f}), lambda v: v IS NOT NULL AND trim(v) <> '')[1]"
_EDIT = OSM(lambda k: f"https://www.openstreetmap.org/edit?{k}=", "d", "r")
PROVENANCE_SQL = f"""
WITH s AS (SELECT id, sources, {_source('dataset')} AS d, {_source('record_id')} AS r, {_source('update_time')} AS u FROM overture_place)
SELECT id, coalesce(len(list_filter(sources, lambda s: s.dataset IS NOT NULL OR s.record_id IS NOT NULL)), 0) AS source_count,
       nullif(array_to_string({_firsts("list_filter(list_transform(sources, lambda s: s.dataset), lambda v: v IS NOT NULL AND trim(v) <> '')")}, ' | '), '') AS source_datasets, d AS source_primary_dataset, r AS source_primary_record_id, u AS source_primary_update_time,
       coalesce({_EDIT}, {_platform_sql(2, provenance.DOCUMENTATION_URL, DOCS, 'd')}) AS source_url, {_EDIT} AS source_edit_url, {_platform_sql(2, provenance.DOCUMENTATION_URL, DOCS, 'd')} AS source_contribution_url, {_platform_sql(1, provenance.UNKNOWN, 'd', 'd')} AS source_edit_platform FROM s
"""


@query("source_provenance", PROVENANCE_SQL)
def source_provenance(spark, directory):
    df = extract.add_provenance(table(spark, directory, "overture_place"))
    return df.select("id", *[c for c in df.columns if c.startswith("source_")])


@query("osm_urls", f"SELECT b.id, b.dataset, b.record_id, {VIEW_URL} AS view_url, {OSM(lambda k: f'https://www.openstreetmap.org/edit?{k}=', 'b.dataset', 'b.record_id')} AS edit_url FROM gers_bridge b")
def osm_urls(spark, directory):
    return table(spark, directory, "gers_bridge").select("id", "dataset", "record_id", provenance.osm_url(F.col("dataset"), F.col("record_id")).alias("view_url"), provenance.edit_url(F.col("dataset"), F.col("record_id")).alias("edit_url"))


@query("text_functions", f"SELECT record_id, {norm('name')} AS name_norm, regexp_extract(lower(coalesce(address, '')), '^\\s*([0-9]+[a-z]?)', 1) AS number, left(regexp_replace(coalesce(postcode, ''), '[^0-9]', '', 'g'), 5) AS digits, {_clean('address')} AS address_clean, concat_ws(' ', nullif(trim(name), ''), nullif(trim(city), '')) AS joined FROM gers_user_input")
def text_functions(spark, directory):
    t = table(spark, directory, "gers_user_input")
    return t.select("record_id", text.normalize_text(F.col("name")).alias("name_norm"), text.house_number(F.col("address")).alias("number"), text.postcode_digits(F.col("postcode")).alias("digits"), text.clean(F.col("address")).alias("address_clean"), F.coalesce(text.join_non_blank(" ", F.col("name"), F.col("city")), F.lit("")).alias("joined"))


@query("jaro_winkler", f"SELECT DISTINCT record_id, overture_id, round({jw(norm('user_name'), norm('overture_name'))}, 9) AS similarity FROM gers_candidates")
def jaro_winkler_names(spark, directory):
    c = table(spark, directory, "gers_candidates")
    return c.select("record_id", "overture_id", F.round(jaro_winkler(text.normalize_text(F.col("user_name")), text.normalize_text(F.col("overture_name"))), 9).alias("similarity")).distinct()


@query("query_variants", SEARCH_CTES.split("WITH", 1)[0] + f"""WITH {USERS_SQL}, queries AS (SELECT record_id, {_clean('address')} AS ad, {_clean('city')} AS ci, {_clean('state')} AS st, {_clean('postcode')} AS po FROM users),
towns AS (SELECT *, concat_ws(', ', nullif(ci, ''), nullif(st, '')) AS town FROM queries), rests AS (SELECT *, [concat_ws(' ', nullif(town, ''), nullif(po, '')), po, ci, town, ''] AS rest FROM towns),
v AS (SELECT record_id, ad, list_transform(rest, lambda x: CASE WHEN x <> '' THEN ad || ', ' || x ELSE ad END) AS v FROM rests)
SELECT record_id, CASE WHEN ad = '' THEN '' ELSE array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), '; ') END AS variants FROM v""")  # fmt: skip
def query_variants(spark, directory):
    u = users(spark, directory)
    return u.select("record_id", F.array_join(geocode.variants(*[F.col(c) for c in ("address", "city", "state", "postcode")]), "; ").alias("variants"))


_LAYERS = [("places", "place", "Places - Place", "POINT"), ("buildings", "building", "Buildings - Building", "POLYGON"), ("base", "water", "Base - Water", "LINESTRING"), ("base", "bathymetry", "Base - Bathymetry", "MULTIPOLYGON"), ("divisions", "division_boundary", "x", "LINESTRING"), (None, None, "My Land Use", "POLYGON"), (None, None, "other", "POINT"), (None, None, "other", "LINESTRING")]
_RANKS = [330, 286, 294, 260, 300, 272, 300, 200]


@query("draw_order", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + f", CAST({rank} AS BIGINT))" for row, rank in zip(_LAYERS, _RANKS, strict=True)) + ") AS t(theme, type, name, geometry_type, draw_rank)")
def draw_order(spark, directory):
    return rules.draw_order(spark.createDataFrame(_LAYERS, "theme string, type string, name string, geometry_type string"))


@query("size_estimate", "SELECT CAST(sum(d) AS BIGINT) AS features_per_km2, sum(d) * 2.5::DOUBLE AS kb_per_km2 FROM (VALUES " + ", ".join(f"({d})" for d in rules.DENSITIES.values()) + ") AS t(d)")
def size_estimate(spark, directory):
    return rules.size_estimate(rules.theme_types(spark))


@query("user_extent", "SELECT min(longitude) AS xmin, min(latitude) AS ymin, max(longitude) AS xmax, max(latitude) AS ymax FROM gers_user_input WHERE isfinite(longitude) AND isfinite(latitude)")
def user_extent(spark, directory):
    return rules.extent_of(table(spark, directory, "gers_user_input"))


@query("union_by_name", "SELECT record_id AS id, name, CAST(NULL AS VARCHAR) AS dataset, round(longitude, 6) AS value FROM gers_user_input UNION ALL SELECT record_id, NULL, NULL, CAST(candidate_rank AS DOUBLE) FROM gers_candidates")
def union_two(spark, directory):
    """Two tables of other columns, one of them of another type on either side."""
    a = table(spark, directory, "gers_user_input").select(F.col("record_id").alias("id"), "name", F.col("longitude").alias("value"))
    b = table(spark, directory, "gers_candidates").select(F.col("record_id").alias("id"), F.lit(None).cast("string").alias("dataset"), F.col("candidate_rank").alias("value"))
    return union_by_name([a, b]).select("id", "name", "dataset", F.round("value", 6).alias("value"))


@query("field_mapping")
def field_mapping(spark, directory):
    """Role of every column of the record tables; the rules run on names alone."""
    rows = [(name, role, field) for name in ("gers_user_input", "gers_output") for role, field in mapping.map_fields(table(spark, directory, name).columns).items()]
    rows += [(name, "id", mapping.preferred_id_field(table(spark, directory, name).columns)) for name in ("gers_user_input", "gers_output")]
    return spark.createDataFrame(rows, "table_name string, role string, field string")


@query("stable_record_ids")
def stable_record_ids(spark, directory):
    """UUIDs that are a function of the key."""
    return mapping.with_record_ids(table(spark, directory, "gers_bridge"), "id", generate=True).select("id", "record_id", "source_record_key")


@query("catalog_fields")
def catalog_fields(spark, directory):
    """Fields of the catalog document for the given tables, named as types of the lake where they have the columns of one."""
    frames = {"place": table(spark, directory, "overture_place"), "division_area": table(spark, directory, "division_area"), "gers_output": table(spark, directory, "gers_output")}
    return spark.createDataFrame(catalog.catalog_fields(frames), "dataset string, position int, field string, type string")


@query("sql_functions", f"SELECT DISTINCT record_id, overture_id, {norm('user_name')} AS name_norm, round({jw(norm('user_name'), norm('overture_name'))}, 9) AS similarity, round(sqrt(pow((overture_longitude - longitude) * 111320.0 * cos(radians((overture_latitude + latitude) / 2.0)), 2) + pow((overture_latitude - latitude) * 110540.0, 2)), 6) AS metres FROM gers_candidates")
def sql_functions(spark, directory):
    """The functions under their SQL names."""
    sql.register(spark)
    table(spark, directory, "gers_candidates").createOrReplaceTempView("gers_candidates_view")
    return spark.sql("""SELECT DISTINCT record_id, overture_id, normalize_text(user_name) AS name_norm, round(jaro_winkler_similarity(normalize_text(user_name), normalize_text(overture_name)), 9) AS similarity,
      round(distance_m(longitude, latitude, overture_longitude, overture_latitude), 6) AS metres FROM gers_candidates_view""")


@query("layer_points")
def layer_points(spark, directory):
    """Centres of the areas' bounds, as a layer of areas is linked by points."""
    return mapping.layer_points(table(spark, directory, "division_area")).select("id", F.round("longitude", 9).alias("longitude"), F.round("latitude", 9).alias("latitude"))
