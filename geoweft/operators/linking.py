"""Linking local records to target places or addresses: band join, scores, rank, acceptance, outputs and review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions.similarity import jaro_winkler
from geoweft.functions.text import LIST_SEPARATOR, blank_to_null, first_existing, first_existing_name, house_number, normalize_text, postcode_digits
from geoweft.functions.wkb import point_xy
from geoweft.operators.spatial_join import band_join, distance_m
from geoweft.options import BridgeOptions, Extent, LinkOptions, LinkSummary
from geoweft.session import cut

# Names under which targets hold their attributes, in order of preference.
PLACE_NAME = ["names.primary", "name", "name_primary", "brand"]
PLACE_STREET = ["address_freeform", "addresses", "address", "street", "full_address"]
PLACE_TOWN = ["address_locality", "addresses", "locality", "city"]
PLACE_REGION = ["address_region", "addresses", "region", "state"]
PLACE_POSTCODE = ["address_postcode", "addresses", "postcode", "postal_code", "zip"]
ADDRESS_NUMBER = ["number", "housenumber", "house_number"]
ADDRESS_STREET = ["street", "street_name", "road", "name"]
ADDRESS_UNIT = ["unit", "address_unit", "suite"]
ADDRESS_TOWN = ["postal_city", "city", "locality", "district"]
ADDRESS_REGION = ["region", "state", "province"]
ADDRESS_POSTCODE = ["postcode", "postal_code", "zip"]
ADDRESS_COUNTRY = ["country", "country_code"]
#: Score above the threshold up to which a link counts as weak.
WEAK_BUFFER = 8.0
# Weights of the scores.
BOTH, ONE, NUMBERED, UNNUMBERED = (60.0, 25.0, 15.0), (80.0, 20.0), (90.0, 10.0), (70.0, 10.0)
EXACT_SIMILARITY = 0.995

USER_COLUMNS = ["record_id", "source_record_key", "name", "address", "city", "state", "postcode", "longitude", "latitude"]


def user_records(df: DataFrame) -> DataFrame:
    """The contract columns, text as string and positions as double; rows without record_id or position are left out, and so
    are positions that are no numbers. Missing text columns are null."""
    have = {c.lower(): c for c in df.columns}
    text = [(F.col(have[c]).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in USER_COLUMNS[:7]]
    place = [F.col(have[c]).try_cast("double").alias(c) for c in USER_COLUMNS[7:]]
    return df.select(*text, *place).where("record_id is not null and longitude is not null and latitude is not null")


def _joined(field: str, distinct: bool, left: int | None = None) -> Column:
    values = F.transform(F.col("addresses"), lambda a: a[field].cast("string"))
    kept = F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))
    if left:
        kept = F.transform(kept, lambda v: F.left(v, F.lit(left)))
    kept = F.array_distinct(kept) if distinct else kept
    return F.when(F.size(kept) > 0, F.array_join(kept, LIST_SEPARATOR))


def flattened(field: str) -> Column:
    """A place's address field over its list of addresses: freeform keeps all in order, the others distinct values in order
    of first sight, postcodes cut to five; blanks are skipped, none gives null."""
    return _joined(field, field != "freeform", 5 if field == "postcode" else None)


def _attribute(df: DataFrame, aliases: list[str], field: str) -> Column:
    name = first_existing_name(df, aliases)
    if name == "`addresses`":
        return flattened(field)
    value = first_existing(df, aliases)
    return F.left(value, F.lit(5)) if field == "postcode" else value


def _within(df: DataFrame, extent: Extent | None) -> DataFrame:
    """Four comparisons on bbox that reach the scan; no filter without an extent or a bbox."""
    if extent is None or "bbox" not in {c.lower() for c in df.columns}:
        return df
    return df.where((F.col("bbox.xmin") <= extent.xmax) & (F.col("bbox.xmax") >= extent.xmin) & (F.col("bbox.ymin") <= extent.ymax) & (F.col("bbox.ymax") >= extent.ymin))


def _with_point(df: DataFrame) -> DataFrame:
    if "geometry" in df.columns:
        return df.where("geometry is not null").withColumn("_xy", point_xy(F.col("geometry"))).withColumn("_lon", F.col("_xy.x")).withColumn("_lat", F.col("_xy.y"))
    return df.withColumn("_lon", F.col("longitude").cast("double")).withColumn("_lat", F.col("latitude").cast("double"))


def place_targets(df: DataFrame, extent: Extent | None = None) -> DataFrame:
    """Targets in the form the link needs; a table of points may have longitude and latitude instead of geometry."""
    if "name" not in {c.lower() for c in df.columns} and not first_existing_name(df, PLACE_STREET) and not first_existing_name(df, PLACE_NAME):
        raise ValueError("the target has neither a name nor an address column")
    name, street = (F.coalesce(_attribute(df, a, f), F.lit("")) for a, f in ((PLACE_NAME, ""), (PLACE_STREET, "freeform")))
    rest = [F.coalesce(_attribute(df, a, f), F.lit("")) for a, f in ((PLACE_TOWN, "locality"), (PLACE_REGION, "region"), (PLACE_POSTCODE, "postcode"))]
    at = _with_point(_within(df, extent))
    return at.select(
        F.col("id").cast("string").alias("overture_id"), name.alias("overture_name"), street.alias("overture_address"), F.col("_lon").alias("overture_longitude"), F.col("_lat").alias("overture_latitude"),
        normalize_text(name).alias("t_name"), normalize_text(street).alias("t_street"), normalize_text(F.trim(F.concat_ws(" ", street, *rest))).alias("t_full"),
    )


def address_targets(df: DataFrame, extent: Extent | None = None) -> DataFrame:
    if not first_existing_name(df, ADDRESS_NUMBER) or not first_existing_name(df, ADDRESS_STREET):
        raise ValueError("an address target needs a number and a street column")
    number = first_existing(df, ADDRESS_NUMBER)
    parts = [F.nullif(first_existing(df, a), F.lit("")) for a in (ADDRESS_STREET, ADDRESS_UNIT, ADDRESS_TOWN, ADDRESS_REGION)]
    postcode = F.left(first_existing(df, ADDRESS_POSTCODE), F.lit(5))
    base = [F.nullif(number, F.lit("")), parts[0], parts[1]]
    full = [*base, parts[2], parts[3], F.nullif(postcode, F.lit("")), F.nullif(first_existing(df, ADDRESS_COUNTRY), F.lit(""))]
    address = F.trim(F.concat_ws(" ", *base))
    at = _with_point(_within(df, extent))
    return at.select(
        F.col("id").cast("string").alias("overture_id"), address.alias("overture_name"), address.alias("overture_address"), F.col("_lon").alias("overture_longitude"), F.col("_lat").alias("overture_latitude"),
        normalize_text(address).alias("t_street"), normalize_text(F.trim(F.concat_ws(" ", *full))).alias("t_full"), F.lower(F.trim(number)).alias("t_number"), postcode_digits(postcode).alias("t_postcode"),
    )


def _users(df: DataFrame) -> DataFrame:
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("name", "address", "city", "state", "postcode")}
    return df.select(
        "record_id", *[text[c].alias(f"user_{c}") for c in text], "longitude", "latitude", normalize_text(text["name"]).alias("u_name"), normalize_text(text["address"]).alias("u_street"),
        normalize_text(F.trim(F.concat_ws(" ", text["address"], text["city"], text["state"], text["postcode"]))).alias("u_full"), house_number(F.col("address")).alias("u_number"), postcode_digits(F.col("postcode")).alias("u_postcode"),
    )


def _extent_of(users: DataFrame) -> Extent | None:
    e = users.agg(F.min("longitude").alias("a"), F.min("latitude").alias("b"), F.max("longitude").alias("c"), F.max("latitude").alias("d")).first()
    return None if e is None or e.a is None else Extent(e.a, e.b, e.c, e.d)


_KEEP = ["record_id", "user_name", "user_address", "user_city", "user_state", "user_postcode", "longitude", "latitude", "gers_id", "overture_id", "overture_name", "overture_address", "overture_longitude", "overture_latitude", "distance_m", "name_similarity", "address_similarity", "distance_similarity"]


def _best(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Exact copies of a target are kept apart by nothing, so the id ends the order."""
    w = Window.partitionBy("record_id").orderBy(*order, F.col("overture_id").asc_nulls_last())
    return df.withColumn("candidate_rank", F.row_number().over(w).cast("long")).where(F.col("candidate_rank") <= k)


def place_candidates(users: DataFrame, targets: DataFrame, options: LinkOptions | None = None) -> DataFrame:
    """The k best candidates of each record with rank and acceptance. users: user_records(); targets: place_targets()."""
    o = options or LinkOptions()
    lanes = ((F.col("u_name") != "") & (F.col("t_name") != "")) | ((F.col("u_street") != "") & (F.col("t_street") != "")) | ((F.col("u_name") == "") & (F.col("u_street") != "") & (F.col("t_name") != ""))
    met = band_join(_users(users), targets, o.max_distance_m, right_xy=("overture_longitude", "overture_latitude")).where(lanes)
    met = met.withColumn("distance_m", distance_m(F.col("longitude"), F.col("latitude"), F.col("overture_longitude"), F.col("overture_latitude"))).where(F.col("distance_m") <= o.max_distance_m)
    named = F.when((F.col("u_name") != "") & (F.col("t_name") != ""), jaro_winkler(F.col("u_name"), F.col("t_name")))
    streets = F.when((F.col("u_street") != "") & (F.col("t_street") != ""), F.greatest(jaro_winkler(F.col("u_street"), F.col("t_street")), jaro_winkler(F.col("u_full"), F.col("t_full"))))
    scored = met.withColumn("name_similarity", named).withColumn("address_similarity", streets).withColumn("distance_similarity", F.greatest(F.lit(0.0), 1.0 - F.col("distance_m") / o.max_distance_m)).withColumn("gers_id", F.col("overture_id"))
    n, a, d = (F.col(c) for c in ("name_similarity", "address_similarity", "distance_similarity"))
    strategy = F.when(n.isNotNull() & a.isNotNull(), "name_address").when(n.isNotNull(), "name").when(a.isNotNull(), "address").otherwise("nearby_only")
    score = F.when(n.isNull() & a.isNull(), d * 100.0).when(n.isNull(), a * ONE[0] + d * ONE[1]).when(a.isNull(), n * ONE[0] + d * ONE[1]).otherwise(n * BOTH[0] + a * BOTH[1] + d * BOTH[2])
    ranked = _best(scored.select(*_KEEP, strategy.alias("match_strategy"), score.alias("gers_match_score")), [F.col("gers_match_score").desc(), F.col("distance_m").asc(), F.col("overture_name").asc()], o.k)
    similar = (n.isNull() | (n >= o.name_threshold)) & (a.isNull() | (a >= o.address_threshold)) & (n.isNotNull() | a.isNotNull())
    if o.allow_nearby_only:
        similar = similar | (n.isNull() & a.isNull() & (F.col("distance_m") <= o.nearby_only_m))
    return ranked.withColumn("accepted", (F.col("candidate_rank") == 1) & (F.col("gers_match_score") >= o.score_threshold) & similar)


def address_candidates(users: DataFrame, targets: DataFrame, options: LinkOptions | None = None) -> DataFrame:
    """As place_candidates, against addresses: number and postcode lead the order. A null number of the target leaves
    acceptance null, which isn't acceptance."""
    o = options or LinkOptions(target="addresses")
    met = band_join(_users(users), targets, o.max_distance_m, right_xy=("overture_longitude", "overture_latitude")).where((F.col("u_street") != "") & (F.col("t_street") != ""))
    met = met.withColumn("distance_m", distance_m(F.col("longitude"), F.col("latitude"), F.col("overture_longitude"), F.col("overture_latitude"))).where(F.col("distance_m") <= o.max_distance_m)
    similarity = F.greatest(jaro_winkler(F.col("u_street"), F.col("t_street")), jaro_winkler(F.col("u_full"), F.col("t_full")))
    scored = met.withColumn("name_similarity", F.lit(None).cast("double")).withColumn("address_similarity", similarity).withColumn("distance_similarity", F.greatest(F.lit(0.0), 1.0 - F.col("distance_m") / o.max_distance_m)).withColumn("gers_id", F.col("overture_id"))
    number = (F.col("u_number") != "") & (F.col("t_number") != "") & (F.col("u_number") == F.col("t_number"))
    post = (F.col("u_postcode") == "") | (F.col("t_postcode") == "") | (F.col("u_postcode") == F.col("t_postcode"))
    scored = scored.select(*_KEEP, number.alias("house_number_match"), post.alias("postcode_compatible"))
    sure = F.col("house_number_match") & F.col("postcode_compatible")
    a, d = F.col("address_similarity"), F.col("distance_similarity")
    strategy = F.when(sure & (a >= EXACT_SIMILARITY), "exact_address").when(a.isNotNull(), "address").otherwise("nearby_only")
    score = F.when(sure, a * NUMBERED[0] + d * NUMBERED[1]).otherwise(a * UNNUMBERED[0] + d * UNNUMBERED[1])
    ranked = _best(scored.withColumn("match_strategy", strategy).withColumn("gers_match_score", score), [F.when(sure, 0).otherwise(1).asc(), F.col("gers_match_score").desc(), F.col("distance_m").asc(), F.col("overture_address").asc()], o.k)
    return ranked.withColumn("accepted", (F.col("candidate_rank") == 1) & (F.col("gers_match_score") >= o.score_threshold) & (a >= o.address_threshold) & F.col("house_number_match") & F.col("postcode_compatible"))


def review_class(gers_id: Column, score: Column, threshold: float) -> Column:
    return F.when(gers_id.isNull() | (F.trim(gers_id) == ""), "unmatched").when(score < threshold + WEAK_BUFFER, "weak").otherwise("linked")


def accepted_links(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("accepted") & (F.col("candidate_rank") == 1))


def linked_output(users: DataFrame, candidates: DataFrame, options: LinkOptions | None = None) -> DataFrame:
    """Every record with its accepted link or nulls, and its review class. Repeated records each get the link."""
    o = options or LinkOptions()
    a = accepted_links(candidates).select(
        F.col("record_id").alias("_r"), "gers_id", "gers_match_score", F.col("match_strategy").alias("gers_match_strategy"), F.col("distance_m").alias("gers_match_distance_m"), F.col("name_similarity").alias("gers_name_similarity"),
        F.col("address_similarity").alias("gers_address_similarity"), "overture_address", "overture_name", "overture_id",
    )
    joined = users.select(*USER_COLUMNS).join(a, F.col("record_id") == F.col("_r"), "left").drop("_r")
    return joined.withColumn("gers_link_review", review_class(F.col("gers_id"), F.col("gers_match_score"), o.score_threshold))


def bridge_rows(users: DataFrame, candidates: DataFrame, options: BridgeOptions | None = None) -> DataFrame:
    """One row per accepted link and record, ordered by record_id, all text."""
    o = options or BridgeOptions()
    a = accepted_links(candidates)
    u = users.select(F.col("record_id").alias("_r"), "source_record_key")
    stamp = F.lit(o.update_time) if o.update_time else F.current_timestamp().cast("string")
    constant = lambda v, other="unknown": F.lit(v if v and v.strip() else other)
    return a.join(u, F.col("record_id") == F.col("_r")).select(
        F.col("gers_id").alias("id"), "record_id", "source_record_key", stamp.alias("update_time"), F.lit(o.dataset).alias("dataset"), F.lit(o.theme).alias("theme"), F.lit(o.type_).alias("type"),
        F.lit(o.linkage_policy).alias("linkage_policy"), F.lit(o.source_geometry_policy).alias("source_geometry_policy"), "match_strategy", F.col("gers_match_score").cast("string").alias("match_score"),
        constant(o.release).alias("overture_release"), constant(o.source_layer, o.dataset).alias("source_layer"), F.lit(o.tool).alias("linkage_tool"),
    ).orderBy("record_id")


def strategy_counts(candidates: DataFrame) -> DataFrame:
    counted = accepted_links(candidates).groupBy(F.coalesce("match_strategy", F.lit("unknown")).alias("match_strategy")).agg(F.count("*").alias("n"))
    return counted.orderBy("match_strategy")


def signal_coverage(users: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: how many records have a name and an address, and how many candidates a similarity of each."""
    u = users.agg(F.count("*").alias("records"), F.count_if(F.trim("name") != "").alias("with_name"), F.count_if(F.trim("address") != "").alias("with_address"))
    c = candidates.agg(F.count("*").alias("candidates"), F.count_if(F.col("name_similarity").isNotNull()).alias("with_name_similarity"), F.count_if(F.col("address_similarity").isNotNull()).alias("with_address_similarity"))
    both = u.unionByName(c, allowMissingColumns=True)  # one row each, folded into one
    return both.agg(*[F.max(n).alias(n) for n in both.columns])


def link_summary(output: DataFrame) -> LinkSummary:
    r = output.agg(F.count("*").alias("n"), F.count_if(F.col("gers_link_review") != "unmatched").alias("linked"), F.count_if(F.col("gers_link_review") == "weak").alias("weak")).first()
    return LinkSummary(r.n, r.linked, max(0, r.n - r.linked), r.weak)


def review_unmatched(output: DataFrame, review_column: str | None = "gers_link_review", id_column: str = "gers_id") -> DataFrame:
    """By the review column if it is there, else by the blank id."""
    if review_column and review_column in output.columns:
        return output.where(F.col(review_column) == "unmatched")
    return output.where(F.col(id_column).isNull() | (F.trim(id_column) == ""))


def review_weak(output: DataFrame, threshold: float = 72.0, buffer: float = WEAK_BUFFER, review_column: str | None = "gers_link_review", id_column: str = "gers_id", score_column: str = "gers_match_score") -> DataFrame:
    if review_column and review_column in output.columns:
        return output.where(F.col(review_column) == "weak")
    return output.where((F.trim(id_column) != "") & (F.col(score_column) >= threshold) & (F.col(score_column) < threshold + buffer))


def review_source_keys(source: DataFrame, key: str, selected: DataFrame, selected_key: str | None = None) -> DataFrame:
    """Rows of source whose key is among the selected ones; blank keys select nothing."""
    keys = selected.select(F.col(selected_key or key).cast("string").alias("_k")).where(blank_to_null(F.col("_k")).isNotNull()).distinct()
    return source.join(keys, F.col(key).cast("string") == F.col("_k"), "left_semi")


def relate(source: DataFrame, key: str, output: DataFrame, output_key: str = "record_id") -> DataFrame:
    """Source rows with the link of their key, one to one: of repeated output rows the best score counts, of equal scores
    the last id."""
    best = output.groupBy(F.col(output_key).alias("_k")).agg(F.max_by(F.struct("gers_id", "gers_match_score", "gers_link_review"), F.struct(F.coalesce("gers_match_score", F.lit(-1.0)).alias("s"), F.coalesce("gers_id", F.lit("")).alias("g"))).alias("_o"))
    return source.join(best, F.col(key).cast("string") == F.col("_k"), "left").select(*source.columns, "_o.gers_id", "_o.gers_match_score", "_o.gers_link_review")


def _any_name(records: DataFrame) -> bool:
    return not records.where(blank_to_null(F.col("name")).isNotNull()).isEmpty()


@dataclass
class LinkResult:
    candidates: DataFrame
    accepted: DataFrame
    output: DataFrame
    bridge: DataFrame
    summary: LinkSummary


def link(users: DataFrame, target: DataFrame, options: LinkOptions | None = None, bridge: BridgeOptions | None = None) -> LinkResult:
    """The whole link. Fails fast where input is empty or the target lacks the columns it needs."""
    o = options or LinkOptions()
    records = user_records(users)
    if records.isEmpty():
        raise ValueError("no record has a record_id and a position")
    extent = _extent_of(records) if o.clip_to_extent else None
    if extent is not None and o.buffer_extent:
        extent = extent.buffered(o.max_distance_m / 50_000.0)
    if target.isEmpty():
        raise ValueError("the target holds no rows")
    if o.target == "places" and not first_existing_name(target, PLACE_STREET) and not _any_name(records):
        raise ValueError("no record has a name, and the places have no address column")
    if o.target == "places":
        candidates = place_candidates(records, place_targets(target, extent), o)
    else:
        candidates = address_candidates(records, address_targets(target, extent), o)
    candidates = cut(candidates)  # read by the four results
    output = linked_output(records, candidates, o)
    return LinkResult(candidates, accepted_links(candidates), output, bridge_rows(records, candidates, bridge), link_summary(output))
