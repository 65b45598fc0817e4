"""Ranked text search over addresses and places, for one query or a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions.text import clean, contains_all_tokens, first_existing, first_existing_name, join_non_blank, normalize_for_search, search_form, tokens, tokens_of
from geoweft.functions.wkb import intersects_extent, point_xy
from geoweft.operators.spatial_join import usable
from geoweft.options import Extent
from geoweft.session import cut

# attributes' names, scores of the match tiers, the bias of addresses, and the floors of tiers and confidence.
NUMBER = ["number", "housenumber", "house_number"]
STREET = ["street", "street_name", "road", "name"]
LOCALITY = ["city", "locality", "district", "admin2", "subregion"]
REGION = ["region", "state", "province", "admin1"]
POSTAL = ["postcode", "postal_code", "zip"]
COUNTRY = ["country", "country_code"]
PLACE_NAME = ["names.primary", "name", "name_primary", "brand"]
CATEGORY = ["categories.primary", "category", "class", "subtype", "kind"]
EXACT, PREFIX, CONTAINS, TOKEN = 300, 220, 170, 120
ADDRESS_BIAS, PLACE_BIAS = 40, 0
TIERS = ((300, "exact"), (200, "prefix"), (150, "contains"))
CONFIDENCE = ((280, "High"), (190, "Medium"))
MATCH_LABELS = {"exact": "Exact {} match", "prefix": "Strong {} match", "contains": "Partial {} match", "token": "Approximate text match", "locator": "Matched by locator"}
CONFIDENCE_LABELS = {"high": "High confidence", "medium": "Good candidate", "low": "Needs review"}

#: Characters by which tokens meet the words that may hold them.
GRAM = 4


def match_label(tier: str | None, source: str | None) -> str:
    kind = "place" if (source or "").lower() == "place" else "address"
    return MATCH_LABELS.get((tier or "").strip().lower(), "Matched result").format(kind)


def confidence_label(confidence: str | None) -> str:
    return CONFIDENCE_LABELS.get((confidence or "").strip().lower(), "Candidate")


def searchable(df: DataFrame, extent: Extent | None = None) -> DataFrame:
    """display_label, longitude, latitude, search_text of a dataset of points; attributes are found by their usual names.

    The extent is compared with bbox where there is one, so that it reaches the scan, else with the geometry. A table of
    points may have longitude and latitude instead of geometry. A column name without a street column is both street and
    place name, so it shows twice.
    """
    have = {c.lower() for c in df.columns}
    if extent is not None and "bbox" in have:
        df = df.where((F.col("bbox.xmin") <= extent.xmax) & (F.col("bbox.xmax") >= extent.xmin) & (F.col("bbox.ymin") <= extent.ymax) & (F.col("bbox.ymax") >= extent.ymin))
    elif extent is not None and "geometry" in have:
        df = df.where(intersects_extent(F.col("geometry"), extent))
    elif extent is not None:
        df = df.where(F.col("longitude").between(extent.xmin, extent.xmax) & F.col("latitude").between(extent.ymin, extent.ymax))
    name = first_existing(df, ["names.primary"]) if "names" in have and first_existing_name(df, ["names.primary"]) else first_existing(df, PLACE_NAME[1:])
    category = first_existing(df, CATEGORY[:1]) if first_existing_name(df, CATEGORY[:1]) else first_existing(df, CATEGORY[1:])
    number, street, locality, region, postal, country = (F.nullif(first_existing(df, a), F.lit("")) for a in (NUMBER, STREET, LOCALITY, REGION, POSTAL, COUNTRY))
    name, category = F.nullif(name, F.lit("")), F.nullif(category, F.lit(""))
    head = F.nullif(F.trim(F.concat_ws(" ", number, street, name)), F.lit(""))
    label = F.trim(F.concat_ws(", ", head, locality, region, postal, country))
    text = F.lower(F.trim(F.concat_ws(" ", number, street, name, category, locality, region, postal, country)))
    if "geometry" in have:
        at = df.where("geometry is not null").select(label.alias("display_label"), point_xy(F.col("geometry")).alias("_xy"), text.alias("search_text"))
        return at.select("display_label", F.col("_xy.x").alias("longitude"), F.col("_xy.y").alias("latitude"), "search_text")
    return df.select(label.alias("display_label"), F.col("longitude").cast("double").alias("longitude"), F.col("latitude").cast("double").alias("latitude"), text.alias("search_text"))


def _tier(score: Column) -> Column:
    return reduce(lambda rest, t: F.when(score >= t[0], t[1]).otherwise(rest), reversed(TIERS), F.lit("token"))


def _confidence(score: Column) -> Column:
    return reduce(lambda rest, t: F.when(score >= t[0], t[1]).otherwise(rest), reversed(CONFIDENCE), F.lit("Low"))


def _shaped(df: DataFrame, source: str) -> DataFrame:
    score = F.col("score")
    return df.select("display_label", "longitude", "latitude", F.lit(source).alias("source_type"), _tier(score).alias("match_tier"), "score", _confidence(score).alias("confidence"))


def search(prepared: DataFrame, query: str, source_type: str, max_results: int = 25, bias: int | None = None) -> DataFrame:
    """Best matches of one query in searchable() rows, best first (then by label): exact, prefix, substring, all tokens.

    A query without letters or digits gives no rows. The bias of addresses lifts their tiers by design.
    """
    text = search_form(query)
    bias = (ADDRESS_BIAS if source_type == "Address" else PLACE_BIAS) if bias is None else bias
    hay = F.col("search_text")
    tokens = contains_all_tokens(hay, tokens_of(query))
    if not text:
        return _shaped(prepared.withColumn("score", F.lit(0)).where(F.lit(False)), source_type)
    score = F.when(hay == text, EXACT + bias).when(hay.startswith(text), PREFIX + bias).when(hay.contains(text), CONTAINS + bias).when(tokens, TOKEN + bias).otherwise(0)
    hits = prepared.where(hay.contains(text) | tokens).withColumn("score", score).where((F.col("score") > 0) & (F.col("display_label") != ""))
    return _shaped(hits, source_type).orderBy(F.desc("score"), F.asc("display_label"), "longitude", "latitude").limit(min(100, max(1, max_results)))


def search_all(addresses: DataFrame, places: DataFrame, query: str, max_results: int = 25) -> DataFrame:
    """Both sources merged, best first, labels in any case."""
    each = max(max_results, 25)
    both = search(addresses, query, "Address", each).unionByName(search(places, query, "Place", each))
    return both.orderBy(F.desc("score"), F.lower("display_label"), "display_label", "longitude", "latitude").limit(min(100, max(1, max_results)))


def best(addresses: DataFrame, places: DataFrame, query: str) -> DataFrame:
    return search_all(addresses, places, query, 1)


def query_variants(address: str | None, city: str | None, state: str | None, postcode: str | None) -> list[str]:
    """Ever broader queries of one address; [] without an address. Driver-side twin of variants()."""
    a, c, s, z = (" ".join((x or "").strip().strip('"').split()) for x in (address, city, state, postcode))
    if not a:
        return []
    town = ", ".join(x for x in (c, s) if x)
    full = f"{town} {z}" if town and z else town or z
    out: list[str] = []
    for rest in (full, z, c, town, ""):
        candidate = f"{a}, {rest}" if rest else a
        if candidate.lower() not in (o.lower() for o in out):
            out.append(candidate)
    return out


def variants(address: Column, city: Column, state: Column, postcode: Column) -> Column:
    """array<string> as query_variants()."""
    a, c, s, z = (clean(x) for x in (address, city, state, postcode))
    town = F.coalesce(join_non_blank(", ", c, s), F.lit(""))
    full = F.coalesce(join_non_blank(" ", town, z), F.lit(""))
    all_of = F.array(*[F.when(rest != "", F.concat(a, F.lit(", "), rest)).otherwise(a) for rest in (full, z, c, town, F.lit(""))])
    first = F.filter(all_of, lambda x, i: F.array_position(F.transform(all_of, F.lower), F.lower(x)) == i + 1)
    return F.when(a != "", first).otherwise(F.array().cast("array<string>"))


def _grams(word: Column) -> Column:
    """All substrings of one to GRAM characters."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.array(*[F.substr(word, i, F.lit(n)) for n in range(1, GRAM + 1)]))))


def _holders(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(x, w, n): the words w of the targets that hold the token x. Only distinct words meet, on the token's first letters."""
    held = words.select("w", "n", F.explode(_grams(F.col("w"))).alias("_g"))
    return asked.withColumn("_g", F.substring("x", 1, GRAM)).join(held, "_g").where(F.col("w").contains(F.col("x"))).select("x", "w", "n")


def geocode_table(queries: DataFrame, addresses: DataFrame, places: DataFrame, max_rows: int | None = None) -> DataFrame:
    """For each row (row_id, address, city, state, postcode) the best hit of the first variant that has a usable one.

    Returns row_id, query, display_label, longitude, latitude, source_type, match_tier, confidence, score; rows without a
    hit have nulls. max_rows limits the queries (by row_id); by default all are geocoded. A token has letters and digits alone, so a target that
    holds it has a word that does: each variant meets only the targets with a word that holds its rarest token.
    """
    limited = cut(queries if max_rows is None else queries.orderBy("row_id").limit(max_rows))
    rows = limited.select("row_id", variants(*[F.col(c) for c in ("address", "city", "state", "postcode")]).alias("v"))
    exploded = cut(rows.select("row_id", F.posexplode("v").alias("no", "query")).withColumn("q", normalize_for_search(F.col("query"))).where("q != ''"))
    targets = addresses.withColumn("_s", F.lit("Address")).withColumn("_b", F.lit(ADDRESS_BIAS)).unionByName(places.withColumn("_s", F.lit("Place")).withColumn("_b", F.lit(PLACE_BIAS)))
    targets = cut(targets.where((F.col("display_label") != "") & usable(F.col("longitude"), F.col("latitude"))))
    posted = targets.withColumn("w", F.explode(F.array_distinct(tokens(F.col("search_text")))))
    asked = exploded.select("q").distinct().withColumn("t", F.array_distinct(F.split("q", " ")))
    each = asked.select("q", "t", F.explode("t").alias("x"))
    held = cut(_holders(each.select("x").distinct(), posted.groupBy("w").agg(F.count("*").alias("n"))))
    # a variant with a token that no target holds has no hit
    known = each.join(held.groupBy("x").agg(F.sum("n").alias("n")), "x").groupBy("q", "t").agg(F.count("*").alias("k"), F.min_by("x", F.struct("n", "x")).alias("x")).where(F.col("k") == F.size("t"))
    hay = F.col("search_text")
    hits = known.join(held.select("x", "w"), "x").join(posted, "w").where(F.forall("t", lambda x: hay.contains(x)))
    score = F.when(hay == F.col("q"), EXACT).when(hay.startswith(F.col("q")), PREFIX).when(hay.contains(F.col("q")), CONTAINS).otherwise(TOKEN) + F.col("_b")
    order = [F.desc("score"), F.lower("display_label"), "display_label", "_s", "longitude", "latitude"]
    first = hits.withColumn("score", score).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where("r = 1").select("q", "display_label", "longitude", "latitude", "_s", "score")
    top = exploded.join(first, "q").withColumn("r", F.row_number().over(Window.partitionBy("row_id").orderBy("no", *order))).where("r = 1")
    top = top.select("row_id", "query", "display_label", "longitude", "latitude", F.col("_s").alias("source_type"), _tier(F.col("score")).alias("match_tier"), _confidence(F.col("score")).alias("confidence"), "score")
    return limited.select("row_id").join(top, "row_id", "left")
