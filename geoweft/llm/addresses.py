"""Which address records denote the same location: a gazetteer built from the records, and beam search over its entries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.llm.address_parts import parse, postcode5, town_key
from geoweft.session import cut, grows, spread

#: Hypotheses kept of each address after each step of the search.
BEAM = 4
#: A spelling gives way to a near one of its locality that is written at least this many times as often,
RATIO = 3.0
#: but not if it has at least this many house numbers there and this share of the other's support: then it is a street too.
OWN_NUMBERS, OWN_SHARE = 4, 0.15
#: Records in one locality from which on a spelling that gives way to none there is known to be a word everywhere.
KNOWN_SUPPORT = 3
#: Side of the squares, in degrees, in which records without town and postcode take the town of their neighbours.
SQUARE = 0.01
#: Least share of a square's records that must name one town for that.
SQUARE_SHARE = 0.9

_S = T.StringType()
READING = T.StructType([T.StructField("number", _S), T.StructField("direction", _S), T.StructField("words", T.ArrayType(_S)), T.StructField("type", _S), T.StructField("unit", _S), T.StructField("cost", T.DoubleType())])
PARSED = T.StructType([T.StructField("town", _S), T.StructField("postcode", _S), T.StructField("towns", T.ArrayType(_S)), T.StructField("inner_postcode", _S), T.StructField("readings", T.ArrayType(READING))])


@F.pandas_udf(PARSED)
def _parsed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for addresses, towns, postcodes in batches:
        rows = []
        for a, t, p in zip(addresses, towns, postcodes, strict=True):
            readings = parse(a)
            first = readings[0] if readings else None
            rows.append((town_key(t), postcode5(p), first.towns if first else [], first.postcode if first else "", [(r.number, r.direction, r.words, r.type_, r.unit, r.cost) for r in readings]))
        frame = pd.DataFrame(rows, columns=["town", "postcode", "towns", "inner_postcode", "readings"])
        frame["readings"] = [[dict(zip(("number", "direction", "words", "type", "unit", "cost"), r, strict=True)) for r in rs] for rs in frame["readings"]]
        yield frame


def one_edit(a: str, b: str) -> bool:
    """True if one insertion, deletion, replacement or swap of neighbours makes b of a, and they differ."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


@F.pandas_udf(T.BooleanType())
def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _deletions(word: Column) -> Column:
    """The word and what is left of it without one of its letters: words one edit apart share one of these."""
    cut_at = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), cut_at))


def spelling_variants(words: DataFrame, scope: Sequence[str] = (), ratio: float = RATIO, least: int = 4) -> DataFrame:
    """(*scope, word, better, better_n, n): pairs of words one edit apart in one scope of which better is written ratio times as
    often. words: distinct (*scope, word) with their counts n. Words shorter than ``least`` or with a digit are as they are. The
    join is on shared deletions, so no pair of words that aren't near is made."""
    long = words.where((F.length("word") >= least) & ~F.col("word").rlike("[0-9]")).select(*scope, F.col("word").alias("a"), F.col("n").alias("na"))
    keyed = long.withColumn("d", F.explode(_deletions(F.col("a"))))
    other = keyed.select(*scope, "d", F.col("a").alias("b"), F.col("na").alias("nb"))
    pairs = keyed.join(grows(other), [*scope, "d"]).where((F.col("nb") >= ratio * F.col("na")) & (F.col("a") != F.col("b"))).select(*scope, "a", "b", "na", "nb").distinct()
    return pairs.where(_one_edit(F.col("a"), F.col("b"))).select(*scope, F.col("a").alias("word"), F.col("b").alias("better"), F.col("nb").alias("better_n"), F.col("na").alias("n"))


def _best_spellings(variants: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(*keys, name): the BEAM best spellings that a word may give way to, best first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("better_n"), "better")
    ranked = variants.withColumn("r", F.row_number().over(w)).where(F.col("r") <= BEAM)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "better"))).alias(name))  # at most BEAM each


def street_spellings(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((locality, word, local), (word, everywhere)): the spellings that a street word gives way to.

    words: locality, word, n records and nn house numbers. Spellings are clustered within each locality: a word gives way to a
    near one that is RATIO times as usual there, unless it has house numbers and support of its own there. Only a word that
    is known in no locality and gives way to none in its own falls back on the words known elsewhere: to a near one with
    the same first letter, as slips of the first letter are rare and other first letters make other names.
    """
    local = spelling_variants(words, ["locality"])
    local = local.join(grows(words.select("locality", "word", "nn")), ["locality", "word"])
    local = cut(local.where((F.col("nn") < OWN_NUMBERS) | (F.col("n") < OWN_SHARE * F.col("better_n"))))
    beaten = local.select("locality", "word").distinct()
    known = cut(words.where(F.col("n") >= KNOWN_SUPPORT).join(grows(beaten), ["locality", "word"], "left_anti").select("word").distinct())
    overall = words.groupBy("word").agg(F.sum("n").alias("n"))
    near = spelling_variants(overall).where(F.substr("word", F.lit(1), F.lit(1)) == F.substr("better", F.lit(1), F.lit(1)))
    near = near.join(grows(known), "word", "left_anti").join(grows(known.select(F.col("word").alias("better"))), "better", "left_semi")
    return cut(_best_spellings(local, ["locality", "word"], "local")), cut(_best_spellings(near, ["word"], "everywhere"))


def address_records(users: DataFrame, linked: DataFrame) -> DataFrame:
    """record_id, address, city, postcode, longitude, latitude: one row per record of both tables with a non-blank address.

    A null record_id is no record. Rows of one record are folded: a later row with fewer fields adds nothing, and of several
    writings the least in code-point order counts, so the result doesn't depend on the order of rows.
    """
    cols = ["record_id", "address", "city", "postcode", "longitude", "latitude"]
    both = users.select(*cols).unionByName(linked.select("record_id", F.col("overture_address").alias("address"), "city", "postcode", "longitude", "latitude"))
    filled = [F.min(F.when(F.trim(c) != "", F.col(c))).alias(c) for c in ("address", "city", "postcode")]
    place = F.min(F.when(F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90), F.struct("longitude", "latitude"))).alias("_p")
    folded = both.where(F.col("record_id").isNotNull()).groupBy("record_id").agg(*filled, place)
    return folded.where(F.col("address").isNotNull()).select("record_id", "address", "city", "postcode", "_p.longitude", "_p.latitude")


def _localities(parsed: DataFrame) -> DataFrame:
    """parsed with ``locality``: by the written town, the postcode, the nearest spelling of a town, the address's own ending,
    or the records around; null if nothing tells."""
    p = F.col("p")
    evidence = parsed.select("record_id", p.town.alias("town"), F.coalesce(F.nullif(p.postcode, F.lit("")), F.nullif(p.inner_postcode, F.lit(""))).alias("postcode"), F.coalesce(F.get(p.towns, F.lit(0)), F.lit("")).alias("inner_town"), "longitude", "latitude")
    counts = evidence.where("town != ''").groupBy("town", "postcode").agg(F.count("*").alias("n"))
    # a town is a spelling without a near one that is written far more often
    spellings = counts.groupBy("town").agg(F.sum("n").alias("n"))
    variants = cut(spelling_variants(spellings.withColumnRenamed("town", "word")))
    fixed = variants.groupBy(F.col("word").alias("town")).agg(F.max_by("better", F.struct("better_n", "better")).alias("as_town"))
    by_code = counts.where("postcode is not null").join(grows(fixed), "town", "left").groupBy("postcode", F.coalesce("as_town", "town").alias("of_code")).agg(F.sum("n").alias("n"))
    by_code = cut(by_code.groupBy("postcode").agg(F.max_by("of_code", F.struct("n", "of_code")).alias("of_code")))
    towns = spellings.join(grows(fixed), "town", "left").select("town", F.coalesce("as_town", "town").alias("of_town"), F.col("as_town").isNull().alias("sure"))
    named = evidence.join(grows(towns), "town", "left").join(grows(by_code), "postcode", "left")
    inner = towns.where("sure").select(F.col("town").alias("inner_town"), F.lit(True).alias("_known"))
    named = named.join(grows(inner), "inner_town", "left")
    told = F.coalesce(F.when(F.col("sure"), F.col("of_town")), F.col("of_code"), F.when(F.col("_known"), F.col("inner_town")), F.col("of_town"))
    named = cut(named.select("record_id", told.alias("locality"), F.floor(F.col("longitude") / SQUARE).cast("long").alias("sx"), F.floor(F.col("latitude") / SQUARE).cast("long").alias("sy")))
    squares = named.where("locality is not null and sx is not null").groupBy("sx", "sy", "locality").agg(F.count("*").alias("n")).groupBy("sx", "sy").agg(F.max_by("locality", F.struct("n", "locality")).alias("around"), (F.max("n") / F.sum("n")).alias("share"))
    lost = named.where("locality is null and sx is not null").join(grows(squares.where(F.col("share") >= SQUARE_SHARE)), ["sx", "sy"]).select("record_id", F.col("around").alias("locality"))
    known = named.where("locality is not null").select("record_id", "locality").unionByName(lost)
    return parsed.join(grows(known), "record_id", "left")


def resolve(records: DataFrame) -> DataFrame:
    """record_id, locality, street_id, street, number, unit of every record: the location it denotes; of a record without
    address the locality alone, with the rest null.

    1. Every address is read in one or more ways. 2. Its locality is found. 3. Street words that are near a far more usual
    word are clustered with it; the usual spellings with their directions and types are the gazetteer of a locality, an entry
    being a street that no other entry of the same name completes. 4. Beam search: the hypotheses of an address are its
    readings, for each the BEAM best spellings of every word, for each the entries that agree with what is written. Far-
    fetched readings, edits and missing parts cost; the cheapest hypothesis wins, ties by support, then by text. Where
    several entries complete a writing it denotes a street of its own.

    An address whose locality nothing tells is in a locality of its own, '?' and its record_id, as nothing says that two of
    them are in one city; so it denotes no other's location. One without a number has the number '' and is equal to others
    without. The street identifier is a 64-bit number of locality and street; joins on it compare the texts as well.
    """
    read = cut(spread(records).select("record_id", _parsed("address", "city", "postcode").alias("p"), "longitude", "latitude"))  # read several times below
    parsed = cut(_localities(read).select("record_id", F.coalesce("locality", F.concat(F.lit("?"), "record_id")).alias("locality"), F.col("p.readings").alias("readings")))
    first_reading = F.get("readings", F.lit(0))
    written = parsed.select("locality", F.explode(first_reading["words"]).alias("word"), first_reading["number"].alias("number"))
    local, everywhere = street_spellings(cut(written.groupBy("locality", "word").agg(F.count("*").alias("n"), F.count_distinct("number").alias("nn"))))

    readings = parsed.select("record_id", "locality", F.posexplode("readings").alias("reading", "q")).select("record_id", "locality", "reading", "q.*")
    # every reading with each word's spellings: as written and the better ones
    spelled = readings.select("*", F.posexplode_outer("words").alias("at", "word")).join(grows(local), ["locality", "word"], "left").join(grows(everywhere), "word", "left")
    spelled = spelled.withColumn("fixes", F.coalesce("local", "everywhere"))
    options = F.concat(F.transform(F.coalesce("fixes", F.array().cast("array<struct<r:int,better:string>>")), lambda x: F.struct((x.r * 0.5).alias("c"), x.better.alias("s"))), F.array(F.struct(F.when(F.col("fixes").isNotNull(), 2.5).otherwise(0.0).alias("c"), F.col("word").alias("s"))))
    per = ["record_id", "locality", "reading", "number", "direction", "type", "unit", "cost"]
    chosen = spelled.groupBy(*per).agg(F.array_sort(F.collect_list(F.struct("at", options.alias("o")))).alias("options"))
    start = F.array(F.struct(F.lit(0.0).alias("c"), F.lit("").alias("s")))

    def extend(beam: Column, at: Column) -> Column:
        grown = F.flatten(F.transform(beam, lambda b: F.transform(at.o, lambda x: F.struct((b.c + x.c).alias("c"), F.when(b.s == "", x.s).otherwise(F.concat(b.s, F.lit(" "), x.s)).alias("s")))))
        return F.slice(F.array_sort(grown), 1, BEAM)

    names = cut(chosen.select(*per, F.explode(F.aggregate("options", start, extend)).alias("h")).select(*per, (F.col("cost") + F.col("h.c")).alias("paid"), F.coalesce("h.s", F.lit("")).alias("name")))

    # gazetteer: the best spelling of the first reading, with the directions and types it is written with
    first = names.where("reading = 0").groupBy("record_id", "locality", "direction", "type").agg(F.min(F.struct("paid", "name")).alias("b"))
    entries = first.groupBy("locality", F.col("b.name").alias("name"), "direction", "type").agg(F.count("*").alias("n"))
    gazetteer = entries.groupBy("locality", "name").agg(F.collect_list(F.struct("direction", "type", "n")).alias("entries"), F.sum("n").alias("support"))  # at most directions x types each

    def agrees(written: Column, street: Column) -> Column:
        return (written == "") | (written == street)

    streets = F.filter("entries", lambda e: ~F.exists(F.col("entries"), lambda o: (agrees(e.direction, o.direction) & agrees(e.type, o.type)) & ((e.direction != o.direction) | (e.type != o.type))))
    gazetteer = cut(gazetteer.select("locality", "name", "support", streets.alias("streets")))
    found = names.where("name != ''").join(grows(gazetteer), ["locality", "name"])
    direction, type_ = F.col("direction"), F.col("type")
    fitting = F.filter("streets", lambda e: agrees(direction, e.direction) & agrees(type_, e.type))
    found = found.withColumn("fit", fitting)
    one = F.size("fit") == 1
    street = F.when(one, F.concat_ws(" ", F.col("fit")[0]["direction"], F.col("name"), F.col("fit")[0]["type"])).otherwise(F.concat_ws(" ", F.lit("?"), direction, "name", type_))
    missing = F.when(one, (F.col("fit")[0]["direction"] != direction).cast("int") * 0.2 + (F.col("fit")[0]["type"] != type_).cast("int") * 0.2).when(F.size("fit") > 1, F.lit(0.6)).otherwise(F.lit(3.0))
    best = found.groupBy("record_id", "locality").agg(F.min(F.struct((F.col("paid") + missing).alias("total"), (-F.col("support")).alias("s"), street.alias("street"), "number", "unit")).alias("b"))
    told = best.select("record_id", F.xxhash64("locality", "b.street").alias("street_id"), F.col("b.street").alias("street"), F.col("b.number").alias("number"), F.col("b.unit").alias("unit"))
    return parsed.select("record_id", "locality").join(grows(told), "record_id", "left")


def _located(users: DataFrame, linked: DataFrame) -> DataFrame:
    """The records whose address denotes a location: record_id, its parts, and ``location``, a 64-bit number of street
    identifier, number and unit."""
    at = resolve(cut(address_records(users, linked))).where(F.col("street").isNotNull())
    return cut(at.select("record_id", F.xxhash64("street_id", "number", "unit").alias("location"), "locality", "street", "number", "unit"))


def location_members(users: DataFrame, linked: DataFrame) -> DataFrame:
    """(record_id, location_id, links): one row per record with an address, the class of records that denote its location, named
    by its least record_id, and the number of other records in it. Classes of any size stay one row per record."""
    at = _located(users, linked)
    where = ["location", "locality", "street", "number", "unit"]
    classes = at.groupBy(*where).agg(F.min("record_id").alias("location_id"), (F.count("*") - 1).alias("links"))
    return at.join(grows(classes), where).select("record_id", "location_id", "links")


def same_location(users: DataFrame, linked: DataFrame) -> DataFrame:
    """(record_id_1, record_id_2), record_id_1 < record_id_2: all pairs of records that denote one location.

    The pairs are those within the classes of location_members, which is the form to use where a location may hold very many
    records; here every pair is asked for.
    """
    at = _located(users, linked)
    parts = ["locality", "street", "number", "unit"]
    a = at.select(F.col("record_id").alias("record_id_1"), "location", *[F.col(c).alias(f"_{c}") for c in parts])
    b = at.withColumnRenamed("record_id", "record_id_2")
    same = (a["location"] == b["location"]) & (F.col("record_id_1") < F.col("record_id_2"))
    for c in parts:
        same = same & (F.col(f"_{c}") == F.col(c))
    return a.join(grows(b), same).select("record_id_1", "record_id_2")
