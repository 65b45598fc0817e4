"""Matching records with linked places without a common key: evidence per candidate pair, then loopy belief propagation."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweft.llm.address_parts import fold
from geoweft.llm.addresses import _deletions, one_edit, resolve
from geoweft.operators.spatial_join import distance_m
from geoweft.session import cut, grows

# Words of business names that say nothing, and written forms of the others.
SILENT = "a an and co corp inc ltd llc of plc sons the"
ABBREVIATIONS = {
    "center": "centre cntr ctr", "clinic": "clin", "community": "comm", "department": "dept", "elementary": "elem", "group": "grp", "market": "mkt", "medical": "med", "office": "off offices",
    "pharmacy": "pharm", "school": "sch schl", "station": "sta stn", "supply": "sup suppl", "veterinary": "vet", "university": "univ", "hospital": "hosp", "restaurant": "rest",
}
_SILENT = frozenset(SILENT.split())
_FULL = {short: full for full, shorts in ABBREVIATIONS.items() for short in shorts.split()}

#: Share of all names from which on a word is generic. So at most words_per_name / share words are generic, and they may
#: come to the driver and to every task.
GENERIC_SHARE = 0.003
#: Weights of words in the similarity of names.
WEIGHT_GENERIC, WEIGHT_OWN = 1.0, 4.0
#: Natural logarithms of likelihood ratios of a pair, by what its attributes say.
PRIOR = -6.0
NAME_STEPS = ((0.9, 7.5), (0.8, 5.0), (0.7, 2.0), (0.55, -2.0), (0.0, -7.0))
ADDRESS_SAME, ADDRESS_SLIP, ADDRESS_OTHER = 5.0, -2.0, -7.0
DISTANCE_STEPS = ((100.0, 4.0), (150.0, 1.0), (1000.0, -3.5), (float("inf"), -3.0))
#: Distance in metres up to which positions speak for a pair, so the reach of the grid's blocks.
NEAR = 150.0
#: Logit below which a pair is no link: its odds are under one in four thousand, whatever its rivals are.
LEAST_LOGIT = -8.5
#: Pairs of a block from which on it is divided into parts of about so many pairs, which hold the same pairs together.
HOT = 20_000
#: Penalty of a second record of one place: places are delivered twice now and then, so the factor on their side is soft.
SECOND_RECORD = 0.3
#: Belief propagation: the first damping, the rounds after which it grows, and the change at which a link has converged.
DAMPING, PATIENCE, TOLERANCE = 0.5, 30, 1e-3


def name_words(name: str | None, locality: str | None) -> list[str]:
    """The telling words of a name: plain form without accents, marks, silent words, branch numbers and the town behind it."""
    text = fold(name)
    if not text:
        return []
    head, dash, tail = text.rpartition(" - ")
    if dash and locality and (tail == locality or one_edit(tail, locality)):
        text = head
    text = re.sub(r"#\s*\d+\b", " ", text)
    text = re.sub(r"['’]s\b", "", text).replace("'", "").replace("’", "")
    words = [_FULL.get(w, w) for w in re.findall(r"[^\W_]+", text)]
    telling = [w for w in words if w not in _SILENT]
    return telling or words


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_words(names: pd.Series, localities: pd.Series) -> pd.Series:
    return pd.Series([name_words(n, loc) for n, loc in zip(names, localities, strict=True)], dtype=object)


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 4 and one_edit(a, b):
        return 0.9
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.8
    return 0.0


def name_similarity(a: list[str], b: list[str], generic: frozenset[str] | set[str]) -> float:
    """Mean of both sides' weighted shares of words that have a partner in the other name, each partner used once; -1 if a
    side has no words."""
    if not a or not b:
        return -1.0

    def weight(w: str) -> float:
        return WEIGHT_GENERIC if w in generic else WEIGHT_OWN

    pairs = sorted(((s, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := _alike(x, y)) > 0), key=lambda p: (-p[0], p[1], p[2]))
    used_a, used_b = {}, {}
    for s, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a[i], used_b[j] = s, s
    share_a = sum(weight(a[i]) * s for i, s in used_a.items()) / sum(map(weight, a))
    share_b = sum(weight(b[j]) * s for j, s in used_b.items()) / sum(map(weight, b))
    return (share_a + share_b) / 2


def _similarity(a: Column, b: Column, generic: list[str]) -> Column:
    known = frozenset(generic)

    @F.pandas_udf(T.DoubleType())
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([name_similarity(list(x), list(y), known) for x, y in zip(left, right, strict=True)], dtype="float64")

    return similarity(a, b)


def _mentions(linked: DataFrame) -> DataFrame:
    """gers_id and each distinct writing of the place's name, address and position: its own and the linked record's."""
    rows = linked.where(F.col("gers_id").isNotNull() & (F.trim("gers_id") != ""))
    common = ["gers_id", "city", "postcode", "longitude", "latitude"]
    target = rows.select(*common, F.col("overture_name").alias("name"), F.col("overture_address").alias("address"))
    own = rows.select(*common, "name", "address")
    return target.unionByName(own).distinct()


def records_of(users: DataFrame, linked: DataFrame) -> DataFrame:
    """One row per record of users and per mention of a place: key, gers_id (null for records), name, address, city, postcode
    and a usable position or nulls. Rows of one record_id are folded to the least filled value per column."""
    ok = F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90) & ~((F.col("longitude") == 0) & (F.col("latitude") == 0))
    place = F.when(ok, F.struct("longitude", "latitude"))
    filled = [F.min(F.when(F.trim(c) != "", F.col(c))).alias(c) for c in ("name", "address", "city", "postcode")]
    u = users.where(F.col("record_id").isNotNull()).groupBy("record_id").agg(*filled, F.min(place).alias("_p"))
    u = u.select(F.concat(F.lit("u:"), "record_id").alias("key"), F.col("record_id").alias("who"), F.lit(False).alias("is_place"), "name", "address", "city", "postcode", "_p.longitude", "_p.latitude")
    m = _mentions(linked).withColumn("_p", place)
    blank = [F.when(F.trim(c) != "", F.col(c)).alias(c) for c in ("name", "address", "city", "postcode")]
    m = m.select("gers_id", *blank, "_p.longitude", "_p.latitude").distinct()
    m = m.select(F.concat_ws("\u0001", F.lit("p:"), "gers_id", F.xxhash64("name", "address", "city", "postcode", "longitude", "latitude").cast("string")).alias("key"), F.col("gers_id").alias("who"), F.lit(True).alias("is_place"), "name", "address", "city", "postcode", "longitude", "latitude")
    return u.unionByName(m)


def _cell(row: Column, lon: Column) -> tuple[Column, Column]:
    """(column number of lon, width in degrees) in a row of cells: as wide as high at the row's end that is nearer to a pole."""
    height = 2 * NEAR / 110540.0
    edge = F.least(F.greatest(F.abs(row), F.abs(row + 1)) * height, F.lit(89.9))
    width = F.lit(2 * NEAR / 111320.0) / F.cos(F.radians(edge))
    return F.floor(lon / width), width


def _cells(lon: Column, lat: Column, around: bool) -> Column:
    """Numbers of the cell of a position, or of the at most four cells within NEAR around it; null without a position."""
    height = 2 * NEAR / 110540.0

    def of(at: Column, side: int) -> Column:
        row = F.floor(at / height)
        _, width = _cell(row, lon)
        return F.xxhash64(row, F.floor((lon + side * width / 2) / width))

    cells = [of(lat + dy * height / 2, dx) for dy in (-1, 1) for dx in (-1, 1)] if around else [of(lat, 0)]
    return F.when(lon.isNotNull() & lat.isNotNull(), F.array_distinct(F.array(*cells)))


def _ends(words: Column) -> Column:
    """Beginnings and endings of two letters of every word (of four-letter words the outer letters too): words one edit apart
    share one of these, and so do words of which one begins the other."""
    each = lambda w: F.concat(
        F.array(F.concat(F.lit("a"), F.substr(w, F.lit(1), F.lit(2))), F.concat(F.lit("z"), F.right(w, F.lit(2)))),
        F.when(F.length(w) == 4, F.array(F.concat(F.lit("m"), F.left(w, F.lit(1)), F.right(w, F.lit(1))))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.flatten(F.transform(words, each)))


def _near_words(words: Column) -> Column:
    """The words and what is left of those of four and more letters without one of them."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= 4, _deletions(w)).otherwise(F.array(w)))))


def _no_keys() -> Column:
    return F.array().cast("array<bigint>")


def _positions(around: bool) -> Column:
    return F.coalesce(_cells(F.col("longitude"), F.col("latitude"), around), _no_keys())


def _blocks(side: DataFrame, is_place: bool) -> DataFrame:
    """(id, lane, key): the blocks of a record. Keys are numbers; equal numbers of unlike things only make a candidate that
    the evidence rejects.

    site: the resolved address. grid: a cell and an end of a name's word, for records within NEAR. town: locality and a
    near spelling of an own word of the name (of any word if all are generic), if one of both records has no address.
    """
    site = F.when(F.col("site").isNotNull(), F.array(F.xxhash64(F.lit("site"), "site"))).otherwise(_no_keys())
    # a name with own words is like another only through one of these, unless three generic words outweigh the other's
    telling = F.col("words") if is_place else F.when(F.size("words") - F.size("telling") >= 3, F.col("words")).otherwise(F.col("telling"))
    grid = F.flatten(F.transform(_positions(not is_place), lambda c: F.transform(_ends(telling), lambda e: F.xxhash64(F.lit("grid"), c, e))))
    placed = F.col("locality").isNotNull() & ~F.col("locality").startswith("?")
    lost = F.col("site").isNull()

    def town(of: str, when: Column) -> Column:
        return F.when(placed & when, F.transform(_near_words(F.col("telling")), lambda w: F.xxhash64(F.lit(of), F.col("locality"), w))).otherwise(_no_keys())

    towns = F.concat(town("lost record", F.lit(True)), town("lost place", lost)) if is_place else F.concat(town("lost record", lost), town("lost place", ~lost))
    lanes = F.array(*[F.struct(F.lit(name).alias("lane"), F.array_distinct(keys).alias("keys")) for name, keys in (("site", site), ("grid", grid), ("town", towns))])
    return side.select("id", F.explode(lanes).alias("l")).select("id", "l.lane", F.explode("l.keys").alias("key"))


def _parts(side: DataFrame, hot: DataFrame, is_place: bool) -> DataFrame:
    """(id, key): the records of hot blocks (key, nu, np) in rows and columns of parts of about HOT pairs: a record is in one row
    and all columns, a place in all rows and one column, so every pair of the block meets in just one part."""
    width = max(1.0, HOT**0.5)
    rows, columns = F.ceil(F.col("nu") / width), F.ceil(F.col("np") / width)
    own, other = (columns, rows) if is_place else (rows, columns)
    mine, others = F.pmod(F.xxhash64("id"), own), F.explode(F.sequence(F.lit(0).cast("bigint"), other - 1)).alias("o")
    parted = side.join(grows(hot), "key").select("id", "key", mine.alias("m"), others)
    return parted.select("id", F.xxhash64("key", *(("o", "m") if is_place else ("m", "o"))).alias("key"))


def candidate_pairs(records: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(pairs, members, generic): pairs of a class of like records and a mention of a place with the evidence of both; the
    records of each class; the generic words.

    Records with the same words, position and address are one class, so copies make no further pairs. A pair is a candidate if
    it shares a block (_blocks): the address, or the surroundings and a word of the name, or the town and an own word where
    one has no address. By the weights of the evidence no other pair could be accepted: without a common address a link
    needs a name of 0.7 within NEAR, or one of 0.9 and no address and no position on one side. Blocks of more than HOT pairs
    are divided among tasks (_parts); all their pairs are made, so the candidates don't depend on the size of a block.
    """
    records = cut(records)
    at = resolve(records.select(F.col("key").alias("record_id"), "address", "city", "postcode", "longitude", "latitude")).withColumnRenamed("record_id", "key")
    base = records.join(grows(at), "key").withColumn("words", _name_words("name", "locality"))
    addressed = F.col("street").isNotNull() & (F.col("number") != "") & ~F.col("locality").startswith("?")
    road = F.when(addressed, F.concat_ws("|", "locality", "street", "unit"))
    base = base.select("who", "is_place", "words", "longitude", "latitude", "locality", road.alias("road"), F.when(addressed, F.col("number")).alias("number"), F.when(addressed, F.concat_ws("|", "locality", "street", "unit", "number")).alias("site"))
    base = cut(base.withColumn("id", F.xxhash64(F.when(F.col("is_place"), F.col("who")), "words", "longitude", "latitude", "locality", "site")))
    names = base.where(F.size("words") > 0).select(F.array_distinct("words").alias("w")).distinct()
    total = names.count()
    counted = names.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    generic = sorted(r.word for r in counted.where(F.col("n") >= max(3.0, GENERIC_SHARE * total)).collect())
    flat = F.array(*[F.lit(w) for w in generic]) if generic else F.array().cast("array<string>")
    own = F.array_except("words", flat)
    base = base.withColumn("telling", F.when(F.size(own) > 0, own).otherwise(F.col("words")))
    members = base.where(~F.col("is_place")).select("id", F.col("who").alias("record_id"))
    users = base.where(~F.col("is_place")).drop("who").dropDuplicates(["id"])
    places = base.where("is_place").dropDuplicates(["id"])

    u, p = cut(_blocks(users, False)), cut(_blocks(places, True))
    shared = u.groupBy("key").agg(F.count("*").alias("nu")).join(grows(p.groupBy("key").agg(F.count("*").alias("np"))), "key")
    shared = cut(shared)
    calm, hot = shared.where(F.col("nu") * F.col("np") <= HOT).select("key"), shared.where(F.col("nu") * F.col("np") > HOT)
    keys = u.join(grows(calm), "key").select("key", F.col("id").alias("u_id")).join(grows(p.select("key", F.col("id").alias("p_id"))), "key").select("u_id", "p_id")
    if not hot.isEmpty():
        du, dp = _parts(u, hot, False).withColumnRenamed("id", "u_id"), _parts(p, hot, True).withColumnRenamed("id", "p_id")
        keys = keys.unionByName(du.join(grows(dp), "key").select("u_id", "p_id"))
    keys = keys.distinct()
    told = ("words", "longitude", "latitude", "road", "number")
    pairs = keys.join(grows(users.select(F.col("id").alias("u_id"), *[F.col(c).alias("u_" + c) for c in told])), "u_id")
    pairs = pairs.join(grows(places.select(F.col("id").alias("p_id"), *[F.col(c).alias("p_" + c) for c in ("who", *told)])), "p_id")
    return pairs, members, generic


def _address_evidence() -> Column:
    """Same address, a slip in its house number (one digit more, less or other, or two changed places), or another."""
    a, b = F.col("u_number"), F.col("p_number")
    edits = F.levenshtein(a, b)
    letters = lambda n: F.array_sort(F.split(n, ""))
    slip = (F.greatest(F.length(a), F.length(b)) > 1) & ((edits == 1) | ((edits == 2) & (letters(a) == letters(b))))
    same_road = F.col("u_road") == F.col("p_road")
    return F.when(F.col("u_road").isNull() | F.col("p_road").isNull(), 0.0).when(same_road & (a == b), ADDRESS_SAME).when(same_road & slip, ADDRESS_SLIP).otherwise(ADDRESS_OTHER)


def evidence(pairs: DataFrame, members: DataFrame, generic: list[str]) -> DataFrame:
    """(record_id, gers_id, logit): the sum of the log likelihood ratios; of several mentions the best of each attribute. Pairs
    below LEAST_LOGIT are no links."""
    d = distance_m(F.col("u_longitude"), F.col("u_latitude"), F.col("p_longitude"), F.col("p_latitude"))
    scored = pairs.select("u_id", F.col("p_who").alias("gers_id"), _similarity(F.col("u_words"), F.col("p_words"), generic).alias("s"), d.alias("d"), _address_evidence().alias("a"), F.col("p_road").isNotNull().alias("told"))
    best = scored.groupBy("u_id", "gers_id").agg(F.max("s").alias("s"), F.min("d").alias("d"), F.max(F.when(F.col("told"), F.col("a"))).alias("told_a"), F.max("a").alias("a"))
    name = F.lit(0.0)
    for at, value in reversed(NAME_STEPS):
        name = F.when(F.col("s") >= at, value).otherwise(name)
    far = F.lit(0.0)
    for at, value in reversed(DISTANCE_STEPS):
        far = F.when(F.col("d") <= at, value).otherwise(far)
    told = best.select("u_id", "gers_id", (F.lit(PRIOR) + name + F.coalesce(far, F.lit(0.0)) + F.coalesce("told_a", "a")).alias("logit"), "s", "d").where(F.col("logit") >= LEAST_LOGIT)
    return told.join(grows(members.withColumnRenamed("id", "u_id")), "u_id").select("record_id", "gers_id", "logit", "s", "d")


def _exchange(state: DataFrame, damping: float, sides: tuple[str, str]) -> DataFrame:
    """One round of messages; change is how far each link's messages are from what the round makes of them. sides: u and g in
    the order in which they are summed; rounds that begin with the side that the last one ended with need one shuffle less."""
    to_u = F.exp(F.least(F.col("logit") + F.col("from_g"), F.lit(50.0)))
    to_g = F.exp(F.least(F.col("logit") + F.col("from_u"), F.lit(50.0)))
    sums = {"u": F.sum(to_u).over(Window.partitionBy("u")), "g": F.sum(to_g).over(Window.partitionBy("g"))}
    both = state
    for side in sides:
        both = both.withColumn("s" + side, sums[side])
    rest_u = F.greatest(F.col("su") - to_u, F.lit(0.0))
    rest_g = F.greatest(F.col("sg") - to_g, F.lit(0.0))
    new_u = -F.log1p(rest_u)
    new_g = F.log1p(SECOND_RECORD * rest_g) - F.log1p(rest_g)
    damped = lambda new, old: (1 - damping) * new + damping * F.col(old)
    change = F.greatest(F.abs(new_u - F.col("from_u")), F.abs(new_g - F.col("from_g")))
    return both.select("u", "g", "logit", damped(new_u, "from_u").alias("from_u"), damped(new_g, "from_g").alias("from_g"), change.alias("change"))


def propagate(edges: DataFrame) -> DataFrame:
    """(record_id, gers_id, confidence): marginals of the candidate links under the one-to-one factors.

    Of the links of a record at most one holds; a further record of one place is SECOND_RECORD as likely. Messages are
    exchanged by sums per record and per place in windows, whose rows spill, two rounds per written table, until no message
    changes by more than TOLERANCE. Damping grows after every PATIENCE rounds, so that messages that swing come to
    rest; if they still do after twenty times PATIENCE, an error says so, as no belief could be given. Links without a rival
    on either side are settled at once and take no part. A null logit isn't a link. Records and places are 64-bit numbers
    while messages are exchanged.
    """
    numbered = edges.where(F.col("logit").isNotNull()).select("record_id", "gers_id", "logit", F.xxhash64("record_id").alias("u"), F.xxhash64("gers_id").alias("g"))
    counted = cut(numbered.withColumn("nu", F.count("*").over(Window.partitionBy("u"))).withColumn("ng", F.count("*").over(Window.partitionBy("g"))))
    calm = counted.where("nu = 1 and ng = 1").select("record_id", "gers_id", (1 / (1 + F.exp(-F.col("logit")))).alias("confidence"))
    rivals = counted.where("nu > 1 or ng > 1")
    state = rivals.select("u", "g", "logit", F.lit(0.0).alias("from_u"), F.lit(0.0).alias("from_g"))
    done, change, damping = 0, float("inf"), DAMPING
    while change > TOLERANCE:
        if done >= 20 * PATIENCE:
            raise RuntimeError(f"belief propagation hasn't converged after {done} rounds; the last change is {change}")
        seen = Observation()
        moved = _exchange(_exchange(state, damping, ("u", "g")).drop("change"), damping, ("g", "u"))
        state = cut(moved.observe(seen, F.max("change").alias("change")).drop("change"))
        change, done = seen.get["change"] or 0.0, done + 2  # null without rivals
        if done % PATIENCE == 0:
            damping = (1 + damping) / 2
    logging.getLogger(__name__).info("belief propagation: %s rounds, last change %s", done, change)
    belief = state.select("u", "g", (1 / (1 + F.exp(-(F.col("logit") + F.col("from_u") + F.col("from_g"))))).alias("confidence"))
    return calm.unionByName(rivals.select("record_id", "gers_id", "u", "g").join(grows(belief), ["u", "g"]).select("record_id", "gers_id", "confidence"))


def match_entities(users: DataFrame, linked: DataFrame) -> DataFrame:
    """(record_id, gers_id, confidence): every candidate link of a record with its marginal probability.

    Nulls and blanks in any attribute tell nothing; rows with a null record_id or gers_id take no part; empty tables give no
    rows; repeated rows change nothing; further columns are ignored.
    """
    return propagate(evidence(*candidate_pairs(records_of(users, linked))))


def best_links(links: DataFrame, least: float = 0.5) -> DataFrame:
    """(record_id, gers_id, confidence): the likeliest link of each record if its confidence reaches least."""
    best = links.groupBy("record_id").agg(F.max(F.struct("confidence", "gers_id")).alias("b"))
    return best.select("record_id", "b.gers_id", "b.confidence").where(F.col("confidence") >= least)
