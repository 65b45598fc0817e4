import random

import pytest

from geoweft.llm.address_parts import parse, postcode5
from geoweft.llm.addresses import address_records, location_members, one_edit, resolve, same_location, spelling_variants

USERS = "record_id string, address string, city string, postcode string, longitude double, latitude double, street string, locality int"
LINKED = "record_id string, overture_address string, city string, postcode string, longitude double, latitude double, number string"


@pytest.mark.parametrize(("text", "want"), [
    ("5485 No. Ossar Bend Pkwy Unit 3", ("5485", "n", "ossar bend", "parkway", "3")), ("Unit 3, 5485 N Ossar Bend PKY", ("5485", "n", "ossar bend", "parkway", "3")), ("No. 12 Oak St", ("12", "", "oak", "street", "")), ("So. Sandrivo AVE 5004, Suite 204", ("5004", "s", "sandrivo", "avenue", "204")),
    ("4399 1/2 E. Fifth St., Apt. 310", ("4399 1/2", "e", "5th", "street", "310")), ("5170 east lindquor dr., a", ("5170", "e", "lindquor", "drive", "a")), ("c/o Front Desk, NO. 2916 WOLGAST BLVD", ("2916", "", "wolgast", "boulevard", "")), ("Town Center, # 204, 56 1/2 WEST 7TH STR", ("56 1/2", "w", "7th", "street", "204")),
    ("UNIT A - 88 1/2 QUENBY HILL BOULEVARD", ("88 1/2", "", "quenby hill", "boulevard", "a")), ("474 W. Cobaltin Bend", ("474", "w", "cobaltin bend", "", "")), ("6442 Maple Bend B", ("6442", "", "maple bend", "", "b")), ("1 Main St, Springfield, QA 00942", ("1", "", "main", "street", "")),
])
def test_parse(text, want):
    p = parse(text)[0]
    assert (p.number, p.direction, " ".join(p.words), p.type_, p.unit) == want


def test_parse_nothing():
    assert parse(None) == [] and parse("  ") == [] and parse(",;") == [] and parse("x" * 20_000)


@pytest.mark.parametrize(("raw", "want"), [("00942", "00942"), ("OO942", "00942"), ("942", "00942"), ("942.0", "00942"), ("QA 00942", "00942"), ("00942-1234", "00942"), (None, ""), ("", ""), ("abc", ""), ("1234567", "")])
def test_postcode(raw, want):
    assert postcode5(raw) == want


def test_one_edit():
    assert all(one_edit(a, b) and one_edit(b, a) for a, b in (("ossar", "osar"), ("ossar", "osasr"), ("abc", "abd"), ("a", "")))
    assert not any(one_edit(a, b) for a, b in (("a", "a"), ("abc", "cba"), ("abcd", "ab"), ("ossar", "osra")))


def test_spelling_variants_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))): rng.randint(1, 40) for _ in range(250)}
    got = {(r.word, r.better) for r in spelling_variants(spark.createDataFrame(list(words.items()), "word string, n int")).collect()}
    want = {(a, b) for a, na in words.items() for b, nb in words.items() if len(a) >= 4 and len(b) >= 4 and nb >= 3 * na and one_edit(a, b)}
    assert got == want


def world(spark):
    """A small town with two streets of one name, a one-street name and damaged writings."""
    base = [("12 N Maple Rd", "12 North Maple Road"), ("14 Maple Rd", None), ("20 W Juniper Hill Ct", "20 West Juniper Hill Court"), ("31 Birch Ln", None), ("32 Birch Ln", None), ("33 W Juniper Hill Ct", None), ("34 S Maple Rd", None), ("35 S Maple Rd", None), ("36 Birch Lane", None), ("37 W. Juniper Hill Ct", None)]
    users = [(f"u{i}", a, "Springfield", "00942", 10.0, 50.0, "x", 1) for i, (a, _) in enumerate(base)]
    users += [("m1", "12 No. Mapel Rd", None, "942.0", 10.0, 50.0, "x", 1), ("m2", "20 Juniper Hill, Springfield, QA", "Sprigfield", None, 10.0, 50.0, "x", 1), ("m3", "BIRCH LA 31", None, None, 10.0, 50.0, "x", 1), ("m4", "12 Maple Rd, Apt 3", "Springfield", "00942", None, None, "x", 1), ("m5", "12 N Maple Road #3", "Springfield", "00942", None, None, "x", 1)]
    users += [(None, "12 N Maple Rd", "Springfield", "00942", 10.0, 50.0, "x", 1), ("b1", None, "Springfield", None, None, None, "x", 1), ("b2", "  ", "Springfield", None, None, None, "x", 1), ("u0", "12 N Maple Rd", None, None, 10.0, 50.0, "x", 1), ("long", "x" * 5000, "Springfield", "00942", None, None, "x", 1)]
    linked = [("o1", "12 NORTH MAPLE ROAD", "SPRINGFIELD", "00942-1111", 10.0, 50.0, "x"), ("o1", "12 NORTH MAPLE ROAD", "SPRINGFIELD", "00942-1111", 10.0, 50.0, "x"), ("o2", None, "Springfield", "00942", 10.0, 50.0, "x"), ("o3", "12 N Maple Rd", "Oldtown", "00100", 20.0, 50.0, "x"), ("o4", "13 N Maple Rd", "Oldtown", "00100", 20.0, 50.0, "x")]
    return spark.createDataFrame(users, USERS), spark.createDataFrame(linked, LINKED)


def test_same_location(spark):
    pairs = sorted(map(tuple, same_location(*world(spark)).collect()))
    assert ("m1", "u0") in pairs and ("m1", "o1") in pairs and ("o1", "u0") in pairs and ("m2", "u2") in pairs and ("m3", "u3") in pairs
    assert not any("o3" in p or "b1" in p or "b2" in p or "o2" in p for p in pairs) and len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    assert not any({"m5", "u0"} == set(p) for p in pairs)


def frames(spark, rows):
    """Records of both tables from (id, address, town), every second one as a linked record."""
    users = [(i, a, t, None, None, None, "x", 1) for i, a, t in rows[::2]]
    linked = [(i, a, t, None, None, None, "x") for i, a, t in rows[1::2]]
    return spark.createDataFrame(users, USERS), spark.createDataFrame(linked, LINKED)


def test_streets_of_one_town_stay_apart(spark):
    """A street whose name is one letter from a usual one of another town, or from a larger street of its own town, is a street."""
    rows = [(f"h{i}", f"{i + 1} Harlow St", "Townsville") for i in range(40)] + [("a", "12 Marlow St", "Springfield"), ("b", "12 Harlow St", "Springfield")]
    rows += [(f"n{i}", f"{i + 1} Martin Ave", "Oldtown") for i in range(40)] + [(f"l{i}", f"{i + 1} Marlin Ave", "Oldtown") for i in range(8)]
    pairs = set(map(tuple, same_location(*frames(spark, rows)).collect()))
    assert ("a", "b") not in pairs and not any(x[0] != y[0] for x, y in pairs)


def test_records_without_a_town_are_no_pairs(spark):
    users, linked = frames(spark, [(f"x{i}", "12 Main St", None) for i in range(6)])
    assert same_location(users, linked).count() == 0


def test_members_and_planted_recall(spark):
    """Slips, abbreviations, orders and missing parts of planted addresses; recall and precision of the pairs, and the members."""
    rng = random.Random(8)
    names = ["Alderton", "Brackley", "Cornwall", "Dunmore", "Eastgate", "Foxhollow", "Greenway", "Harvest", "Ironbridge", "Juniper", "Kingsley", "Lakeshore", "Marigold", "Northfield", "Orchard"]
    types = ["St Street Str", "Ave Avenue Av", "Rd Road", "Ln Lane", "Blvd Boulevard"]
    rows, truth = [], {}
    for town in ("Westbury", "Calverton", "Stonehaven"):
        for k, name in enumerate(names):
            for number in rng.sample(range(1, 900), 24):
                for copy in range(2):
                    word = name
                    if rng.random() < 0.06:
                        at = rng.randrange(1, len(name) - 1)
                        word = name[:at] + name[at + 1 :]
                    street = f"{word} {rng.choice(types[k % 5].split())}"
                    text = rng.choice([f"{number} {street}", f"{number} {street}", f"{street} {number}", f"{number} {word}", f"{number} {street}".upper()])
                    rid = f"r{len(rows):05d}"
                    rows.append((rid, text, town))
                    truth.setdefault((town, name, number), []).append(rid)
    rng.shuffle(rows)
    users, linked = frames(spark, rows)
    want = {tuple(sorted(ids)) for ids in truth.values()}
    got = set(map(tuple, same_location(users, linked).collect()))
    assert len(want & got) >= 0.99 * len(want) and len(want & got) >= 0.99 * len(got)
    members = location_members(users, linked).collect()
    assert len(members) == len(rows) and sum(m.links for m in members) == 2 * len(got)
    of = {m.record_id: m.location_id for m in members}
    assert all(of[a] == of[b] <= a for a, b in got)


def test_resolve_covers_all_records_and_empty(spark):
    users, linked = world(spark)
    records = address_records(users, linked)
    resolved = resolve(records)
    assert resolved.count() == records.count() == 19
    assert same_location(users.where("false"), linked.where("false")).count() == 0
