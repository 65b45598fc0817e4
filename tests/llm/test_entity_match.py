import itertools
import math
import random

import pytest

from geoweft.llm import entity_match as em

USERS = "record_id string, name string, address string, city string, postcode string, longitude double, latitude double, gers_id string, s int"
LINKED = "record_id string, name string, address string, city string, postcode string, longitude double, latitude double, gers_id string, overture_name string, overture_address string, key int"


@pytest.mark.parametrize(("name", "want"), [("The Mosken Dental Ctr, Inc #12", ["mosken", "dental", "center"]), ("CAFÉ BRÉVAN - SPRINGFIELD", ["cafe", "brevan"]), ("Bahmer’s Pharm.", ["bahmer", "pharmacy"]), ("Griӏӏ & Sons", ["grill"]), ("The", ["the"]), (None, []), ("", [])])
def test_name_words(name, want):
    assert em.name_words(name, "springfield") == want


def test_name_similarity():
    g = {"grill", "florist"}
    assert em.name_similarity(["mosken", "grill"], ["grill", "mosken"], g) == 1
    assert em.name_similarity(["mosken", "grill"], ["moskne", "grill"], g) > 0.9
    assert em.name_similarity(["mosken", "grill"], ["harsten", "grill"], g) < 0.3
    assert em.name_similarity([], ["a"], g) == -1


def exact(edges):
    """Marginals of the factor graph by going through all sets of links."""
    total, marginal = 0.0, dict.fromkeys([(u, g) for u, g, _ in edges], 0.0)
    for chosen in itertools.product([0, 1], repeat=len(edges)):
        on = [e for e, c in zip(edges, chosen, strict=True) if c]
        if len({u for u, _, _ in on}) < len(on):
            continue
        extra = len(on) - len({g for _, g, _ in on})
        weight = math.exp(sum(x for _, _, x in on)) * em.SECOND_RECORD**extra
        total += weight
        for u, g, _ in on:
            marginal[u, g] += weight
    return {k: v / total for k, v in marginal.items()}


def test_beliefs_are_near_the_exact_marginals(spark):
    rng = random.Random(3)
    edges = [("u1", "g1", 3.0), ("u1", "g2", 2.0), ("u2", "g2", 1.0), ("u2", "g3", -1.0), ("u3", "g4", 2.0), ("u4", "g5", -3.0), ("u4", "g6", rng.uniform(-1, 1))]
    df = spark.createDataFrame([*edges, ("u9", "g9", None)], "record_id string, gers_id string, logit double")
    got = {(r.record_id, r.gers_id): r.confidence for r in em.propagate(df).collect()}
    want = exact(edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.08 for k in want)
    assert em.propagate(df.where("false")).count() == 0


def test_matches(spark):
    trades = ["Grill", "Bakery", "Florist", "Laundry"]
    stems = ["Mosken", "Harsten", "Pattaro", "Wicklow", "Dravina", "Zelmira", "Quorlan", "Bexley", "Tamrick", "Ulverd"]
    linked, users = [], []
    for i, s in enumerate(stems):
        name, address = f"{s} {trades[i % 4]}", f"{10 + i} N Maple Rd"
        linked.append((f"o{i}", name.upper(), address, "Springfield", "00942", 10 + i * 0.01, 50.0, f"g{i}", name, address, 1))
        users.append((f"u{i}", name, address.replace(" Rd", " Road"), "Springfield", "00942", 10 + i * 0.01 + 0.0002, 50.0, "no", 1))
    linked += [("o20", "Chain Burger", "90 Oak Ave", "Springfield", "00942", 10.5, 50.0, "gc1", "Chain Burger", "90 Oak Ave", 1), ("o21", "Chain Burger", "95 Oak Ave", "Springfield", "00942", 10.6, 50.0, "gc2", "Chain Burger", "95 Oak Ave", 1), ("o22", "x", "1 Elm", "Springfield", "00942", 10.6, 50.0, None, "x", "1 Elm", 1), linked[0]]
    users += [
        ("tenant", "Other Laundry", "10 N Maple Rd", "Springfield", "00942", 10.0, 50.0, "no", 1), ("branch", "Chain Burger", "95 Oak Ave", "Springfield", "00942", 10.6, 50.0, "no", 1), ("elsewhere", "Chain Burger", "97 Oak Ave", "Springfield", "00942", 10.7, 50.0, "no", 1),
        ("noname", None, "11 N Maple Rd", "Springfield", "00942", 10.01, 50.0, "no", 1), ("noaddress", "Wicklow Laundry", None, "Springfield", None, 10.03, 50.0, "no", 1), ("nothing", None, None, None, None, None, None, "no", 1), (None, "Mosken Grill", "10 N Maple Rd", "Springfield", "00942", 10.0, 50.0, "no", 1), users[0],
    ]
    u, o = spark.createDataFrame(users, USERS), spark.createDataFrame(linked, LINKED)
    links = em.match_entities(u, o)
    best = {r.record_id: r.gers_id for r in em.best_links(links).collect()}
    assert all(best[f"u{i}"] == f"g{i}" for i in range(10)) and best["branch"] == "gc2" and best["noname"] == "g1" and best["noaddress"] == "g3"
    assert not {"tenant", "elsewhere", "nothing"} & best.keys()
    assert links.where("confidence < 0 or confidence > 1").count() == 0
    assert em.match_entities(u.where("false"), o).count() == 0 and em.match_entities(u, o.where("false")).count() == 0


def test_both_writings_of_a_linked_row_are_evidence(spark):
    row = ("o1", "Mosken Grill", "12 Birch Ln", "Springfield", "00942", 10.0, 50.0, "g1", "Harsten Kitchen", "700 Oak Ave", 1)
    users = [("own", "Mosken Grill", "12 Birch Lane", "Springfield", "00942", 10.0, 50.0, "no", 1), ("theirs", "Harsten Kitchen", "700 Oak Ave", "Springfield", "00942", 10.0, 50.0, "no", 1)]
    links = em.match_entities(spark.createDataFrame(users, USERS), spark.createDataFrame([row], LINKED))
    assert {(r.record_id, r.gers_id) for r in links.collect()} == {("own", "g1"), ("theirs", "g1")}


def scene(spark, n=400, seed=6):
    """Places in three towns and noisy records of them: slips, short forms, missing names, addresses and positions; with truth."""
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice("bdfglmnrstvz") + rng.choice("aeiou") for _ in range(3))
    linked, users, truth = [], [], {}
    for i in range(n):
        stem, trade = part().capitalize(), rng.choice(["Dental Clinic", "Grill", "Pharmacy", "Auto Repair", "Florist"])
        town = ("Westbury", "Calverton", "Stonehaven")[i % 3]
        street = f"{rng.choice(['Alder', 'Birch', 'Cedar', 'Dogwood', 'Elm'])} {rng.choice(['St', 'Ave', 'Rd'])}"
        number, lon, lat = 10 + 7 * i, 10 + (i % 3) + rng.random() * 0.08, 45 + rng.random() * 0.08
        name, address = f"{stem} {trade}", f"{number} {street}"
        linked.append((f"o{i}", name.upper() + " INC", address, town, None, lon, lat, f"g{i}", name, address, 1))
        for c in range(rng.choice([0, 1, 1, 2])):
            kind = rng.randrange(6)
            x, y = lon + rng.uniform(-4e-4, 4e-4), lat + rng.uniform(-4e-4, 4e-4)
            noisy = [
                (name, address, x, y), (stem[:2] + stem[3:] + " " + trade, address, x, y), (name, None, x, y), (None, address, x, y), (name, address, None, None),
                (name, address[1] + address[0] + address[2:], lon, lat),
            ][kind]
            rid = f"u{i}-{c}"
            users.append((rid, noisy[0], noisy[1], town, None, noisy[2], noisy[3], "no", 1))
            truth[rid] = f"g{i}"
    return spark.createDataFrame(users, USERS), spark.createDataFrame(linked, LINKED), truth


def test_planted_recall_and_divided_blocks(spark, monkeypatch):
    users, linked, truth = scene(spark)
    found = {r.record_id: r.gers_id for r in em.best_links(em.match_entities(users, linked)).collect()}
    right = sum(found.get(u) == g for u, g in truth.items())
    assert right >= 0.99 * len(truth) and right >= 0.99 * len(found)
    monkeypatch.setattr(em, "HOT", 0)  # every block is divided
    again = {r.record_id: r.gers_id for r in em.best_links(em.match_entities(users, linked)).collect()}
    assert again == found


def test_a_slip_in_the_house_number_and_generic_names(spark):
    linked = [("o1", "Mosken Grill", "124 N Maple Rd", "Springfield", "00942", 10.0, 50.0, "g1", "Mosken Grill", "124 N Maple Rd", 1), ("o2", "Sao Tibur Prickley", "5 Oak Ave", "Springfield", "00942", 10.1, 50.0, "g2", "Sao Tibur Prickley", "5 Oak Ave", 1), ("o3", "Other Bakery", "5 Oak Ave", "Springfield", "00942", 10.1, 50.0, "g3", "Other Bakery", "5 Oak Ave", 1)]
    users = [("slip", "Mosken Grill", "142 N Maple Rd", "Springfield", "00942", 10.0, 50.0, "no", 1), ("part", "Sao Tibur", "5 Oak Ave", "Springfield", "00942", 10.1, 50.0, "no", 1), ("next", "Mosken Grill", "180 N Maple Rd", "Springfield", "00942", 10.02, 50.0, "no", 1)]
    u, o = spark.createDataFrame(users, USERS), spark.createDataFrame(linked, LINKED)
    links = em.match_entities(u, o)
    assert {(r.record_id, r.gers_id) for r in em.best_links(links).collect()} == {("slip", "g1"), ("part", "g2")}
    assert links.where("record_id = 'part'").count() == 2  # all places of a site are candidates


def test_grid_blocks_hold_all_pairs_within_reach(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(i, lon + rng.uniform(-0.003, 0.003), lat + rng.uniform(-0.003, 0.003)) for i, (lon, lat) in enumerate([(10, 50), (-179.9, -80), (0, 0), (120, 89.5)] * 40)]
    a = spark.createDataFrame(rows, "id int, x double, y double")
    from geoweft.operators.spatial_join import distance_m

    b = a.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = a.join(b, distance_m(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) <= em.NEAR).select("id", "o")
    cells = a.select("id", F.explode(em._cells(F.col("x"), F.col("y"), True)).alias("c")).join(b.select("o", F.explode(em._cells(F.col("ox"), F.col("oy"), False)).alias("c")), "c")
    assert near.subtract(cells.select("id", "o")).count() == 0 and near.count() > 160
