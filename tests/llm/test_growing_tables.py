import pytest

from geoweft import session
from geoweft.llm import addresses, entity_match

USERS = "record_id string, name string, address string, city string, postcode string, longitude double, latitude double"
LINKED = USERS + ", gers_id string, overture_name string, overture_address string"


def tables(spark):
    """Ten places with a record each, two of them at one address under unlike names."""
    stems = ["Mosken", "Harsten", "Pattaro", "Wicklow", "Dravina", "Zelmira", "Quorlan", "Bexley", "Tamrick"]
    rows = [(f"{s} Grill", f"{10 + i} N Maple Rd", "Springfield", "00942", 10 + i * 0.01, 50.0) for i, s in enumerate(stems)]
    rows.append(("Other Bakery", *rows[0][1:]))
    users = [(f"u{i}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(users, USERS), spark.createDataFrame([(f"o{i}", *r, f"g{i}", r[0], r[1]) for i, r in enumerate(rows)], LINKED)


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written on the way."""
    seen = []

    def cut(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return session.cut(df)

    for module in (addresses, entity_match):
        monkeypatch.setattr(module, "cut", cut)
    return seen


def joined_without_broadcasts(plans, result):
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    return any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_no_side_of_a_p4_join_comes_to_the_driver(spark, plans):
    assert joined_without_broadcasts(plans, addresses.same_location(*tables(spark)))
    assert joined_without_broadcasts(plans, addresses.location_members(*tables(spark)))


def test_no_side_of_a_p2_join_comes_to_the_driver(spark, plans):
    assert joined_without_broadcasts(plans, entity_match.match_entities(*tables(spark)))


def test_links_do_not_depend_on_the_size_of_blocks(spark, monkeypatch):
    def links():
        return {(r.record_id, r.gers_id): r.confidence for r in entity_match.match_entities(*tables(spark)).collect()}

    whole = links()
    assert {("u0", "g9"), ("u9", "g0")} <= whole.keys()  # one address, unlike names
    monkeypatch.setattr(entity_match, "HOT", 1)
    assert links() == pytest.approx(whole, abs=1e-9)
