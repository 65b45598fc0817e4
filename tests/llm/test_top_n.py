import datetime
import random

from pyspark.sql import functions as F

from geoweft.llm.top_n import best_candidates, rank_order, top_n_by_bands

SCHEMA = "record_id string, overture_id string, gers_match_score double, distance_m double, overture_name string, scored_at timestamp, candidate_rank long, rank int"
T0 = datetime.datetime(2026, 1, 1)


def brute(rows, n=3):
    last = {}
    for r in rows:
        if r[0] is None:
            continue
        score = r[2] if r[2] is not None and r[2] == r[2] else None
        key = (r[5] or datetime.datetime.min, score if score is not None else float("-inf"), -(r[3] if r[3] is not None else float("inf")))
        if (r[0], r[1]) not in last or key > last[r[0], r[1]][0]:
            last[r[0], r[1]] = (key, score, r)
    groups = {}
    for (g, o), (_, score, r) in last.items():
        if score is not None:
            groups.setdefault(g, []).append((-score, r[3] is None, r[3] or 0, r[4] is None, (r[4] or "").encode(), o is None, (o or "").encode(), o))
    return sorted((g, i + 1, c[-1] or "") for g, cs in groups.items() for i, c in enumerate(sorted(cs)[:n]))


def test_random_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        hot = rng.random() < 0.35  # one record holds a third of all rows
        rows.append(("hot" if hot else f"r{rng.randint(0, 90)}", f"o{rng.randint(0, 60)}" if rng.random() > 0.02 else None, rng.choice([None, float("nan"), 50.0, 60.0, 60.0, rng.uniform(0, 100)]), rng.choice([None, 1.0, 2.0]), rng.choice([None, "ä", "z", "Z", "😀"]), T0 + datetime.timedelta(seconds=i) if rng.random() > 0.05 else None, rng.randint(1, 9), i))
    rows += rows[:50] + [(None, "o", 99.0, 1.0, "n", T0, 1, 0)]
    got = best_candidates(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.record_id, r.candidate_rank, r.overture_id or "") for r in got.collect()) == brute(rows)


def test_empty_ties_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert best_candidates(empty).count() == 0
    same = spark.createDataFrame([("a", f"o{i}", 50.0, 1.0, "n", T0, 9, 9) for i in range(6)], SCHEMA)
    assert [r.overture_id for r in best_candidates(same).orderBy("candidate_rank").collect()] == ["o0", "o1", "o2"]
    items = same.drop("rank").withColumn("record_id", F.lit(None).cast("string"))
    assert top_n_by_bands(items, "record_id", "gers_match_score", rank_order(), 2).count() == 2
