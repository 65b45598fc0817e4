import random

import pytest

from geoweft.llm import mixing

DOCS = "doc_id long, text string, source string, uses int, tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        source = rng.choices(["big", "mid", "small", "other", None], [700, 300, 60, 30, 20])[0]
        text = "copy of one text" if source == "big" and rng.random() < 0.5 else " ".join(rng.choice(["map", "tile", "road", "river"]) for _ in range(rng.choice([0, 5, 40, 200])))
        rows.append((i, text, source, 1, "x"))
    rows += [(5000, None, "big", 1, "x"), (5001, "", "mid", 1, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_report(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 2), ("small", 0.2, 3), ("absent", 0.1, 2)], TARGETS)
    mixed, report = mixing.mix(docs, targets)
    rows, by = mixed.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and not {5000, 5001} & {r.doc_id for r in rows}
    caps = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= r.uses <= caps[r.source] for r in rows)
    for s, share in (("big", 0.4), ("mid", 0.4), ("small", 0.2)):
        assert abs(by[s].reached_share - share) < 0.02 and by[s].status == "mixed" and by[s].most_uses <= caps[s]
        assert by[s].mixed_tokens == sum(r.tokens * r.uses for r in rows if r.source == s)
        assert abs(by[s].mixed_tokens - by[s].planned) <= max(r.tokens for r in rows if r.source == s)
    assert by["absent"].status == "no documents" and by["other"].status == "no target" and None in by
    again = sorted(map(tuple, mixing.mix(docs.repartition(7), targets)[0].collect()))
    assert again == sorted(map(tuple, rows))


def test_exhausted_source_and_given_total(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], TARGETS)
    docs = corpus(spark)
    mixed, report = mixing.mix(docs, targets, total_tokens=60_000)
    by = {r.source: r for r in report.collect()}
    assert by["small"].status == "exhausted" and by["small"].mixed_tokens == 2 * by["small"].available and by["small"].reached_share < 0.5


def test_empty(spark):
    docs, targets = corpus(spark), spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mixing.mix(docs.where("false"), targets)[0].count() == 0
    mixed, report = mixing.mix(docs, targets.where("false"))
    assert mixed.count() == 0 and report.count() == 5 and report.where("reached_share is not null").count() == 0


@pytest.mark.parametrize(("groups", "wanted"), [([(1, 100)], 30), ([(1, 100), (4, 400)], 150), ([(1, 10), (2, 20), (5, 1000)], 500), ([(1, 10)], 10), ([(1, 10)], 0), ([], 5)])
def test_inclusion_factor(groups, wanted):
    f = mixing.inclusion_factor(groups, wanted)
    total = sum(t for _, t in groups)
    assert abs(sum(t * min(1, f / c) for c, t in groups) - min(wanted, total)) < 1e-6
