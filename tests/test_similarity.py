import random

import duckdb
import pandas as pd
import pytest

from geoweft.functions.similarity import jaro_winkler, jaro_winkler_pairs

VECTORS = [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("dwayne", "duane", 0.84), ("crate", "trace", 0.733333), ("main st", "main street", 0.927273), ("1939 e olive ave", "1939 olive ave", 0.917857), ("abc", "xyz", 0.0), ("", "", 0.0), ("a", "", 0.0), ("a", "a", 1.0)]


@pytest.mark.parametrize(("a", "b", "want"), VECTORS)
def test_vectors(a, b, want):
    assert abs(jaro_winkler_pairs(pd.Series([a]), pd.Series([b]))[0] - want) < 1e-6


def test_against_duckdb():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde 12") for _ in range(rng.randint(1, 30)))
    pairs = pd.DataFrame([(word(), word()) for _ in range(4000)], columns=["a", "b"])
    want = duckdb.connect().execute("SELECT jaro_winkler_similarity(a, b) FROM pairs").fetchall()
    assert max(abs(g - w[0]) for g, w in zip(jaro_winkler_pairs(pairs.a, pairs.b), want, strict=True)) < 1e-12


def test_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in df.select(jaro_winkler(df.a, df.b)).collect()] == [None, None, 1.0]
    assert df.where("false").select(jaro_winkler(df.a, df.b)).count() == 0
