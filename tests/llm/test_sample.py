from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.sample import bounds, fixed_size_sample

ROWS = "a string, b string, mode string"


def test_size_ties_nulls_and_repeats(spark):
    rows = [(f"k{i % 50}", "r", "x") for i in range(400)] + [(None, "r", "x"), (None, "r", "y"), ("", "r", "x")]
    df = spark.createDataFrame(rows, ROWS)
    for k, n in ((0, 0), (1, 1), (10, 10), (52, 52), (500, 52)):
        got = fixed_size_sample(df, ["a", "b"], k).collect()
        assert len(got) == n == len(set(got))
    assert fixed_size_sample(df.limit(0), ["a", "b"], 5).collect() == []


def test_same_whatever_the_pieces(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("a"), F.lit("r").alias("b"), F.lit("m").alias("mode"))
    whole = set(fixed_size_sample(df, ["a", "b"], 100, seed=3).collect())
    pieces = [df.where("id % 7 = 0"), df.where("id % 7 > 0"), df.where("id < 1000")]
    assert set(fixed_size_sample(pieces, ["a", "b"], 100, seed=3).collect()) == whole
    assert set(fixed_size_sample(df, ["a", "b"], 100, seed=4).collect()) != whole


def test_bounds_hold_and_are_retried(spark):
    low, high = bounds(10**6, 10**4, 1e-6)
    assert 0 < low < 0.01 < high < 1 and (high - low) * 10**6 < 3000
    df = spark.range(500).select(F.col("id").cast("string").alias("a"))
    # bounds that nearly always fail at first give the same sample
    assert set(fixed_size_sample(df, ["a"], 20, fail=0.999999).collect()) == set(fixed_size_sample(df, ["a"], 20).collect())


def test_bounds_may_fail_again_and_again(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("a"))
    tried = []

    def too_narrow(n, k, fail):
        tried.append(fail)
        return bounds(n, k, fail) if fail < 1e-100 else (0.0, 0.001)

    assert set(fixed_size_sample(df, ["a"], 20, find_bounds=too_narrow).collect()) == set(fixed_size_sample(df, ["a"], 20).collect())
    assert len(tried) == 4 and bounds(500, 20, 0.0) == (0.0, 1.0)


def test_equally_likely(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("a"))
    hits = Counter(r.a for seed in range(40) for r in fixed_size_sample(df, ["a"], 20, seed=seed).collect())
    expected = 40 * 20 / 60
    assert sum((hits[str(i)] - expected) ** 2 / (expected * 2 / 3) for i in range(60)) < 110  # chi-square, 59 degrees
