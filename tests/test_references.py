from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators.references import Reference, Target, composed, dangling_by_period, dangling_references, normal_hash

D = datetime
PARENT = "id string, since timestamp_ntz, removed timestamp_ntz, gen int"
CHILD = "key string, ref string, seen timestamp_ntz, parent string"


def run(spark, children, parents, **kw):
    c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    target = Target("parents", p, normal_hash("id"), since="since", removed_at="removed", valid_by=("gen", "since"))
    ref = Reference("children", c, ("key",), normal_hash("ref"), "parents", seen="seen", check_removed=True, **kw)
    return dangling_references([ref], [target])


def test_reasons_nulls_repeats_and_spellings(spark):
    parents = [("a", D(2025, 1, 10), None, 1), ("b", D(2025, 1, 1), D(2025, 2, 1), 2), ("b", D(2025, 1, 1), None, 1), ("c", D(2025, 1, 1), None, 1), (None, D(2025, 1, 1), None, 1)]
    children = [
        ("1", " SHA256:A ", D(2025, 1, 5), "x"),  # late, in another spelling
        ("1", "a", D(2025, 3, 5), "x"),  # the same key again, later
        ("2", "a", D(2025, 1, 11), "x"),
        ("3", "b", D(2025, 1, 15), "x"),
        ("4", "b", D(2025, 2, 1), "x"),  # deleted at that time
        ("5", "nowhere", D(2025, 4, 1), "x"),
        ("6", None, D(2025, 4, 1), "x"),
        (None, "nowhere", D(2025, 4, 2), "x"),
        ("7", "c", None, "x"),
    ]
    found = run(spark, children, parents)
    rows = {(r.row_key, r.reason, r.period) for r in found.collect()}
    assert rows == {("1", "late", "2025-01"), ("4", "deleted", "2025-02"), ("5", "missing", "2025-04"), ("", "missing", "2025-04")}
    assert {(r.reason, r.period, r.n) for r in dangling_by_period(found).collect()} == {("late", "2025-01", 1), ("deleted", "2025-02", 1), ("missing", "2025-04", 2)}


def test_empty_tables(spark):
    assert run(spark, [], []).collect() == []
    assert run(spark, [], [("a", D(2025, 1, 1), None, 1)]).collect() == []
    assert [r.reason for r in run(spark, [("1", "a", D(2025, 1, 1), "x")], []).collect()] == ["missing"]


def test_hot_key_and_changing_target(spark):
    children = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.lit("hot").alias("ref"), F.lit("2025-01-01").cast("timestamp_ntz").alias("seen"), F.lit("").alias("parent"))
    target = Target("parents", spark.createDataFrame([("a", D(2025, 1, 1), None, 1)], PARENT), F.col("id"), since="since")
    found = dangling_references([Reference("children", children, ("key",), F.col("ref"), "parents", seen="seen")], [target])
    assert found.count() == 5000
    # a row key whose target changes is judged by its first delivery
    rows = [("1", "a", D(2025, 2, 1), "x"), ("1", "gone", D(2025, 3, 1), "x"), ("2", "gone", D(2025, 2, 1), "x"), ("2", "a", D(2025, 3, 1), "x")]
    found = run(spark, rows, [("a", D(2025, 1, 1), None, 1)], key_fixes_target=False)
    assert [(r.row_key, r.reason) for r in found.collect()] == [("2", "missing")]


def test_composed_key_is_null_if_a_part_is(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    assert [r[0] is None for r in df.select(composed("x", "y")).collect()] == [True, False]
