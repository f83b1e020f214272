import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import jsonpath
from tessera.functions.jsonpath import PathError
from tessera.functions.variants import parse, parse_or_text, text_as_json, type_name
from tessera.operators.filters import FilterError, check, compile_filter, filter_hash
from tessera.operators.select import Order, Select, count, select

BOATS = [
    {"id": 11, "name": "Petrel", "length": 12.5, "afloat": True, "rig": ["sloop", "genoa"]},
    {"id": 12, "name": "osprey", "length": 9, "afloat": False, "rig": ["ketch"]},
    {"id": 13, "name": "Tern%", "length": 17, "afloat": True, "rig": ["genoa", "cutter", None]},
    {"id": 14, "name": None, "length": "long", "afloat": None, "rig": "sloop"},
]


def frame(spark, values):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pos int, j string").select("pos", F.parse_json("j").alias("v"))


def ids(spark, values, raw, key="id"):
    return sorted(r[0] for r in frame(spark, values).where(compile_filter(raw, F.col("v"))).select(F.try_variant_get("v", f"$.{key}", "int")).collect())


def p(path, op, value=None):
    return {"path": path, "op": op, "value": value}


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        (p("$.name", "eq", "osprey"), [12]),
        (p("$.name", "ne", "osprey"), [11, 13]),
        (p("$.length", "gt", 9), [11, 13, 14]),  # text sorts above numbers
        (p("$.length", "gte", 12.5), [11, 13, 14]),
        (p("$.length", "lt", 12.5), [12]),
        (p("$.length", "lte", 12.5), [11, 12]),
        (p("$.length", "in", [17, 9, "x"]), [12, 13]),
        (p("$.length", "in", []), []),
        (p("$.length", "in", [None]), []),
        (p("$.name", "contains", "PRE"), [12]),
        (p("$.name", "contains", "%"), [13]),
        (p("$.rig", "array_contains", "genoa"), [11, 13]),
        (p("$.rig", "array_contains", "sloop"), [11]),
        (p("$.afloat", "eq", True), [11, 13]),
        (p("$.name", "eq", None), [14]),
        (p("$.keel", "exists"), []),
        (p("$.name", "exists"), [11, 12, 13, 14]),
        (p("$.keel", "not_exists"), [11, 12, 13, 14]),
        ({"logic": "and", "filters": [p("$.afloat", "eq", True), p("$.length", "gt", 15)]}, [13]),
        ({"logic": "or", "filters": [p("$.id", "eq", 11), {"not": p("$.afloat", "eq", True)}]}, [11, 12]),
        ({"logic": "and", "filters": []}, [11, 12, 13, 14]),
        ({"logic": "or", "filters": []}, []),
        ({"not": p("$.keel", "eq", 1)}, []),  # unknown stays unknown
    ],
)
def test_predicates(spark, raw, expected):
    assert ids(spark, BOATS, raw) == expected


def test_storage_classes(spark):
    values = [{"id": i, "x": x} for i, x in enumerate([5, "5", 5.0, True, None, [1], {"a": 1}, 2**60, 2**60 + 1, 0.5])] + [{"id": 10}]
    assert ids(spark, values, p("$.x", "eq", 5)) == [0, 2]
    assert ids(spark, values, p("$.x", "eq", "5")) == [1]
    assert ids(spark, values, p("$.x", "gt", 99999)) == [1, 5, 6, 7, 8]
    assert ids(spark, values, p("$.x", "eq", 1)) == [3]
    assert ids(spark, values, p("$.x", "eq", '{"a":1}')) == [6]
    assert ids(spark, values, p("$.x", "eq", 2**60)) == [7]
    assert ids(spark, values, p("$.x", "eq", None)) == [4, 10]
    assert ids(spark, values, p("$.x", "ne", None)) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert ids(spark, values, p("$.x", "exists")) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_array_contains_needs_an_array(spark):
    values = [{"id": i, "t": t} for i, t in enumerate([["cutter", "jib"], "cutter", 42, ["yawl", None], [True]])]
    assert ids(spark, values, p("$.t", "array_contains", "cutter")) == [0]
    assert ids(spark, values, p("$.t", "array_contains", 1)) == [4]
    assert ids(spark, values, p("$.t", "array_contains", None)) == [3]
    assert ids(spark, values, {"not": p("$.t", "array_contains", "cutter")}) == [1, 2, 3, 4]


def test_filter_errors_and_hash():
    for bad in ("x", {"path": "$.a", "op": "like", "value": 1}, p("a", "eq", 1), p("$.a[*]", "eq", 1), p("$.a", "gt", None), p("$.a", "in", "x"), p("$.a", "eq", [1]), p("$.a", "contains", 1), {"logic": "xor", "filters": []}):
        with pytest.raises(FilterError):
            check(bad)
    deep = p("$.a", "eq", 1)
    for _ in range(30):
        deep = {"not": deep}
    with pytest.raises(FilterError):
        check(deep)
    a, b = p("$.a", "eq", 1), p("$['b']", "gt", 2)
    assert filter_hash({"logic": "and", "filters": [a, b]}) == filter_hash({"filters": [p("$.b", "gt", 2), a], "logic": "AND"})
    assert filter_hash(a) != filter_hash(b)


def test_jsonpath_parser():
    assert jsonpath.parse("$.a['b c'][0][*]") == ["a", "b c", 0, None]
    assert jsonpath.canonical("$['a']['it\\'s'][*]") == "$.a['it\\'s'][*]"
    assert jsonpath.select_paths(["b", "$.a", "['b']", "[0]"]) == ["$.a", "$.b", "$[0]"]
    for bad in ("a", "$..a", "$.a[-1]", "$[?(@.a)]", "$['a", "$['a\\x']", "$.a[01]", "$.", "$" + ".a" * 65, "$." + "a" * 5000):
        with pytest.raises(PathError):
            jsonpath.parse(bad)
    with pytest.raises(PathError):
        jsonpath.reject_wildcards("$.a[*]")


def test_evaluate(spark):
    df = frame(spark, [{"a": [{"b": 1}, {"c": 2}, {"b": 3}]}, {"a": {"y": {"b": 5}, "x": {"b": 4}}}, {"a": 7}, {}])
    got = [(r.pos, list(r.match_pos), r.m) for r in jsonpath.evaluate(df, "v", "$.a[*].b").select("pos", "match_pos", F.col("match").cast("int").alias("m")).collect()]
    assert sorted(got) == [(0, [0], 1), (0, [2], 3), (1, [0], 4), (1, [1], 5)]
    assert [r.pos for r in jsonpath.evaluate(df, "v", "$").collect()] == [0, 1, 2, 3]
    # a field may have any name
    odd = frame(spark, [{"a": {"end": 5, "x": 6}, "end": {"end": [{"end": 7}, {"end": None}]}}])
    at = lambda path: [json.loads(r.m) for r in jsonpath.evaluate(odd, "v", path).select(F.to_json("match").alias("m")).collect()]
    assert at("$.a.end") == [5] and at("$.end.end[*].end") == [7, None] and at("$.end.end[1]") == [{"end": None}] and at("$.a[*]") == [5, 6]
    with pytest.raises(Exception, match="more than 2"):
        jsonpath.evaluate(df, "v", "$.a[*]", max_matches=2).collect()


def test_select(spark):
    df = frame(spark, [{"s": "b", "n": 2}, {"s": "a", "n": "10"}, {"s": "a", "n": None}, {"n": 1}])
    run = lambda **kw: [(r.pos, json.loads(r.item)) for r in select(df, Select(**kw), ["pos"]).collect()]
    assert run(paths=["s"], order_by="s", limit=9) == [(1, {"$.s": "a"}), (2, {"$.s": "a"}), (0, {"$.s": "b"}), (3, {})]
    assert [x[0] for x in run(paths=["n"], order_by="to_number(n) DESC", limit=9)] == [1, 0, 3, 2]
    assert run(paths=["s", "n"], missing_as_null=True, limit=1, offset=3) == [(3, {"$.s": None, "$.n": 1})]
    assert sorted(run(paths=["s"], distinct=True)) == [(0, {"$.s": "b"}), (1, {"$.s": "a"}), (3, {})]
    assert [x[0] for x in run(paths=["s"], limit=4, max_bytes=20)] == [0]
    assert [x[0] for x in run(paths=["s"], limit=4, max_bytes=1)] == [0]
    assert count(df, Select(paths=["s"], distinct=True)).first().n == 3
    assert count(df, Select(where=p("$.s", "eq", "a"))).first().n == 2
    assert select(df.limit(0), Select(paths=["s"]), ["pos"]).collect() == []
    with pytest.raises(ValueError):
        Order.parse("to_date(x)")


def test_parsing_text(spark):
    texts = [None, "", " ", "1", '"x"', "{} tail", "[1] 2", "1] x", "1} x", '{"a":1}', '"{\\"a\\":1}"', "[1,2]", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", type_name(parse(F.col("t"))).alias("p"), type_name(parse_or_text(F.col("t"))).alias("q"), type_name(text_as_json(F.col("t"))).alias("j")).collect()
    got = {r.t: (r.p, r.q, r.j) for r in rows}
    assert got[None] == (None, None, None) and got["1"] == ("number", "number", None) and got['"x"'] == ("string", "string", None)
    for t in ("", " ", "{} tail", "[1] 2", "1] x", "1} x", "plain"):
        assert got[t] == (None, "string", None), t
    assert got['{"a":1}'][2] == "object" and got['"{\\"a\\":1}"'] == ("string", "string", "object") and got["[1,2]"][2] == "array"


def test_evaluate_against_a_walk(spark):
    """Random trees and paths against a plain walk over them."""
    import random

    rng = random.Random(21)
    names = ["a", "end", "b c", "None", "0"]

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.25:
            return rng.choice([1, "x", None, True, []])
        if kind < 0.7:
            return {n: tree(depth - 1) for n in rng.sample(names, rng.randint(0, 3))}
        return [tree(depth - 1) for _ in range(rng.randint(0, 3))]

    def walk(value, steps):
        if not steps:
            return [value]
        step, rest = steps[0], steps[1:]
        if step is None:
            inner = value if isinstance(value, list) else [value[k] for k in sorted(value)] if isinstance(value, dict) else []
        elif isinstance(step, int):
            inner = [value[step]] if isinstance(value, list) and step < len(value) else []
        else:
            inner = [value[step]] if isinstance(value, dict) and step in value else []
        return [x for v in inner for x in walk(v, rest)]

    trees = [tree(4) for _ in range(60)]
    df = frame(spark, trees)
    for _ in range(8):
        steps = [rng.choice([None, 0, 1, *names]) for _ in range(rng.randint(1, 3))]
        got = {}
        for r in jsonpath.evaluate(df, "v", jsonpath.canonical(steps)).select("pos", "match_pos", F.to_json("match").alias("m")).collect():
            got.setdefault(r.pos, []).append((list(r.match_pos), json.loads(r.m)))
        for i, t in enumerate(trees):
            assert [m for _, m in sorted(got.get(i, []), key=lambda x: x[0])] == walk(t, steps), (steps, t)
