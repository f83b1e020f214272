import json
import random

from tessera.operators.nesting import cells, column_types, flat_rows, nested_objects, parse, parse_exact, subtype_catalog, subtype_table
from tessera.operators.paths import name_step

RECORDS = "artifact_id string, root_path string, idx int, record string, node_path string"


def brute(text):
    out = []

    def walk(v, path, parent, inside, layers):
        while isinstance(v, str) and layers:
            ok, held = parse(v)
            if not ok:
                break
            v, layers = held, layers - 1
        if isinstance(v, dict):
            if inside:
                out.append((path, parent))
                parent = path
            for k, x in v.items():
                walk(x, path + name_step(k), parent, False, layers)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", parent, True, layers)

    ok, value = parse(text)
    if ok:
        walk(value, "$", "$", False, 3)
    return set(out)


def flat(spark, rows):
    return nested_objects(spark.createDataFrame(rows, RECORDS))


def tables(spark, rows):
    return flat_rows(spark.createDataFrame(rows, RECORDS))


def test_against_brute_force(spark):
    rng = random.Random(7)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([1, 2.5, None, True, "x", "", "[", "{bad"])
        if kind < 0.6:
            return {rng.choice(["a", "b c", "d'e", "f"]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        if kind < 0.9:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return json.dumps(value(depth - 1))

    rows = [(f"a{i % 7}", "$", i, json.dumps(value(6)), "clash") for i in range(300)]
    got = {}
    for r in flat(spark, rows).collect():
        got.setdefault(r.idx, set()).add((r.node_path, r.parent_path))
    for r in rows:
        assert got.get(r[2], set()) == brute(r[3]), r[3]


def test_edges(spark):
    rows = [
        ("a", "$", 0, None, ""),
        ("a", "$", 1, '{"x": [{"y": 1}', ""),
        ("a", "$", 2, '{"x": NaN}', ""),
        ("a", "$", 3, '[{"y": [{}]}]', ""),
        ("a", "$", 3, '[{"y": [{}]}]', ""),  # repeated
        ("a", "$", 3, '[{}, {}]', ""),  # the same key again, with one object more
        (None, None, None, '{"l": [{}]}', ""),
        ("a", "$", 4, json.dumps(json.dumps(json.dumps([{"z": 1}]))), ""),
        ("a", "$", 5, json.dumps(json.dumps(json.dumps(json.dumps(json.dumps([{"z": 1}]))))), ""),  # one layer too many
        ("a", "$", 6, '{"\\ud800": [{"k": "\\ud800"}]}', ""),
        ("a", "$", 7, "[" * 100_000, ""),
        ("a", "$", 8, json.dumps({"big": ["x" * 200_000, {"n": 1}]}), ""),
    ]
    got = sorted((r.idx if r.idx is not None else -1, r.node_path, r.parent_path) for r in flat(spark, rows).collect())
    assert got == [(-1, "$.l[0]", "$"), (3, "$[0]", "$"), (3, "$[0].y[0]", "$[0]"), (3, "$[1]", "$"), (4, "$[0]", "$"), (6, "$['?'][0]", "$"), (8, "$.big[1]", "$")]
    assert flat(spark, []).collect() == []


def test_variants_and_typed_tables(spark):
    rows = [("a", "$", i, json.dumps({"lines": [{"sku": "s", "qty": i}, {"qty": i, "sku": "t"}, {"sku": "u"}]}), "") for i in range(3)]
    objects = tables(spark, rows)
    catalog = subtype_catalog(objects).collect()
    assert {(r.place, r.scalar_fields, r.n) for r in catalog} == {("$.lines[*]", "qty,sku", 6), ("$.lines[*]", "sku", 3), ("$", "", 3)}
    typed = subtype_table(objects, "$.lines[*]", {"sku": "string", "qty": "int"})
    assert {(r.node_path, r.sku, r.qty) for r in typed.where("idx = 2").collect()} == {("$.lines[0]", "s", 2), ("$.lines[1]", "t", 2), ("$.lines[2]", "u", None)}


MIXED = [
    ("a", "$", 0, '{"id":7,"n":5,"big":12345678901234567890,"huge":1' + "0" * 40 + ',"f":1.50,"g":2,"ok":true,"no":null,"user":{"login":"x","geo":{"a b":-1}},"tags":[1,"2",[3,[]],{}],"e":[],"o":{},"s":"{\\"in\\":[{\\"z\\":1e2}]}"}', ""),
    ("a", "$", 1, '{"id":8,"n":-6,"big":1,"huge":2,"f":3,"g":"2","ok":false}', ""),
    ("a", "$", 2, "[[1],{}]", ""),
    ("a", "$", 3, "12", ""),
]


def test_tables_hold_every_value(spark):
    got = {(r.idx, r.node_path, r.parent_path, r.place, r.field): (r.kind, r.value) for r in cells(tables(spark, MIXED)).collect()}
    own = {k[4]: v for k, v in got.items() if k[:2] == (0, "$")}
    assert own == {
        "id": ("integer", "7"), "n": ("integer", "5"), "big": ("integer", "12345678901234567890"), "huge": ("integer", "1" + "0" * 40), "f": ("number", "1.50"), "g": ("integer", "2"), "ok": ("boolean", "true"),
        "no": ("null", None), "user.login": ("string", "x"), "user.geo['a b']": ("integer", "-1"), "e": ("array", "[]"), "o": ("object", "{}"),
    }
    rest = {k: v for k, v in got.items() if k[0] in (0, 2, 3) and k[1] != "$"}
    assert rest == {
        (0, "$.tags[0]", "$", "$.tags[*]", "value"): ("integer", "1"),
        (0, "$.tags[1]", "$", "$.tags[*]", "value"): ("string", "2"),
        (0, "$.tags[2][0]", "$", "$.tags[*][*]", "value"): ("integer", "3"),
        (0, "$.tags[2][1]", "$", "$.tags[*][*]", "value"): ("array", "[]"),
        (0, "$.s.in[0]", "$", "$.s.in[*]", "z"): ("number", "1e2"),
        (2, "$[0][0]", "$", "$[*][*]", "value"): ("integer", "1"),
    }
    assert got[3, "$", None, "$", "value"] == ("integer", "12")
    bare = {(r.idx, r.node_path) for r in tables(spark, MIXED).collect() if not r.fields}
    assert bare == {(0, "$.tags[3]"), (2, "$[1]")}


def test_columns_take_the_narrowest_type_that_holds_all(spark):
    rows = tables(spark, MIXED)
    types = {r.field: r.type for r in column_types(rows, by=("place",)).where("place = '$'").collect()}
    assert {f: types[f] for f in ("id", "n", "big", "huge", "f", "g", "ok", "no", "user.login")} == {"id": "bigint", "n": "bigint", "big": "decimal(38,0)", "huge": "string", "f": "double", "g": "string", "ok": "boolean", "no": "string", "user.login": "string"}
    typed = {r.idx: r for r in subtype_table(rows, "$").collect()}
    assert (typed[0].n, int(typed[0].big), typed[0].huge, typed[0].f, typed[0].ok, typed[0]["user.login"]) == (5, 12345678901234567890, "1" + "0" * 40, 1.5, True, "x")
    assert (typed[1].n, int(typed[1].big), typed[1].ok, typed[1].g) == (-6, 1, False, "2")
    variant = rows.where("idx = 1").first().variant
    assert [r.idx for r in subtype_table(rows, "$", variant=variant).collect()] == [1]


def test_tables_agree_with_a_rebuilt_record(spark):
    """Every leaf of a random record is found at its path, with its text as written."""
    rng = random.Random(11)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.35:
            return rng.choice([1, -2.50, None, False, "x", "", "{bad", 10**25])
        return {rng.choice(["a", "b c", "f"]): value(depth - 1) for _ in range(rng.randint(0, 3))} if kind < 0.7 else [value(depth - 1) for _ in range(rng.randint(0, 3))]

    def leaves(v, path):
        if isinstance(v, dict) and v:
            return {x for k, w in v.items() for x in leaves(w, path + name_step(k))}
        if isinstance(v, list) and v:
            return {x for i, w in enumerate(v) for x in leaves(w, f"{path}[{i}]")}
        return {(path, str(v) if not isinstance(v, (bool, dict, list)) and v is not None else json.dumps(v))}

    rows = [("a", "$", i, json.dumps(value(5)), "") for i in range(200)]
    out = {}
    flat_ones = tables(spark, rows).collect()
    around = {(r.idx, r.parent_path) for r in flat_ones}
    for r in flat_ones:
        own = out.setdefault(r.idx, set())
        if not r.fields and (r.idx, r.node_path) not in around:
            own.add((r.node_path, "{}"))
        for f, c in (r.fields or {}).items():
            path = r.node_path if f == "value" else r.node_path + (f if f[0] == "[" else "." + f)
            own.add((path, c.value if c.value is not None else "null"))
    for r in rows:
        assert out.get(r[2], set()) == leaves(parse_exact(r[3])[1], "$"), r[3]


def test_problem_3_over_its_other_tables(spark, tmp_path):
    import __spark_entry__ as entry

    inner = '{"content":[{"type":"json","value":{"rows":[{"n":1},{"n":2}]}}]}'
    spark.createDataFrame([("h1", inner), ("h1", inner), ("h2", None), ("h3", "{bad")], "payload_hash_full string, envelope string").write.parquet(f"{tmp_path}/payload_blobs.parquet")
    spark.createDataFrame([("a", "$", 0, '{"l":[{"n":1,"m":[{"k":"s"}]}]}')], "artifact_id string, root_path string, idx int, record string").write.parquet(f"{tmp_path}/artifact_records.parquet")
    paths = ["$.a", "$['a']", "$.l", "$.l[*]", "$.l[*].m", "$.l[*].m[*]", "$['l'][*].m[*].k.z", None]
    spark.createDataFrame([("a", "$", p) for p in paths], "artifact_id string, root_key string, field_path string").write.parquet(f"{tmp_path}/artifact_schema_fields.parquet")
    got = lambda name, *c: sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(*c).collect())
    at = "$.content[0].value.rows"
    assert got("p3_envelopes", "payload_hash_full", "node_path", "parent_path", "place") == [("h1", "$", None, "$"), ("h1", "$.content[0]", "$", "$.content[*]"), ("h1", f"{at}[0]", "$.content[0]", "$.content[*].value.rows[*]"), ("h1", f"{at}[1]", "$.content[0]", "$.content[*].value.rows[*]")]
    objects = {r.node_path: (r.parent_path, r.place, {f: (c.kind, c.value) for f, c in r.fields.items()}) for r in entry.queries()["p3_objects"](spark, str(tmp_path)).collect()}
    assert objects == {"$": (None, "$", {}), "$.l[0]": ("$", "$.l[*]", {"n": ("integer", "1")}), "$.l[0].m[0]": ("$.l[0]", "$.l[*].m[*]", {"k": ("string", "s")})}
    assert got("p3_field_paths", "node_path", "parent_path", "field") == [
        ("$.a", "$", ".a"),
        ("$.l", "$", ".l"),
        ("$.l[*]", "$", ".l[*]"),
        ("$.l[*].m", "$.l[*]", ".m"),
        ("$.l[*].m[*]", "$.l[*]", ".m[*]"),
        ("$.l[*].m[*].k.z", "$.l[*].m[*]", ".k.z"),
    ]
