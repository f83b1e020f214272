import itertools
import random
from datetime import datetime

from tessera.operators.drift import Profile, compare, matches, max_weight_matching, schema_changes, type_set
from tessera.operators.paths import normal_steps, show
from tessera.operators.series import with_previous

D = datetime
ARTIFACTS = "artifact_id string, upstream_instance_id string, source_tool string, created_seq long, generation int, ingested_at timestamp_ntz, types string"
ROOTS = "artifact_id string, root_key string, mode string, completeness string"
FIELDS = "artifact_id string, root_key string, field_path string, types string, example_value string, distinct_values string"


def profile(**types):
    return Profile([{"field_path": p, "types": t, "example_value": None, "distinct_values": None} for p, t in types.get("d", types).items()])


def brute(old, new):
    """The rules as they are written, by repeated passes."""
    gone, come = {k for k in old if k not in new}, {k for k in new if k not in old}
    pairs = {}
    for a, b in itertools.product(gone, come):
        cell = lambda s, t, of: [x for x in s if x[:-1] == a[:-1] and of[x] == t]
        if a and b and a[:-1] == b[:-1] and old[a] == new[b] and len(cell(gone, old[a], old)) == 1 == len(cell(come, old[a], new)):
            pairs[a] = b
    while True:
        more = {a: b for a, b in itertools.product(gone, come) if a not in pairs and a and b and old[a] == new[b] and pairs.get(a[:-1]) == b[:-1] and a[-1] == b[-1]}
        if not more:
            break
        pairs |= more
    out = {("renamed", show(b), show(a)) for a, b in pairs.items()}
    out |= {("removed", show(a), "") for a in gone if a not in pairs} | {("added", show(b), "") for b in come if b not in pairs.values()}
    return out | {("retyped", show(k), "") for k in old if k in new and old[k] != new[k]}


def test_types_and_paths():
    assert type_set('["NULL","String","string"]') == {"string"} == type_set('"string"') == type_set("string")
    assert type_set(None) == type_set('["null"]') == frozenset()
    assert normal_steps("$.a['b'][\"c d\"][*]") == normal_steps("$['a'].b['c d'][*]")
    assert show(normal_steps("$['a']['c d'][*].e")) == "$.a['c d'][*].e"
    assert show(normal_steps("$['it\\'s']")) == "$['it\\'s']"


def test_matching_is_best():
    rng = random.Random(3)
    for _ in range(120):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        w = {(i, j): rng.random() + 0.01 for i in range(n) for j in range(m) if rng.random() < 0.6}
        got = max_weight_matching(w)
        assert len(set(got.values())) == len(got) and all(e in w for e in got.items())
        options = itertools.product(*[[None, *[j for j in range(m) if (i, j) in w]] for i in range(n)])
        best = max(sum(w[i, j] for i, j in enumerate(f) if j is not None) for f in options if len({j for j in f if j is not None}) == sum(j is not None for j in f))
        assert abs(sum(w[e] for e in got.items()) - best) < 1e-9


def test_likeness_decides_where_several_pairs_are_possible():
    column = lambda p, example: {"field_path": p, "types": '["string"]', "example_value": example, "distinct_values": None}
    old = Profile([column("$.customer_name", "Ada"), column("$.ship_code", "K9-1")])
    new = Profile([column("$.shipping_code", "B2-7"), column("$.customer_full_name", "Eve")])
    found = {x[:3] for x in compare(old, new)}
    assert {("likely", "$.customer_full_name", "$.customer_name"), ("likely", "$.shipping_code", "$.ship_code")} == {x for x in found if x[0] == "likely"}
    assert len([x for x in found if x[0] in ("removed", "added")]) == 4
    # nothing alike: no pair; the only possible pair needs no likeness
    far = Profile([column("$.qq", "1"), column("$.zz", "[]")])
    assert not [x for x in compare(old, far) if x[0] in ("likely", "renamed")]
    assert ("renamed", "$.qq", "$.customer_name") in {x[:3] for x in compare(Profile([column("$.customer_name", "Ada")]), Profile([column("$.qq", "1")]))}


def test_many_vanished_names_are_matched_by_component():
    column = lambda p: {"field_path": p, "types": '["number"]', "example_value": "1", "distinct_values": None}
    rng = random.Random(8)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(300)]
    old, new = Profile([column(f"$.{n}") for n in names]), Profile([column(f"$.{n}_v") for n in names])
    assert {a: b for a, (b, _, _) in matches(old, new).items()} == {normal_steps(f"$.{n}"): normal_steps(f"$.{n}_v") for n in names}


def test_rules_against_brute_force():
    rng = random.Random(11)
    names, types = ["a", "b", "c", "d"], ['["string"]', '["number"]', '["object"]']
    for _ in range(400):
        def tree(names=names):
            out = {}
            for n in names:
                if rng.random() < 0.6:
                    t = rng.choice(types)
                    out[f"$.{n}"] = t
                    if "object" in t:
                        out |= {f"$.{n}.{k}": rng.choice(types) for k in "xy" if rng.random() < 0.7}
            return out
        old, new = profile(d=tree()), profile(d=tree())
        assert {x[:3] for x in compare(old, new) if x[0] != "likely"} == brute(old.types, new.types)


def test_changes_over_series(spark):
    a = [(f"a{i}", "u", "t", i, 1, D(2025, 1, 1), "clash") for i in range(1, 5)] + [("a1", "u", "t", 1, 2, D(2025, 1, 2), "clash"), ("other", "u2", "t", 9, 1, D(2025, 1, 1), "x")]
    r = [("a1", "$", "Exact", " complete "), ("a2", "$", "exact", None), ("a3", "$", "exact", "complete"), ("a4", "$", "exact", "complete"), ("a4", "$", "exact", "complete"), ("ghost", "$", "exact", "complete"), ("other", "$", "exact", "complete"), (None, "$", "exact", "complete")]
    f = [("a1", "$", "$.id", '["number"]', "1", None), ("a1", "$", "$['name']", '["string"]', "x", None), ("a2", "$", "$.zzz", '["string"]', None, None), ("a3", "$", "$.id", '"number"', None, "[1]"), ("a3", "$", "$.title", '["STRING","null"]', "x", None), ("a4", "$", "$.id", '["string"]', None, None), ("a4", "$", "$.id", '["string"]', None, None), ("a3", "$", None, '["x"]', None, None)]
    found = schema_changes(spark.createDataFrame(a, ARTIFACTS), spark.createDataFrame(r, ROOTS), spark.createDataFrame(f, FIELDS))
    assert {tuple(x) for x in found.collect()} == {("a3", "$", "renamed", "$.title", "$.name"), ("a4", "$", "retyped", "$.id", ""), ("a4", "$", "removed", "$.title", "")}
    none = schema_changes(spark.createDataFrame([], ARTIFACTS), spark.createDataFrame([], ROOTS), spark.createDataFrame([], FIELDS))
    assert none.collect() == []


def test_previous_row_across_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), s, f"v{s:03}") for s in rng.sample(range(400), 150)] + [("x", None, "v-null")]
    got = with_previous(spark.createDataFrame(rows, "s string, q long, v string"), ["s"], "q", "v", "p", block=16)
    expected = {}
    for series in "xyz":
        own = sorted((r for r in rows if r[0] == series), key=lambda r: (r[1] is not None, r[1] or 0))
        expected |= {r[2]: (own[i - 1][2] if i else None) for i, r in enumerate(own)}
    assert {r.v: r.p for r in got.collect()} == expected


def test_unified_records(spark):
    from tessera.operators.drift import column_names, unified_records

    a = [(f"a{i}", "u", "t", i, 1, D(2025, 1, 1), "x") for i in range(1, 6)]
    names = {1: ["id", "name"], 2: ["id", "title"], 3: ["id", "label"], 4: ["id", "label", "name"], 5: ["id", "label", "name"]}
    r = [(f"a{i}", "$", "exact", "complete") for i in names]
    f = [(f"a{i}", "$", f"$.{n}", '["number"]' if n == "id" else '["string"]', None, None) for i, own in names.items() for n in own]
    tables = spark.createDataFrame(a, ARTIFACTS), spark.createDataFrame(r, ROOTS), spark.createDataFrame(f, FIELDS)
    records = [("a1", "$", 0, '{"id":1,"name":"n"}'), ("a2", "$", 0, '{"id":1,"title":"n"}'), ("a3", "$", 0, '{"label":"n","name":"stray"}'), ("a5", "$", 0, '{"label":"n","name":"m"}'), ("a5", "$", 1, "[1]"), ("a5", "$", 2, None), ("zz", "$", 0, '{"q z":1}')]
    df = spark.createDataFrame(records, "artifact_id string, root_path string, idx int, record string")
    got = {(r.artifact_id, r.idx): r.fields for r in unified_records(df, column_names(*tables)).collect()}
    assert got[("a1", 0)] == {"$.id": "1", "$.name": '"n"'} == got[("a2", 0)]
    assert got[("a3", 0)] == {"$.name": '"n"', "$.name~2": '"stray"'}
    assert got[("a5", 0)] == {"$.name": '"n"', "$.name~1": '"m"'}
    assert got[("a5", 1)] is None and got[("a5", 2)] is None and got[("zz", 0)] == {"$['q z']": "1"}
    empty = [t.limit(0) for t in tables]
    assert unified_records(df, column_names(*empty)).count() == len(records)


def test_unified_records_of_every_serialisation(spark):
    from tessera.operators.drift import column_names, unified_records

    a = [(f"a{i}", "u", "t", i, 1, D(2025, 1, 1), "x") for i in (1, 2)]
    r = [(f"a{i}", "$", "exact", "complete") for i in (1, 2)]
    f = [(f"a{i}", "$", path, '["string"]', None, None) for i, n in ((1, "name"), (2, "title")) for path in (f"$.{n}", f"$[*].{n}")]
    f += [(f"a{i}", "$", "$[*]", '["object"]', None, None) for i in (1, 2)]
    tables = spark.createDataFrame(a, ARTIFACTS), spark.createDataFrame(r, ROOTS), spark.createDataFrame(f, FIELDS)
    texts = ['"{\\"title\\":\\"s\\"}"', '"[{\\"title\\":\\"t\\"}]"', '[{"title":"x"},[{"title":"y"}],7,"{\\"title\\":\\"z\\"}"]', "[]", '"text"', "{bad", '{"n":1.10,"o":"{\\"k\\":[]}","\u00e9":12345678901234567890123}']
    df = spark.createDataFrame([("a2", "$", i, x) for i, x in enumerate(texts)], "artifact_id string, root_path string, idx int, record string")
    got = {(r.idx, r.element): (r.fields, r.value) for r in unified_records(df, column_names(*tables)).collect()}
    assert got == {
        (0, None): ({"$.name": '"s"'}, None),
        (1, "[0]"): ({"$[*].name": '"t"'}, None),
        (2, "[0]"): ({"$[*].name": '"x"'}, None),
        (2, "[1][0]"): ({"$[*][*].title": '"y"'}, None),
        (2, "[2]"): (None, "7"),
        (2, "[3]"): ({"$[*].name": '"z"'}, None),
        (3, None): (None, "[]"),
        (4, None): (None, '"text"'),
        (5, None): (None, "{bad"),
        (6, None): ({"$.n": "1.10", "$.o": '{"k":[]}', "$['\u00e9']": "12345678901234567890123"}, None),
    }


def test_unified_records_at_every_depth(spark):
    from tessera.operators.drift import column_names, mixed_columns, unified_records

    a = [(f"a{i}", "u", "t", i, 1, D(2025, 1, 1), "x") for i in (1, 2, 3)]
    r = [(f"a{i}", "$", "exact", "complete") for i in (1, 2, 3)]
    o, s, n, l = '["object"]', '["string"]', '["number"]', '["array"]'
    columns = {
        1: {"$.a": o, "$.a.x": s, "$.a.k": n, "$.l": l, "$.l[*]": o, "$.l[*].y": s, "$.v": n},
        2: {"$.a": o, "$.a.z": s, "$.a.k": n, "$.l": l, "$.l[*]": o, "$.l[*]['w w']": s, "$.v": s},  # renamed inside
        3: {"$.b": o, "$.b.z": s, "$.b.k": n, "$.b.new": s, "$.l": l, "$.l[*]": o, "$.l[*]['w w']": s, "$.v": s},  # then the object around
    }
    f = [(f"a{i}", "$", p, t, None, None) for i, own in columns.items() for p, t in own.items()]
    artifacts, roots, fields = spark.createDataFrame(a, ARTIFACTS), spark.createDataFrame(r, ROOTS), spark.createDataFrame(f, FIELDS)
    texts = ['{"a":{"x":"1","k":2},"l":[{"y":"p"}],"v":3}', '{"a":{"z":"1","k":2},"l":[{"w w":"p"}],"v":"3"}', '{"b":{"z":"1","k":2,"new":"n"},"l":"[{\\"w w\\":\\"p\\"}]","v":{"q":null}}']
    df = spark.createDataFrame([(f"a{i + 1}", "$", 0, x) for i, x in enumerate(texts)], "artifact_id string, root_path string, idx int, record string")
    names = column_names(artifacts, roots, fields)
    got = {r.artifact_id: r.fields for r in unified_records(df, names, mixed=mixed_columns(artifacts, fields, names)).collect()}
    same = {"$.a": '{"k":2,"x":"1"}', "$.l": '[{"y":"p"}]', "$.v": '"3"'}
    assert got["a1"] == got["a2"] == same
    assert {k: v for k, v in got["a3"].items() if k == "$.l"} == {"$.l": '[{"y":"p"}]'}
    assert got["a3"]["$.a"] == '{"k":2,"new":"n","x":"1"}' and got["a3"]["$.v"] == '"{\\"q\\":null}"'


def test_typed_table_of_a_series(spark):
    from tessera.operators.drift import column_names, mixed_columns, typed_table, unified_columns

    a = [(f"a{i}", "u", "t", i, 1, D(2025, 1, 1), "x") for i in (1, 2)]
    r = [(f"a{i}", "$", "exact", "complete") for i in (1, 2)]
    columns = {1: {"$.id": '["number"]', "$.ok": '["boolean","null"]', "$.name": '["string"]', "$.v": '["number"]', "$.o": '["object"]'}, 2: {"$.id": '["number"]', "$.ok": '["boolean"]', "$.title": '["string"]', "$.v": '["string"]', "$.o": '["object"]'}}
    f = [(f"a{i}", "$", p, t, None, None) for i, own in columns.items() for p, t in own.items()]
    artifacts, roots, fields = spark.createDataFrame(a, ARTIFACTS), spark.createDataFrame(r, ROOTS), spark.createDataFrame(f, FIELDS)
    f += [("a2", "$", p, t, None, None) for p, t in {"$[*].id": '["number"]', "$[*].OK": '["boolean"]', "$.idx": '["number"]'}.items()]
    fields = spark.createDataFrame(f, FIELDS)
    texts = ['{"id":1,"ok":true,"name":"n \\"q\\"","v":2.50,"o":{"k":1}}', '{"id":2,"ok":null,"title":null,"v":"2"}', '[{"id":3,"OK":false}]']
    records = spark.createDataFrame([(f"a{min(i, 1) + 1}", "$", i, x) for i, x in enumerate(texts)], "artifact_id string, root_path string, idx int, record string")
    names = column_names(artifacts, roots, fields)
    table = typed_table(records, artifacts, names, mixed_columns(artifacts, fields, names), unified_columns(artifacts, fields, names), "t", "$")
    assert dict(table.dtypes) == {"artifact_id": "string", "root_path": "string", "idx": "int", "element": "string", "id": "double", "name": "string", "o": "string", "ok": "boolean", "v": "string", "OK_2": "boolean", "idx_2": "double"}
    assert {x.idx: (x.element, x.id, x.name, x.o, x.ok, x.v, x.OK_2) for x in table.collect()} == {0: (None, 1.0, 'n "q"', '{"k":1}', True, "2.50", None), 1: (None, 2.0, None, None, None, "2", None), 2: ("[0]", 3.0, None, None, None, None, False)}
