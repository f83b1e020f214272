import json
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import canonical, redaction, text
from tessera.operators import code, pages, profile, results, sampling, search
from tessera.operators.catalog import valid_rows
from tessera.operators.lifecycle import quota_victims, reconcile, running_total
from tessera.sources import captures
from tessera.sources.store import Table, Taken, prepared, verified


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_canonical_vectors():
    c = lambda s: canonical.canonical_text(canonical.loads_decimal(s))
    assert c('{"b":2,"a":1}') == '{"a":1,"b":2}'
    assert c("1.2300") == "1.23" and c("0.0000001") == "1e-7" and c("1e21") == "1e+21" and c("-0.0") == "0" and c("100") == "100"
    assert c("123456789012345678901234567890") == "1.2345678901234567890123456789e+29" and c("0.000001") == "0.000001" and c("12.5e3") == "12500"
    assert list(json.loads(c('{"\\ufffd":1,"\\ud83d\\ude00":2}'))) == ["\U0001f600", "�"]
    with pytest.raises(TypeError):
        canonical.canonical_text(1.5)
    assert canonical.coerce_floats({"a": [1.5]}) == {"a": [Decimal("1.5")]}
    with pytest.raises(ValueError):
        canonical.loads_decimal("NaN")


def test_canonical_columns(spark):
    assert one(spark, '{"b": 1.0, "a": [true, null]}', canonical.canonical) == '{"a":[true,null],"b":1}'
    assert one(spark, "{broken", canonical.canonical) is None and one(spark, None, canonical.canonical) is None
    assert one(spark, '{"a":"{\\"b\\":\\"[1]\\"}","c":"1"}', canonical.resolved) == '{"a":{"b":[1]},"c":"1"}'
    assert one(spark, '[{"a":1},{"a":2},{"a":"x"}]', canonical.shape_of) == json.dumps(['{"a": "number"}', '{"a": "string"}'])


def test_redaction(spark):
    t = "https://h/p?access_token=abc&x=1 Authorization: Bearer abc123xyz sk_live_12345678 ghp_12345678901234567890 xoxb-1234567890 EA12345678901234567890 &api_key=[REDACTED_SECRET]"
    clean = one(spark, t, redaction.redact)
    assert clean.count("[REDACTED_SECRET]") == 7 and "abc" not in clean and "1234567890" not in clean
    assert one(spark, t, redaction.secrets) == 6
    long = "Bearer abc123xyz " + "x" * 40_000
    assert one(spark, long, redaction.redact) == long and one(spark, None, redaction.redact) is None
    tree = json.dumps({"a": ["Bearer abc123xyz"], "b": ' {"c": "sk_test_12345678"} ', "d": long})
    got = json.loads(one(spark, tree, redaction.redact_json))
    assert got == {"a": ["Bearer [REDACTED_SECRET]"], "b": ' {"c":"[REDACTED_SECRET]"} ', "d": long}


def test_text_functions(spark):
    assert one(spark, "x" * 31, text.truncated) == "[" + "x" * 30 + "](1 more chars truncated)"
    assert one(spark, "a'b", text.path_step) == "['a\\'b']" and one(spark, "ab", text.path_step) == ".ab"
    assert one(spark, "https://h/p?a=1&b=x%20y&a=2", text.query_parameters) == {"a": "2", "b": "x y"}
    assert one(spark, '<https://h?p=1>; rel="prev", <https://h?p=3>; rel="next"', text.link_next) == "https://h?p=3"
    assert one(spark, "run --a 1 --b=two --a 3", text.cli_flags) == {"a": "3", "b": "two"}
    assert one(spark, "aéa", lambda c: text.truncated_bytes(c, 2)) == "a" and one(spark, "aé", lambda c: text.truncated_bytes(c, 3)) == "aé"
    assert one(spark, "Image/JPG; q=1", text.normal_mime) == "image/jpeg" and one(spark, "x/y+json", text.is_json_mime)
    assert one(spark, " Next-Page.Token_ ", text.normal_name) == "nextpagetoken"


def test_search(spark):
    docs = spark.createDataFrame([("1", "red blue"), ("2", "red red green and more words"), ("3", None), ("4", "bluebird")], "id string, t string")
    hits = {r.id: r.score for r in search.bm25(docs, "id", ["t"], "red").collect()}
    assert set(hits) == {"1", "2"} and all(v < 0 for v in hits.values())
    assert {r.id for r in search.bm25(docs, "id", ["t"], "blue*").collect()} == {"1", "4"}
    assert {r.id for r in search.bm25(docs, "id", ["t"], "red blue").collect()} == {"1"}
    assert {r.id for r in search.bm25(docs, "id", ["t"], "green OR bluebird").collect()} == {"2", "4"}
    assert search.bm25(docs, "id", ["t"], " ").collect() == [] and search.bm25(docs.limit(0), "id", ["t"], "red").collect() == []
    with pytest.raises(ValueError):
        search.conditions({"nope": 1})


def test_lifecycle(spark):
    rows = [("a", "p1", 10, 1), ("b", "p2", 20, 2), ("c", "p1", 10, 3), ("d", None, 5, 4)]
    df = spark.createDataFrame([(i, h, n, datetime(2025, 1, d), None) for i, h, n, d in rows], "artifact_id string, payload_hash_full string, payload_total_bytes long, last_referenced_at timestamp_ntz, deleted_at timestamp_ntz")
    assert sorted((r.artifact_id, r.freed, r.running) for r in quota_victims(df, 25).collect()) == [("a", 0, 0), ("b", 20, 20), ("c", 10, 30)]
    totals = running_total(spark.range(100).withColumn("one", F.lit(1)), ["id"], "one", "n")
    assert all(r.n == r.id + 1 for r in totals.collect())
    left, right = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["a", "b"], ["b", "c"]))
    assert sorted(tuple(r) for r in reconcile(left, right, "k").collect()) == [("a", "missing"), ("c", "orphan")]
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 0, "y"), ("a", 2, 5, None)], "artifact_id string, generation int, ingested_at int, v string")
    assert [r.v for r in valid_rows(rows).collect()] == [None]


def test_sampling_invariants(spark):
    rows = [("r1", i, 500 if i % 4 == 0 else 20, "ab" * 32) for i in range(40)] + [("r2", i, 20, "cd" * 32) for i in range(3)]
    df = spark.createDataFrame(rows, "root string, idx int, size int, seed string")
    take = lambda d: sorted(tuple(r) for r in sampling.reservoir(d, ["root"], "idx", "size", "seed", max_bytes=50, max_records=10).collect())
    got = take(df)
    assert got == take(df.orderBy(F.desc("idx")).repartition(7)) and sum(r[0] == "r2" for r in got) == 3 and sum(r[0] == "r1" for r in got) == 10
    assert all(i % 4 for r, i in got if r == "r1")
    assert {(r.root, r.seen, r.oversize, r.sampled) for r in sampling.coverage(df, ["root"], "size", 50, 10).collect()} == {("r1", 40, 10, 10), ("r2", 3, 0, 3)}
    assert take(df.limit(0)) == []
    # reference outputs of the published generator for this seed
    g = sampling.Generator((0).to_bytes(8, "little"))
    assert g.state[0] == 0xE220A8397B1DCDAF and 0 <= g.random() < 1


def test_next_page():
    from tessera.operators.nextpage import assess, link_next, more_of

    note = lambda page, args=None, meta=None, **kw: assess(page, args or {}, meta, **kw)
    assert note({"has_more": False, "next_cursor": "x"})[:4] == ("COMPLETE", None, False, None)
    assert note({"result": {"paging": {"cursors": {"after": "k"}}}})[3:6] == ('{"after":"k"}', 0.99, "cursor_path")
    stuck = note({"next_cursor": "k", "has_more": True}, {"Next-Cursor": "k"})
    assert stuck[:2] == ("PARTIAL", "NEXT_TOKEN_MISSING") and stuck[6]
    assert note({"next_cursor": "k2"}, {"after": "k"})[3] == '{"after":"k2"}' and note({"cursor": True, "nextCursor": " "})[3] is None
    assert note({"items": [1, 2]}, {"limit": 2, "offset": 4})[3:6] == ('{"offset":6}', 0.72, "numeric_args")
    assert note({"hasMore": True}, {"page": 3})[3] == '{"page":4}' and note({"hasMore": True}, {"page": True})[3] is None
    assert note({"items": [1]}, {"limit": 2})[0] is None and note({"items": [1]}, {"limit": 2}, first=False)[0] == "COMPLETE"
    assert note({"is_last": False})[:2] == ("PARTIAL", "NEXT_TOKEN_MISSING") and note([1, 2])[0] is None and note({})[0] is None
    # an address that only repeats the position is no next page, its size alone neither
    assert note({"next": "/p?after=x&limit=50"}, {"after": "x"})[6] and note({"next": "/p?page=2"}, {"page": 2})[3:6] == ('{"page":3}', 0.68, "numeric_args") and note({"next": "?limit=50"}, {"limit": 10})[3] is None
    assert note({"next": {"page": 3, "limit": 5}}, {"page": 2})[3] == '{"page":3}'
    assert link_next('<a>; rel="prev", <b,c>; title="x, y"; rel="next last"') == "b,c" and link_next("<a>; rel=prev") is None and link_next("") is None
    assert more_of({"next": {"a": ""}}, {}) is False and more_of({}, {"x-has-more": "No"}) is False and more_of({}, {"x-cursor": "c"}) is True
    assert note({}, {}, {"headers": {"X-Next-Page": "https://h/?page=2"}})[5] == "header_next_url"
    assert note({"n": None}, {}, config={"strategy": "param_map", "next_params_response_paths": {"a": "$.n"}})[:2] == ("PARTIAL", "SIGNAL_INCONCLUSIVE")


def test_leaf_roots(spark):
    roots = spark.createDataFrame([("a", "$"), ("a", "$.x"), ("a", "$.x.y"), ("a", "$.xy"), ("b", "$")], "g string, p string")
    assert sorted(tuple(r) for r in pages.leaf_roots(roots, ["g"], "p").collect()) == [("a", "$.x.y"), ("a", "$.xy"), ("b", "$")]


def test_cursors():
    now = datetime(2025, 1, 1, tzinfo=UTC)
    b = results.select_bindings("single", "$", ["$.a"], None, None, "h")
    token = results.encode_cursor("select", "a", {"offset": 5}, b, now)
    assert "=" not in token and results.decode_cursor(token, "select", "a", b, now) == {"offset": 5}
    for args, code_ in (((token, "get", "a", b, now), "MISMATCH"), ((token, "select", "a", b | {"scope": "x"}, now), "STALE"), ((token, "select", "a", b, now + timedelta(hours=2)), "EXPIRED"), (("???", "select", "a", b, now), "INVALID")):
        with pytest.raises(results.CursorError, match=code_):
            results.decode_cursor(*args)
    assert [results.bounded_limit(x) for x in (0, 5, 5000, "x", True, None)] == [1, 5, 1000, 50, 50, 50]
    assert results.response_mode(10, False) == "full" and results.response_mode(10, True) == results.response_mode(10**6, False) == "schema_ref"
    assert results.retrieval_page([1, 2, 3], 2) == ([1, 2], True)
    assert results.auto_paginate_limits({"pages": 5, "records": -1}, {"pages": 10, "records": 100}) == {"pages": 5, "records": 100}


def test_code_guard(spark):
    ok = "import math\ndef run(data, schema, params):\n    return [math.floor(len(data))]\n"
    assert code.check(ok) == ("data", "schema", "params")
    for bad, why in (("import os\n" + ok, "IMPORT"), ("x = 1", "ENTRYPOINT"), ("def run(a): pass", "ENTRYPOINT"), ("def run(data, schema, params):\n    return ().__class__", "AST"), ("def run(data, schema, params):\n    return open('x')", "AST"), ("def run(", "AST")):
        with pytest.raises(code.CodeError, match=why):
            code.check(bad)
    df = spark.createDataFrame([("g", 1, "[2]"), ("g", 0, "1"), ("h", 0, None)], "g string, idx int, record string")
    assert {(r.g, r.item) for r in code.run_grouped(df, "def run(data, schema, params):\n    return data", ["g"]).collect()} == {("g", "1"), ("g", "[2]")}
    # a group that is too large, or whose code fails, does not stop the others
    got = {r.g: (r.item, (r.error or "")[:17]) for r in code.run_grouped(df, ok, ["g"], max_records=1).collect()}
    assert got == {"g": (None, "INPUT_TOO_LARGE: "), "h": ("0", "")}
    got = {r.g: (r.error or "")[:36] for r in code.run_grouped(df, "def run(data, schema, params):\n    return 1 / len(data)", ["g"]).collect()}
    assert got == {"g": "", "h": "RUNTIME_EXCEPTION: ZeroDivisionError"}
    for bad in ("from urllib.request import urlopen", "import urllib.request", "from io import open", "import io\nx = io.open", "import secrets"):
        with pytest.raises(code.CodeError):
            code.check(bad + "\n" + ok)
    code.check("import csv, io, base64, uuid, pprint\nfrom urllib.parse import parse_qsl\n" + ok)


def test_code_over_several_artifacts(spark):
    rows = [("s", "a", "$", 0, '{"k":1}'), ("s", "b", "$", 0, '{"k":1}'), ("s", "b", "$.x", 0, '{"k":2}'), ("t", "c", "$", 0, None)]
    df = spark.createDataFrame(rows, "s string, artifact_id string, root_path string, idx int, record string")
    source = "def run(artifacts, schemas, params):\n    return {a: [r['k'] for r in x] for a, x in artifacts.items()}"
    assert {r.s: r.item for r in code.run_grouped(df, source, ["s"]).collect()} == {"s": '{"a": [1], "b": [1, 2]}', "t": '{"c": []}'}
    roots = spark.createDataFrame([("a", "$"), ("b", "$.x")], "artifact_id string, root_path string")
    assert {r.s: r.item for r in code.run_grouped(code.targets(df, roots), source, ["s"]).collect()} == {"s": '{"a": [1], "b": [2]}'}


def test_code_by_batches(spark):
    source = "def run(data, schema, params):\n    return [x for x in data if x > 1]"
    items = lambda rows: [r.item for r in code.run_rows(spark.createDataFrame(rows, "record string").coalesce(1), source).collect()]
    size, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 2, 10_000):  # batches in the beginning, middle and end, or all of them, give no items
            spark.conf.set(size, n)
            assert items([(x,) for x in ("1", "1", "2", None, "1", "1", "3", "0")]) == ["2", "3"]
            assert items([("1",), (None,), ("0",)]) == items([]) == []
    finally:
        spark.conf.set(size, before)


def test_numbered_over_hot_series(spark):
    from tessera.operators.series import numbered

    rows = [("hot" if i % 4 else None if i % 8 else "cold", (i * 37) % 400, i) for i in range(400)]
    got = {r.i: r.place for r in numbered(spark.createDataFrame(rows, "s string, q int, i int"), ["s"], ["q", "i"], "place").collect()}
    for series in ("hot", "cold", None):
        own = sorted((q, i) for s, q, i in rows if s == series)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert numbered(spark.createDataFrame([], "s string, q int"), ["s"], ["q"], "place").collect() == []


def test_search_language(spark):
    docs = spark.createDataFrame([(1, "red boat", "lake"), (2, "boat red", "lake"), (3, "red boat", "sea harbour"), (4, "lake", "red boat"), (5, None, None)], "k int, title string, body string")
    hits = lambda q: {r.k for r in search.bm25(docs, "k", ["title", "body"], q).collect()}
    assert hits('"red boat"') == {1, 3, 4} and hits('title:"red boat"') == {1, 3} and hits("boat NOT sea") == {1, 2, 4} and hits("title:lake") == {4}
    assert hits('"boat lake"') == set() and hits("har* OR title:lake") == {3, 4} and hits("red boat NOT title:red") == {4} and hits("") == set()
    for bad in ('"open', "a NOT", "NOT a", "where:x", "gh.issues"):
        with pytest.raises(ValueError):
            search.bm25(docs, "k", ["title", "body"], bad)


def test_signature_identity_sample(spark):
    page = {"data": [1, 2], "result": {"items": [{"b": 1.50, "a": 2}, {"a": 3}, {}]}, "items": [1, 2, 3]}
    got = one(spark, json.dumps(page), pages.collection_signature)
    assert (got.root_path, got.records) == ("$.result.items", 3) and got.dataset_hash == one(spark, '[{"a":2,"b":1.5},{"a":3},{}]', pages.collection_signature).dataset_hash
    assert one(spark, '{"data":[1]}', pages.collection_signature).root_path is None and one(spark, "[1,2]", pages.collection_signature).root_path == "$"
    key = lambda args: spark.createDataFrame([("u", "forge", "list", args)], "u string, p string, t string, a string").select(text.request_identity("u", "p", "t", "a").alias("k")).first().k
    assert key('{"b":1.0,"a":"x"}') == key('{ "a":"x", "b":1 }') != key('{"a":"x"}') and key(None) == key("{}")
    assert json.loads(one(spark, '[{"a":"' + "x" * 40 + '"},{"a":"y"}]', canonical.representative_sample)) == {"sample_item": {"a": "[" + "x" * 30 + "](10 more chars truncated)"}, "sample_item_count": 2, "sample_item_source_index": 0, "sample_item_text_truncated": True}
    assert one(spark, '[{"a":1},{"b":1}]', canonical.representative_sample) is None and one(spark, "[]", canonical.representative_sample) is None and one(spark, "x", canonical.representative_sample) is None


def test_mapping(spark):
    from tessera.operators import mapping

    df = spark.createDataFrame([("a", '{"l":[1,2]}', 11, False), ("b", '{"l":[1,2,3]}', 13, False), ("c", "[{}]", 4, True), ("d", "[]", None, None), ("e", "[1]", 500, False)], "k string, t string, n int, b boolean")
    got = {r.k: (r.map_kind, r.root_path, r.elements) for r in mapping.mapped(df, "k", "t", F.col("n"), F.col("b"), full=12, memory=100).collect()}
    assert got == {"a": ("full", "$.l", 2), "b": ("partial", "$.l", 3), "c": ("partial", "$", 1), "d": ("failed", None, None), "e": ("failed", None, None)}
    now = spark.createDataFrame([("a", 2, "pending"), ("b", 1, "ready"), ("c", None, "pending")], "artifact_id string, generation int, map_status string")
    results = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("z", 1), ("c", 1)], "artifact_id string, generation int")
    judged = mapping.judged_results(now, results)
    assert {(r.artifact_id, r.generation): r.outcome for r in judged.collect()} == {("a", 1): "stale", ("a", 2): "accepted", ("b", 1): "settled", ("z", 1): "unknown", ("c", 1): "stale"}
    assert {r.artifact_id: r.map_status for r in mapping.persisted(now, judged).collect()} == {"a": "ready", "b": "ready", "c": "pending"}


def test_capture_and_append(spark, tmp_path):
    for i, t in enumerate(['[{"a":1},{"a":2}]', "plain text", '{"b":1.0}', '{ "b": 1 }']):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text(t)
    tables = captures.capture(captures.read_payloads(spark, str(tmp_path / "in")), "s", "tool.x")
    assert tables["payload_blobs"].count() == 3  # equal content is stored once
    assert sorted(r.record for r in tables["artifact_records"].collect()) == ['"plain text"', '{"a":1}', '{"a":2}', '{"b":1}', '{"b":1}']
    for _ in range(2):
        captures.persist(spark, tables, str(tmp_path / "store"))
    stored = {n: Table(spark, str(tmp_path / "store" / n)) for n in tables}
    assert {n: t.read().count() for n, t in stored.items()} == {"payload_blobs": 3, "artifacts": 4, "artifact_records": 5} and len(stored["artifacts"].commits()) == 1
    a = captures.persist_derived(spark, spark.range(2).select(F.col("id").cast("string").alias("item")), str(tmp_path / "d"), ["p1", "p2", "p1"], "query", "x")
    assert a == captures.persist_derived(spark, spark.range(2).select(F.col("id").cast("string").alias("item")), str(tmp_path / "d"), ["p2", "p1"], "query", "x")
    assert Table(spark, str(tmp_path / "d" / "lineage")).read().count() == 2
    assert captures.read_blobs(spark, str(tmp_path / "in"), content=False).count() == 4
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "d.json").write_text('{"x":{"b":{"n":2},"a":{"n":1}}}')
    assert captures.read_dataset(spark, str(tmp_path / "one"), "$.x", values_of_object=True).count() == 2
    captures.write_manifest(spark.createDataFrame([("h", "a;b")], "hash string, ids string"), str(tmp_path / "m"))


def test_store_with_two_writers(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    first, second = Table(spark, str(tmp_path / "t")), Table(spark, str(tmp_path / "t"))
    assert first.read("k string, v int").collect() == [] and first.append_absent(frame(("a", 1), ("a", 1), (None, 0)), ["k"]) == 0
    # another writer commits between this one's look at the log and its own commit
    commit, done = first._commit, []

    def late(number, come, gone):
        if not done:
            done.append(second.append_absent(frame(("b", 2), ("c", 9)), ["k"]))
        commit(number, come, gone)

    first._commit = late
    assert first.append_absent(frame(("b", 3), ("d", 4), (None, 5)), ["k"]) == 2 and done == [1]
    assert {(r.k, r.v) for r in second.read().collect()} == {("a", 1), (None, 0), ("b", 2), ("c", 9), ("d", 4)}
    assert second.append_absent(frame(("a", 7)), ["k"]) == -1 and len(second.commits()) == 3
    # an update bound to a state of the table fails once that is gone
    with pytest.raises(Taken):
        second.update(F.col("v") > 3, {"v": F.lit(0)}, expected=2)
    assert second.update(F.col("v") > 3, {"v": F.lit(0)}, expected=3) == 3
    assert {(r.k, r.v) for r in first.read().collect()} == {("a", 1), (None, 0), ("b", 2), ("c", 0), ("d", 0)}
    with pytest.raises(Taken):
        second._commit(0, [], [])


def test_draws_in_blocks(spark):
    a, b = sampling.Generator(b"seed"), sampling.Generator(b"seed")
    for _ in range(1000):
        a.random()
    b.skip(1000)
    assert a.state == b.state
    rows = [("r" if i % 5 else None, i, 10 if i % 7 else 10**6, sampling.seed_of("p", str(i % 5 > 0), "f").hex()) for i in range(300)]
    df = spark.createDataFrame(rows, "root string, idx int, size int, seed string")
    expected = set()
    for root in ("r", None):
        own = [(i, seed) for r, i, n, seed in rows if r == root and n <= 100]
        g = sampling.Generator(bytes.fromhex(own[0][1]))
        expected |= {(root, i) for _, i in sorted((g.random(), i) for i, _ in own)[:20]}
    for block in (7, 1000):
        got = sampling.reservoir(df, ["root"], "idx", "size", "seed", max_bytes=100, max_records=20, block=block).collect()
        assert len(got) == 40 and {(r.root, r.idx) for r in got} == expected, block


def test_roots_and_references(spark):
    from tessera.operators import catalog

    a = spark.createDataFrame([("a",), ("b",), ("c",)], "artifact_id string")
    roots = spark.createDataFrame([("a", "$"), ("b", "$.x"), ("b", "$.y"), ("b", "$.x")], "artifact_id string, root_path string")
    tell = lambda asked: {r.artifact_id: (r.status, r.root_path, r.suggestions) for r in catalog.resolved_root(a, roots, asked).collect()}
    assert tell(None) == {"a": ("ok", "$", None), "b": ("ambiguous", None, "$.x,$.y"), "c": ("missing", None, "")}
    assert tell("$.x") == {"a": ("missing", None, "$"), "b": ("ok", "$.x", None), "c": ("missing", None, "")}
    ref = lambda v: (r := one(spark, v, text.artifact_ref)) and tuple(r)
    name = "art_" + "0f" * 16
    assert ref(name) == (name, None) and ref(f"{name}:$.a[0]") == (name, "$.a[0]") and ref(name + ":a") is None and ref("art_x") is None and ref(None) is None


def test_stored_bytes(spark):
    rows = prepared(spark.createDataFrame([('{"b":1.0, "a":2}',), ("no json",), ("",)], "t string"), "t")
    assert {(r.envelope, r.intact) for r in verified(rows).collect()} == {('{"a":2,"b":1}', True), ("no json", True), ("", True)}
    spoiled = rows.withColumn("stored", F.concat(F.col("stored"), F.lit("x").cast("binary")))
    assert not any(r.intact for r in verified(spoiled).collect()) and all(r.intact for r in verified(prepared(rows.select("t"), "t", "none"), "none").collect())
    assert rows.where("t = 'no json'").first().stored == rows.where("t = 'no json'").first().stored


def test_streaming_pages(spark, tmp_path):
    from tessera.streaming import pages as stream

    (tmp_path / "in").mkdir()
    page = {"artifact_id": "a", "session_id": "s", "captured_at": "2025-01-01T00:00:00Z", "page": '[{"x":1},{"x":2}]'}
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, [page, page | {"artifact_id": "b"}, page | {"page": "{broken"}])))
    out = str(tmp_path / "out")
    for _ in range(2):
        stream.ingest(stream.read_pages(spark, str(tmp_path / "in")), out, str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2  # the repeated page once, also after a restart


def test_partial_mapping(spark):
    from tessera.operators.partial import Budget, collapsed, map_payloads

    texts = {"a": '[{"a":1},{"b":[1,"x"]},3]', "b": '{"x":{"items":[{"a":null}],"n":2},"y":[]}', "c": '[{"a":1},{"b":', "d": None, "e": "", "f": '"s"', "g": "[1,2,3,4]", "h": '[{"big":"' + "x" * 90 + '"},{"a":1}]'}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    roots = map_payloads(df, "k", "t", Budget(elements=3, record_bytes=50))
    got = {(r.k, r.root_path): (r.elements, r.objects, r.oversize, r.closed, r.stop_reason, r.indices) for r in roots.collect()}
    assert got == {
        ("a", "$"): (3, 2, 0, True, None, [0, 1]),
        ("b", "$.x.items"): (1, 1, 0, True, None, [0]),
        ("b", "$.y"): (0, 0, 0, True, None, []),
        ("c", "$"): (1, 1, 0, False, "parse_error", [0]),
        ("g", "$"): (3, 0, 0, False, "max_elements", []),
        ("h", "$"): (2, 2, 1, True, None, [1]),
    }
    paths = {r.k: r.paths for r in roots.where("root_path = '$'").collect()}
    assert paths["a"] == {"$.a": "number", "$.b": "array", "$.b[*]": "number,string"}
    one = {r.k: (r.elements, r.complete, [tuple(s) for s in r.starts]) for r in collapsed(roots, "k").collect()}
    assert one["b"] == (1, True, [("$.x.items", 0), ("$.y", 1)]) and one["c"][1] is False
    assert map_payloads(df.limit(0), "k", "t").collect() == []


def test_record_profile_of_all_records(spark):
    deep = '{"d":' * 100 + "1" + "}" * 100
    rows = [("a", "$", 0, '{"x":1}'), ("a", "$", 1, '{"x":1}'), ("b", "$", 0, '{"x":null,"l":[{"k":"s"},2]}'), ("b", "$", 0, '{"x":2,"q z":true}'), ("b", "$", 1, "{bad"), ("b", "$", 2, None), ("c", "$.r", 0, deep), (None, None, None, '{"x":"t"}'), (None, None, None, '{"x":"t"}')]
    got = {(r.root_path, r.path): (r.types, r.observed, r.nullable, r.required) for r in profile.record_profile(spark.createDataFrame(rows, "artifact_id string, root_path string, idx int, record string")).collect()}
    assert {k: v for k, v in got.items() if k[0] != "$.r"} == {
        ("$", "$.x"): (["null", "number"], 3, True, True),
        ("$", "$.l"): (["array"], 1, False, False),
        ("$", "$.l[*]"): (["number", "object"], 1, False, False),
        ("$", "$.l[*].k"): (["string"], 1, False, False),
        ("$", "$['q z']"): (["boolean"], 1, False, False),
        (None, "$.x"): (["string"], 1, False, True),
    }
    assert got["$.r", "$" + ".d" * 100] == (["number"], 1, False, True) and sum(k[0] == "$.r" for k in got) == 100
    rows = [("b", "$", 0, '{"x":"late"}'), ("a", "$", 3, '{"x":{"k":1}}'), ("a", "$", 4, '{"x":7.50,"l":[{"z":1},{"b":"' + "y" * 40 + '"}]}'), ("a", "$.o", 0, '{"x":null}')]
    profiles = profile.record_profile(spark.createDataFrame(rows, "artifact_id string, root_path string, idx int, record string"))
    seen = {(r.root_path, r.path): (r.example, r.distinct_values, r.cardinality) for r in profiles.collect()}
    assert seen["$", "$.x"] == ('{"k":1}', "[7.50]", 1) and seen["$.o", "$.x"] == ("null", "[null]", 1) and seen["$", "$.l[*]"] == ('{"z":1}', None, None)
    assert seen["$", "$.l[*].b"][0] == "[" + "y" * 30 + "](10 more chars truncated)"
    merged = {r.path: (r.types, r.observed, r.nullable, r.example) for r in profile.merged_profile(profiles.withColumn("g", F.lit(1)), ["g"]).collect()}
    assert merged["$.x"] == (["null", "number", "string", "object"], 4, True, '{"k":1}')
