import random

from tessera.operators.hierarchy import ancestor_pairs, hierarchy, paths

ROWS = "node string, parent string, gen int, root_id string, k string"


def brute(links):
    key = lambda s: s.strip().lower() or None
    up = {key(n): (n, key(p) if p else None) for n, p in links.items()}
    out, reach = {}, {n: set() for n in up}
    for n in up:
        path, at = [n], up[n][1]
        while at in up and at not in path:
            path.append(at)
            at = up[at][1]
        for a in path[1:]:
            reach[a].add(n)
        if at in up:  # a cycle, from at on
            cycle = path[path.index(at) :]
            depth = path.index(at)
            for a in cycle:
                if a != n:
                    reach[a].add(n)
            out[n] = (min(up[c][0] for c in cycle), depth, "below_cycle" if depth else "cycle")
        else:
            out[n] = (up[path[-1]][0], len(path) - 1, "tree" if up[path[-1]][1] is None else "dangling")
    return {up[n][0]: (root, depth, len(reach[n]), state) for n, (root, depth, state) in out.items()}, {(up[n][0], up[a][0]) for a in up for n in reach[a]}


def check(spark, links, extra=(), cores=(0, 8192)):
    df = spark.createDataFrame([(n, p, 2, "clash", "clash") for n, p in links.items()] + list(extra), ROWS)
    expected, pairs = brute(links)
    up = {n.strip().lower(): (n, (p or "").strip().lower()) for n, p in links.items()}
    for core in cores:  # 0: all in rounds, without the one task at the end
        if core:  # the same rounds without paths
            got = {r.id: (r.root_id, r.depth, r.n_desc, r.state) for r in hierarchy(df, "node", "parent", ("gen",), core=core).collect()}
            assert got == expected
        for r in paths(df, "node", "parent", ("gen",), core=core).collect():
            own = [r.id]
            while len(own) <= r.depth:
                own.insert(0, up[up[own[0].strip().lower()][1]][0])
            assert (r.root_id, r.depth, r.n_desc, r.state) == expected[r.id] and r.path == own, core
        above = ancestor_pairs(df, "node", "parent", ("gen",), core=core).collect()
        assert {(r.id, r.ancestor_id) for r in above if r.id != r.ancestor_id} == pairs, core
        for r in above:
            at = r.id
            for _ in range(r.distance):
                at = up[up[at.strip().lower()][1]][0]
            assert at == r.ancestor_id
        assert len({(r.id, r.ancestor_id) for r in above}) == len(above)


def test_shapes(spark):
    check(spark, {"a": None, "b": " A ", "c": "b", "d": "missing", "e": "", "self": "self", "x": "y", "y": "z", "z": "X", "below": "x", "deep": "below"}, [("b", "c", 1, "", ""), (None, "a", 2, "", ""), ("a", None, 2, "", "")])


def test_random_forests(spark):
    rng = random.Random(2)
    for n in (1, 30):
        links = {f"n{i}": rng.choice([None, "gone", *[f"N{rng.randrange(n)}" for _ in range(8)]]) for i in range(n)}
        check(spark, links)


def test_long_cycle_with_chains_into_it(spark):
    links = {f"c{i}": f"c{(i + 1) % 9}" for i in range(9)} | {f"t{i}": f"t{i - 1}" if i else "c4" for i in range(12)} | {f"u{i}": "t5" for i in range(3)}
    check(spark, links, cores=(5,))


def test_long_chain_and_wide_node(spark):
    links = {"r": None} | {f"c{i}": f"c{i - 1}" if i else "r" for i in range(20)} | {f"w{i}": "r" for i in range(200)}
    check(spark, links, cores=(0, 8192))


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert hierarchy(df, "node", "parent", ("gen",)).collect() == []
    assert paths(df, "node", "parent", ("gen",)).collect() == []
    assert ancestor_pairs(df, "node", "parent", ("gen",)).collect() == []
