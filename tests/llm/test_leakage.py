import random

from tessera.llm.leakage import WindowSearch, leaked, words_of


def brute(docs, items, size):
    out = set()
    for d, t in docs:
        w = words_of(t)
        for i, x in items:
            v = words_of(x)
            own = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)}
            if any(tuple(w[k : k + size]) in own for k in range(len(w) - size + 1)):
                out.add((d, i))
    return out


def test_words():
    assert words_of("Ｃafé ſoft­hyphen zero​width A_b ﬁne İX ①②") == ["cafe", "softhyphen", "zerowidth", "a", "b", "fine", "ix", "12"]
    assert words_of("été") == ["ete"] and words_of(None) == words_of("") == words_of(" -- ") == []


def test_search_against_brute_force():
    rng = random.Random(9)
    for size in (2, 3, 5, 13):
        for _ in range(60):
            vocabulary = "abcdef"[: rng.randint(2, 6)]
            text = lambda n: " ".join(rng.choice([*vocabulary, "zz"]) for _ in range(rng.randint(0, n)))
            items = [(i, text(30)) for i in range(6)]
            docs = [(i, text(120)) for i in range(6)]
            search = WindowSearch(items, size)
            assert {(d, i) for d, t in docs for i in search.find(t)} == brute(docs, items, size)


def test_rows(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = [(1, "x " + passage.upper() + " y", 9), (1, "repeated id", 9), (2, passage.replace("w5", "v5"), 9), (3, None, 9), (4, "", 9), (5, ", ".join(passage.split()), 9), (None, passage, 9), (6, "q " * 300_000 + passage, 9)]
    items = [(10, passage, "s"), (10, passage, "s"), (11, passage + " tail", "s"), (12, "too short", "s"), (13, None, "s"), (None, passage, "s")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    expected = sorted((a, b) for a in (1, 5, 6) for b in (10, 11))
    assert sorted(tuple(r) for r in leaked(d, i).collect()) == expected
    # items in several blocks give the same
    assert sorted(tuple(r) for r in leaked(d, i, windows=1).collect()) == expected
    assert leaked(d.limit(0), i).collect() == [] and leaked(d, i.limit(0)).collect() == []


def test_long_items_are_cut_into_pieces_that_overlap(spark):
    words = [f"w{i}" for i in range(5000)]
    d = spark.createDataFrame([(k, " ".join(words[k : k + 13])) for k in (0, 1995, 1999, 2000, 3990, 4987)] + [(9000, " ".join(words[4988:]))], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert sorted(r.doc_id for r in leaked(d, i).collect()) == [0, 1995, 1999, 2000, 3990, 4987]
    assert sorted(r.doc_id for r in leaked(d, i, windows=1500).collect()) == [0, 1995, 1999, 2000, 3990, 4987]


def test_memory_of_a_block():
    import tracemalloc

    rng = random.Random(4)
    words = [f"w{rng.randrange(50_000)}" for _ in range(100_000)]
    tracemalloc.start()
    search = WindowSearch([(1, words)])
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 250 * 100_000 and search.find(" ".join(words[500:513])) == {1}
