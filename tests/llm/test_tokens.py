import os
import random

import pytest

from tessera.llm import tokens

PATH = os.path.join(tokens.VOCABULARY, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
TEXTS = ["", " ", "\n\n \t", "Hello  world's 123 <|endoftext|>", "naïve 日本語 🙂👩‍🔧", "a" * 5000, "=" * 3000 + " x", "  ​", "don't we'll I'VE", "ab" * 700 + "0" * 900]


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokens.parse_ranks(tokens.read_ranks(PATH))
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_libraries():
    data, enc = tokens.read_ranks(PATH), reference()
    assert tokens.encode_texts(TEXTS, data) == [enc.encode_ordinary(t) for t in TEXTS]
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    assert tokens.encode_texts(TEXTS, data) == [e.ids for e in lib.encode_batch(TEXTS, add_special_tokens=False)]


def test_random_pieces_and_round_trip():
    data, enc, rng = tokens.read_ranks(PATH), reference(), random.Random(4)
    encoder, _ = tokens._encoder(data)
    for _ in range(2000):
        piece = bytes(rng.choice([rng.randrange(256), *b"aeint h"]) for _ in range(rng.randint(1, 40)))
        ids = encoder.encode(piece)
        assert ids == enc._encode_single_piece(piece)
        assert b"".join(encoder.spelling[i] for i in ids) == piece


def test_rows(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, "same", "same"])] + [(0, "again", "clash"), (None, "x", "clash")]
    got = tokens.token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    found = got.collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r.ids for r in found if r.doc_id}
    assert by[len(TEXTS)] == [] and by[1] == reference().encode_ordinary(" ")
    assert tokens.token_ids(spark.createDataFrame([], "doc_id long, text string")).collect() == []
