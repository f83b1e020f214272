"""Encoding of a corpus with a public byte-level BPE.

A text is split by the tokenizer's own pattern; each distinct piece is encoded once per worker by
dynamic programming over its prefixes: an automaton of the vocabulary's suffix links reports the
tokens that end at each position, and for every prefix the one token is stored that ends its
encoding, namely the one whose predecessor (the last token of the shorter prefix) would not have been
merged differently with it. Following the stored tokens back from the end gives the ids, in time
linear in the piece's length whatever it holds.

Defined results: null and empty texts have an empty list; names of special tokens in a text are
ordinary text; there is one row per row of the input.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.session import spread

VOCABULARY = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and pairs remembered by a worker; beyond it they are worked out again.
_REMEMBER = 200_000


class PrefixEncoder:
    """BPE ids of byte strings; ``ranks`` are the vocabulary's tokens, whose ids order the merges."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.spelling = {i: b for b, i in ranks.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), (len(token), i))
        self._automaton.make_automaton()

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte or if no merges lead to it."""
        if token not in self._parts:
            whole = self.spelling[token]
            found = None
            for cut in range(1, len(whole)):
                left, right = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if left is not None and right is not None and left < token and right < token and self.stays(left, right, token) and self.reachable(left) and self.reachable(right):
                    found = (left, right)
                    break
            self._parts[token] = found
        return self._parts[token]

    def reachable(self, token: int) -> bool:
        return len(self.spelling[token]) == 1 or self.parts(token) is not None

    def _merged(self, left: int, right: int) -> int | None:
        token = self.ranks.get(self.spelling[left] + self.spelling[right])
        return token if token is not None and self.parts(token) == (left, right) else None

    def stays(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of a rank below ``limit`` crosses the border between two encoded neighbours.

        Seen backwards in time: of the two tokens at the border the one merged last is taken apart; a
        merge across the border that would have come before that is a contradiction.
        """
        while True:
            across = self.ranks.get(self.spelling[left] + self.spelling[right])
            if across is not None and across < limit and self._merged(left, right) is not None:
                return False
            later_left = left > right
            for take_left in (later_left, not later_left):
                halves = self.parts(left if take_left else right)
                if halves is None:
                    continue
                if take_left:
                    # pairs at the border from now on existed before ``left`` was merged
                    limit, left = min(limit, left), halves[1]
                else:
                    # an equal rank further left would have been merged first
                    limit, right = min(limit, right + 1), halves[0]
                break
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > _REMEMBER:
                self._fits.clear()
            known = self._fits[pair] = self.stays(left, right, 1 << 60)
        return known

    def _settle(self, last: list[int], end: int, matches: list[tuple[int, int]]) -> None:
        """Store the one token that ends the encoding of the first ``end`` bytes."""
        for length, token in sorted(matches, reverse=True):
            before = last[end - length] if end > length else None
            if before == -1 or not self.reachable(token):
                continue
            if before is None or self.compatible(before, token):
                last[end] = token
                return

    def encode(self, piece: bytes) -> list[int]:
        n = len(piece)
        last = [-1] * (n + 1)
        # matches come by the position they end at, and every byte ends one
        matches: list[tuple[int, int]] = []
        here = 0
        for at, match in self._automaton.iter(piece.decode("latin-1")):
            if at != here:
                self._settle(last, here + 1, matches)
                matches, here = [], at
            matches.append(match)
        if matches:
            self._settle(last, here + 1, matches)
        ids = []
        end = n
        while end:
            token = last[end]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(token)
            end -= len(self.spelling[token])
        ids.reverse()
        return ids


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


_encoders: dict[int, tuple[PrefixEncoder, dict[str, tuple[int, ...]]]] = {}


def _encoder(data: bytes) -> tuple[PrefixEncoder, dict]:
    """The worker's encoder of this vocabulary and the pieces it knows."""
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = (PrefixEncoder(parse_ranks(data)), {})
    return _encoders[key]


def encode_texts(texts: list[str | None], data: bytes, pattern: str = PATTERN) -> list[list[int]]:
    import regex

    encoder, known = _encoder(data)
    split = regex.compile(pattern).findall
    out = []
    for text in texts:
        ids: list[int] = []
        for piece in split(text) if text else ():
            got = known.get(piece)
            if got is None:
                got = tuple(encoder.encode(piece.encode("utf-8")))
                if len(piece) <= 64:
                    if len(known) > _REMEMBER:
                        known.clear()
                    known[piece] = got
            ids.extend(got)
        out.append(ids)
    return out


def token_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of ``documents``; the vocabulary file is read by the driver and sent to the workers (under 1 MB)."""
    spark = documents.sparkSession
    data = spark.sparkContext.broadcast(read_ranks(vocabulary or os.path.join(VOCABULARY, "byte_bpe_50k.tiktoken")))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch is cut further, so that its ids never take much more room than its texts
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = encode_texts(part.column("text").to_pylist(), data.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    rows = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, ids array<int>")
