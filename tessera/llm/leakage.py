"""Evaluation texts leaking into training text.

All windows of ``words`` consecutive words of the test items are the patterns of one Wu-Manber search
over the words of each document: a table tells for each block of two words how far the search may
jump because no window could end sooner, blocks that may end a window select the bucket of places in
the items where one with that suffix ends, and those are compared with the document word by word.

Defined results: null and empty texts and items match nothing, nor do items of fewer words; a document
and an item are reported once; rows that repeat a doc_id or an item_id count as one.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.session import cut_lineage, spread

#: Characters that show nothing (soft hyphen, zero-width, joiners, direction marks, byte-order mark).
INVISIBLE = dict.fromkeys([0x00AD, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF])
_ASCII_WORDS = re.compile(r"[a-z0-9]+").findall
_WORDS = re.compile(r"[^\W_]+").findall
WINDOW = 13
_BLOCK = 2
#: Windows compiled into one search (under 150 bytes each, measured); more items are searched for in further passes.
WINDOWS = 400_000
#: Windows of one piece of an item; a longer item is cut into pieces that overlap by a window less one word.
_PIECE = 2_000


def words_of(text: str | None) -> list[str]:
    """The words of a text without regard to dress: compatibility forms, invisible characters, accents, case."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORDS(text.lower())
    text = unicodedata.normalize("NFKC", text).translate(INVISIBLE)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if c.isascii() or unicodedata.category(c)[0] != "M")
    return _WORDS(text.lower())


class WindowSearch:
    """Wu-Manber over words instead of characters; every pattern has ``size`` words.

    ``steps`` has for each block of two words what follows from finding it at the end of the search
    window: how far to jump (above 0), or the places windows end at (minus the place less 1 if there is
    but one, else a list). Items are kept once, as one row of word numbers.
    """

    def __init__(self, items: list[tuple[int, str | list[str] | None]], size: int = WINDOW) -> None:
        self.size = size
        self.number: dict[str, int] = {}
        self.words, self.ends, self.owners = array("i"), array("q"), array("q")
        self.steps: dict[int, int | list[int]] = {}
        number, steps = self.number, self.steps
        for item, text in items:
            words = text if isinstance(text, list) else words_of(text)
            if len(words) < size:
                continue
            ids = [number.setdefault(w, len(number) + 1) for w in words]
            start = len(self.words)
            self.words.extend(ids)
            self.ends.append(len(self.words))
            self.owners.append(item)
            for at in range(_BLOCK - 1, len(ids)):
                block = ids[at - 1] << 32 | ids[at]
                known = steps.get(block)
                if at < size - 1:  # no window ends here; the first one does size - 1 - at further on
                    if known is None or (type(known) is int and known > size - 1 - at):
                        steps[block] = size - 1 - at
                elif known is None or (type(known) is int and known > 0):
                    steps[block] = -(start + at) - 1
                elif type(known) is int:
                    steps[block] = [-known - 1, start + at]
                else:
                    known.append(start + at)

    def find(self, text: str | None) -> set[int]:
        """The items that share a window with the text."""
        words = words_of(text)
        size, number, steps = self.size, self.number, self.steps
        if len(words) < size:
            return set()
        ids = [number.get(w, 0) for w in words]
        found: set[int] = set()
        at, n, far = size - 1, len(ids), size - _BLOCK + 1
        while at < n:
            last = ids[at]
            if not last:  # a word of no item: no window holds it
                at += size
                continue
            step = steps.get(ids[at - 1] << 32 | last, far)
            if type(step) is int and step > 0:
                at += step
                continue
            here = array("i", ids[at - size + 1 : at + 1])
            for end in [-step - 1] if type(step) is int else step:
                if self.words[end - size + 1 : end + 1] == here:
                    found.add(self.owners[bisect_right(self.ends, end)])
            at += 1
        return found


def _pieces(window: int):
    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[list[str]]:
            words = words_of(text)
            return [words[at : at + _PIECE + window - 1] for at in range(0, len(words) - window + 1, _PIECE)]

        return texts.map(one)

    return cut


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, windows: int = WINDOWS) -> DataFrame:
    """(doc_id, item_id) of each document that shares ``window`` consecutive words with an item.

    The items' windows are counted first; blocks of about ``windows`` of them are searched for in one
    pass over the documents each, so neither the driver nor a worker ever holds more than one block.
    Documents are not shuffled.
    """
    spark = documents.sparkSession
    items = items.select(items[item_id].cast("bigint").alias("item_id"), items[text].cast("string").alias("text")).where("item_id is not null and text is not null")
    pieces = items.select("item_id", F.posexplode(_pieces(window)("text")).alias("piece", "words"))
    docs = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text")).where("doc_id is not null and text is not null")
    total = pieces.agg(F.sum(F.size("words") - (window - 1))).first()[0] or 0
    blocks = 1 + total // windows
    block_of = F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks))
    passes = []
    for block in range(blocks):
        own = spark.sparkContext.broadcast([(r.item_id, list(r.words)) for r in pieces.where(block_of == block).select("item_id", "words").collect()])
        found = _search(docs, own, window)
        if blocks > 1:
            found = cut_lineage(found)
            own.destroy()
        passes.append(found)
    # few rows are left; only rows that repeat a doc_id, or pieces of one item, give equal ones
    return reduce(DataFrame.unionByName, passes).distinct()


_compiled: dict[str, WindowSearch] = {}


def _search_of(key: str, items, window: int) -> WindowSearch:
    """The worker's search of this block; compiled once, and the one before it let go."""
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = WindowSearch(items.value, window)
    return _compiled[key]


def _search(docs: DataFrame, items, window: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search_of(key, items, window)
        for batch in batches:
            rows = [(d, i) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i in search.find(t)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([i for _, i in rows], pa.int64())], schema=schema)

    return spread(docs).mapInArrow(run, "doc_id bigint, item_id bigint")
