"""Keyword piles, link lists and tag lists among documents.

First the words of sentences are learned from all documents: words that are common and mostly stand in
well-formed sentences (function words, and what else only prose uses), in whatever languages the corpus
has. Then a text is read as a stream of terms (words, links, hashtags). Terms that recur at short,
regular gaps or repeat the stream at some lag are repetition; long rows of short items, or long runs of
distinct terms, without words of sentences are lists. A document is spam if most of its terms are one
or the other. In a language the corpus does not tell enough of, a sentence is known by its form and by
words that are not the ones repeated all over the document. Machine output (logs, tables, code, records,
field listings) is recognised line by line and counts as neither.

Defined results: null and empty texts, and texts under ``LEAST`` terms (too few for a row of items or a
third recurrence), are never spam; every row is judged by its own whole text; rows that repeat a doc_id
give it once if any of them is spam; texts of scripts without spaces are read by pairs of characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, spread

_LINK = r"(?:https?://|www\.)[^\s<>\"')\]]+"
_SPLIT = r"[,;:/|•·»›>、،؛\t\"()\[\]{}&*]+|\s[-–—]\s"
_END = r"[.!?]+(?=[\s\"')\]]|$)|[。।؟…]+"
#: Links, hashtags, words, sentence endings, and what separates the items of a list.
_TERMS = re.compile(rf"{_LINK}|#\w+|[^\W_]+(?:['’][^\W_]+)?|{_END}|{_SPLIT}").findall
#: The same for lines without links and hashtags.
_PLAIN_TERMS = re.compile(rf"[^\W_]+(?:['’][^\W_]+)?|{_END}|{_SPLIT}").findall
#: A well-formed sentence: from a capital or a letter without case to its end, without what separates items.
_SENTENCES = re.compile(r"(?:^(?:[ \t>*+#-]|\d+[.)])*|(?<=[.!?。:]\s))[¿¡]?[^\W\d_a-zß-öø-ÿ](?:[^.!?。|/>•»;{}\[\]<=\n]|\.(?=\w))*[.!?。]+(?=\s|$)", re.MULTILINE).finditer
_LETTERS = re.compile(r"[^\W\d_]+").findall
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]{30,}")
_PAIRS = re.compile(r"..?", re.DOTALL).findall
#: Vowel signs and marks that are no letters, so that they would cut words.
_SIGNS = re.compile(r"[\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0962\u0963\u0981-\u0983\u09bc-\u09cd\u0b82\u0bbe-\u0bcd\u0e31\u0e34-\u0e4e]+")
_PLAIN_LINK = re.compile(_LINK)
_SENTENCE_END = 1_000_000  # items on either side of one are no neighbours
_MARKUP = re.compile(r"<(?!https?:)/?[A-Za-z!][^<>]*>")
_HREF = re.compile(rf"(?:href|src)\s*=\s*[\"']?({_LINK})", re.IGNORECASE)
_MACHINE = re.compile(
    r"""^\s*(?:
        \[?\d{4}-\d\d-\d\d[T\s]\d\d:\d\d                 # log line
      | (?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b
      | \S*[.$\[\]]\S*(?:\s+\S+){1,3}\s+\d+\s*$          # a path or name with what was found at it
      | \$\s.*\d\s*$
      | (?:def|class|return|import|from|for|while|if|elif|else|try|except|with|const|let|var|function|public|private|static|void|select|insert|update|create)\b.*[:;{}()\]]\s*$
      | [\w.\[\]'"]+\s*(?:=|\+=|-=|:=)\s*\S
      | [\w.]+\([^)]*\).*$                              # a call
      | (?:return|import|from)\s\S+.*
      | [\]\[{}(),;\s]+$
      | "[^"\\]*"\s*:\s*(?!\[.)                          # a field of a record on its own line
    )""",
    re.VERBOSE,
)
_KEY = re.compile(r"\"(?:[^\"\\]|\\.)*\"\s*:")
_TOKEN = re.compile(r"[^\W_]+").findall
_DIGIT = re.compile(r"\d").search

#: Terms to either side within which recurrences count, and how many there must be.
GAP_WINDOW, RECURRENCES = 24, 3
#: Lags tried, terms a lag window has, and the share of content terms equal at one lag that makes it periodic.
LAGS, LAG_WINDOW, PERIODIC = 40, 80, 0.6
#: Share of words of sentences from which a passage reads as sentences; the number of different content terms, by
#: content terms, up to which it counts as repetition all the same; the share of them that must recur.
SENTENCES, VOCABULARY, REPEATED = 0.15, 0.45, 0.4
#: Terms in a row without a word of sentences or a sentence ending that make a list; short items in a row, with no sentence ending
#: between them, that do, their terms at most, and the share of words of sentences among them at most.
LIST_RUN, LIST_ITEMS, ITEM_TERMS, ITEM_PLAIN = 30, 8, 6, 0.35
#: Share of a document's terms that makes it spam, and the least terms a document must have.
SHARE, LEAST = 0.5, 8
#: A word of sentences: occurrences in sentences by document of the corpus, and their share of all its occurrences, at least.
COMMON, IN_SENTENCES = 0.002, 0.85
#: Words a sentence known by its form has at least, words an item in it has at least, and the share of its words that may be repeated all over the document.
SENTENCE_WORDS, PER_ITEM, SENTENCE_REPEATS = 4, 3, 0.4
#: Share of words that are no words of sentences under which a text is neither repetition nor list.
FEW_OTHERS = 0.3
#: The same for words that recur or stand in lines of few words of sentences.
FEW_MARKED = 0.3


def machine_line(line: str, words: list[str]) -> bool:
    """Whether a line is output of a program rather than text; ``words`` are those outside of links."""
    if _MACHINE.match(line):
        return True
    n = len(words)
    if '"' in line and (keys := len(_KEY.findall(line))) and n <= 9 * keys:
        return True
    numbers = n - sum(map(str.isalpha, words))
    if not numbers:
        return False
    numbers = sum(_DIGIT(w) is not None for w in words) if numbers * 2 > n or line.count(",") > 1 else 0
    if numbers and line.count(",") > 1:
        cells = line.strip().split(",")
        if len(line) <= 30 * len(cells) and (" " not in line.strip() or sum(c.strip()[:1].isdigit() for c in cells) * 2 >= len(cells)):
            return True
    return numbers * 2 > n > 3 or 0 < numbers == n


def _pairs(run: re.Match[str]) -> str:
    """A long run of a script without spaces as pairs of characters; one character over and over is no words."""
    return " ".join(_PAIRS(run.group())) if len(set(run.group())) > 2 else run.group()


def _normal(text: str) -> str:
    return text if text.isascii() else _UNSPACED.sub(_pairs, _SIGNS.sub("", unicodedata.normalize("NFKC", text)))


def count_words(texts: list[str]) -> dict[str, list[int]]:
    """Occurrences of each word in the texts, and in their well-formed sentences."""
    apart: Counter[str] = Counter()
    within: Counter[str] = Counter()
    for text in texts:
        text = _normal(text)
        spans = [m.span() for m in _SENTENCES(text)]
        within.update(_LETTERS(" ".join([text[a:b] for a, b in spans]).lower()))
        rest = zip([0, *(end for _, end in spans)], [*(begin for begin, _ in spans), len(text)])
        apart.update(_LETTERS(" ".join([text[a:b] for a, b in rest]).lower()))
    return {w: [apart[w] + within[w], within[w]] for w in apart | within}


def lines_of(text: str) -> list[tuple[str, list[str], bool]]:
    """The lines of a text, each with its words and whether it is machine output."""
    text = _normal(text)
    text = _MARKUP.sub(" | ", _HREF.sub(r">\1<", text)) if "<" in text else text
    out = []
    for line in text.splitlines():
        words = _TOKEN(line.lower())
        bare = _TOKEN(_PLAIN_LINK.sub(" ", line)) if words and ("://" in line or "www." in line) else words
        out.append((line, words, bool(words) and machine_line(line, bare)))
    return out


def terms_of(lines: list[tuple[str, list[str], bool]], prose: frozenset[str] = frozenset()) -> tuple[list[str], list[bool], list[int]]:
    """The terms of a text, whether each is a word of sentences, and the item (of a list, or clause) it is in.

    Terms of machine output are empty.
    """
    terms: list[str] = []
    plain: list[bool] = []
    items: list[int] = []
    #: sentences by their form: first and last term
    formed: list[tuple[int, int]] = []
    item = 0
    for line, words, machine in lines:
        item += 1
        if not words:
            continue
        if machine:
            n = len(words)
            terms += [""] * n
            plain += [True] * n
            items += [item] * n
            continue
        start, first_item, small = len(terms), item, 0
        for shown in (_TERMS if "://" in line or "www." in line or "#" in line else _PLAIN_TERMS)(line):
            first = shown[0]
            if first.isalnum():
                if "://" in shown or shown.startswith("www."):
                    item += 1
                    n = max(1, len(_TOKEN(shown)) - shown.startswith("http"))
                    terms += ["://"] * n
                    plain += [False] * n
                    items += [item] * n
                    item += 1
                else:
                    if not first.isupper():
                        small += 1
                        if len(terms) == start and first.islower():
                            small -= _SENTENCE_END  # begins with a small letter
                    word = shown.lower()
                    terms.append(word)
                    plain.append(word in prose or "'" in word or "\u2019" in word)
                    items.append(item)
            elif first == "#" and len(shown) > 1:
                terms.append(shown.lower())
                plain.append(False)
                items.append(item)
                item += 1
            elif first in ".!?。।؟…":
                n = len(terms) - start
                if n >= SENTENCE_WORDS and (item - first_item) * PER_ITEM <= n and small * 10 >= 4 * n and not any(plain[start:]):
                    formed.append((start, start + n))
                item += _SENTENCE_END
                start, first_item, small = len(terms), item, 0
            else:
                item += 1
    if formed:
        _keep_sentences(terms, plain, formed)
    return terms, plain, items


def _keep_sentences(terms: list[str], plain: list[bool], formed: list[tuple[int, int]]) -> None:
    """Make the terms of sentences known by their form words of sentences, unless they are what the document repeats."""
    counts: Counter[str] = Counter()
    once = set()
    at = 0
    for begin, end in formed:
        counts.update(terms[at:begin])
        sentence = tuple(terms[begin:end])
        if sentence not in once:  # a sentence said again repeats no keywords
            once.add(sentence)
            counts.update(sentence)
        at = end
    counts.update(terms[at:])
    for begin, end in formed:
        if sum(counts[t] >= RECURRENCES for t in terms[begin:end]) <= SENTENCE_REPEATS * (end - begin):
            plain[begin:end] = [True] * (end - begin)


def recurring(terms: list[str], plain: list[bool]) -> list[bool]:
    """Content terms that occur ``RECURRENCES`` times at short gaps around them."""
    places = defaultdict(list)
    for i, t in enumerate(terms):
        if not plain[i]:
            places[t].append(i)
    marked = [False] * len(terms)
    for at in places.values():
        for j in range(len(at) - RECURRENCES + 1):
            if at[j + RECURRENCES - 1] - at[j] <= 2 * GAP_WINDOW:
                for i in at[j : j + RECURRENCES]:
                    marked[i] = True
    return marked


def periodic(terms: list[str], plain: list[bool]) -> list[bool]:
    """Terms in lag windows where the autocorrelation of the content terms peaks at some lag.

    Equal terms at a lag are counted from the gaps between recurrences, so a text without them costs one pass.
    """
    n = len(terms)
    marked = [False] * n
    half = LAG_WINDOW // 2
    equal: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))  # by window and lag
    last: dict[str, list[int]] = {}
    for j, t in enumerate(terms):
        if plain[j]:
            continue
        at = last.setdefault(t, [])
        for i in reversed(at):
            if j - i > LAGS:
                break
            for window in (i // half - 1, i // half):
                if window >= 0 and j < window * half + LAG_WINDOW:
                    equal[window][j - i] += 1
        at.append(j)
    if not equal:
        return marked
    content = _sums([not p for p in plain])
    words = _sums([t != "" for t in terms])
    for window, lags in equal.items():
        begin, end = window * half, min(n, window * half + LAG_WINDOW)
        size = end - begin
        if size < LEAST or (content[end] - content[begin]) * 2 < size or (words[end] - words[begin]) * 2 < size:
            continue
        for lag, same in lags.items():
            if lag <= size // 2 and same >= max(PERIODIC * (content[end - lag] - content[begin]), LEAST // 4):
                marked[begin:end] = [t != "" for t in terms[begin:end]]
                break
    return marked


def listed(terms: list[str], plain: list[bool], items: list[int]) -> list[bool]:
    """Terms in long runs without words of sentences, and in long rows of short items."""
    n = len(terms)
    marked = [False] * n
    begin = 0
    for i in range(n + 1):
        if i == n or plain[i] or (i and items[i] - items[i - 1] >= _SENTENCE_END):
            if i - begin >= LIST_RUN:
                marked[begin:i] = [True] * (i - begin)
            begin = i + (i < n and plain[i])
    starts = [i for i in range(n) if i == 0 or items[i] != items[i - 1]] + [n]
    row: list[tuple[int, int]] = []
    for a, b in [*zip(starts, starts[1:]), (n, n)]:
        short = a < b and b - a <= ITEM_TERMS and terms[a] != ""
        if short and (not row or items[a] - items[a - 1] < _SENTENCE_END):
            row.append((a, b))
            continue
        if len(row) >= LIST_ITEMS:
            first, last = row[0][0], row[-1][1]
            bare = sum(all(plain[x:y]) for x, y in row)
            if bare * 10 <= len(row) and sum(plain[first:last]) <= ITEM_PLAIN * (last - first):
                marked[first:last] = [True] * (last - first)
        row = [(a, b)] if short else []
    return marked


def vocabulary(terms: list[str], plain: list[bool]) -> list[int]:
    """The number of different content terms around each term."""
    n = len(terms)
    counts: dict[str, int] = {}
    out = []
    for i in range(-GAP_WINDOW, n):
        if i + GAP_WINDOW < n and not plain[i + GAP_WINDOW]:
            t = terms[i + GAP_WINDOW]
            counts[t] = counts.get(t, 0) + 1
        if i > GAP_WINDOW and not plain[i - GAP_WINDOW - 1]:
            t = terms[i - GAP_WINDOW - 1]
            counts[t] -= 1
            if not counts[t]:
                del counts[t]
        if i >= 0:
            out.append(len(counts))
    return out


def _sums(flags: list[bool]) -> list[int]:
    return [0, *accumulate(flags)]


def spam_share(text: str | None, prose: frozenset[str] = frozenset()) -> float:
    """The share of a text's terms that are repetition or list; ``prose`` are the corpus' words of sentences."""
    if not text:
        return 0.0
    lines = lines_of(text)
    n = listed_words = 0
    others: Counter[str] = Counter()
    for line, words, machine in lines:
        n += len(words)
        if not machine:
            own = [w for w in words if w not in prose]
            others.update(own)
            if len(own) >= (1 - ITEM_PLAIN) * len(words):
                listed_words += len(words)
    again = sum([c for c in others.values() if c >= RECURRENCES])
    if n < LEAST or others.total() < FEW_OTHERS * n or again + listed_words < FEW_MARKED * n:
        return 0.0
    terms, plain, items = terms_of(lines, prose)
    n = len(terms)
    if n < LEAST:
        return 0.0
    again = [a or b for a, b in zip(recurring(terms, plain), periodic(terms, plain))]
    marked = listed(terms, plain, items)
    if not any(again) and not any(marked):
        return 0.0
    content = _sums([not p for p in plain])
    words = _sums([t != "" for t in terms])
    repeats = _sums([a and not p for a, p in zip(again, plain)])
    different = vocabulary(terms, plain)
    for i in range(n):
        if again[i] and not marked[i]:
            lo, hi = max(0, i - GAP_WINDOW), min(n, i + GAP_WINDOW + 1)
            around = content[hi] - content[lo]
            sentences = words[hi] - words[lo] - around > SENTENCES * (words[hi] - words[lo])
            marked[i] = repeats[hi] - repeats[lo] >= REPEATED * around and (not sentences or different[i] <= VOCABULARY * around)
    # what stands between marked terms (names beside keywords, words of sentences in a stuffed phrase) belongs to them
    hits = _sums([m and not p for m, p in zip(marked, plain)])
    total = 0
    for i in range(n):
        if terms[i]:
            lo, hi = max(0, i - 6), min(n, i + 7)
            near = hits[hi] - hits[lo]
            total += marked[i] or near * 10 >= max(6 * (content[hi] - content[lo]), 4 * (hi - lo))
    return total / n


def prose_words(documents: DataFrame, text: str = "text") -> list[str]:
    """The words of sentences of a corpus, counted over all its texts.

    Each has at least ``COMMON`` occurrences in sentences by document, so there are at most 1 / COMMON
    times as many as a document has words on average, whatever the number of documents.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("within", pa.int64()), ("texts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = count_words(texts)
            rows = [("", 0, 0, len(texts)), *((w, n, k, 0) for w, (n, k) in counts.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    rows = documents.select(documents[text].cast("string").alias("text")).where("text is not null")
    counted = spread(rows).mapInArrow(run, "word string, n bigint, within bigint, texts bigint")
    # read twice, as large as the vocabulary
    counted = cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("within").alias("within"), F.sum("texts").alias("texts")))
    common = counted.where((F.col("texts") > 0) | ((F.col("within") >= 2) & (F.col("within") >= IN_SENTENCES * F.col("n"))))
    # the one row of the number of texts is joined to every word
    texts = counted.where("word = ''").select(F.col("texts").alias("of"))
    return [r.word for r in common.join(F.broadcast(texts)).where(F.col("within") >= COMMON * F.col("of")).select("word").collect() if r.word]


def spam_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id) of the documents most of whose terms are repeated keywords or lists."""
    schema = pa.schema([("doc_id", pa.int64())])
    prose = documents.sparkSession.sparkContext.broadcast(frozenset(prose_words(documents, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [d for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if spam_share(t, prose.value) > share]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], schema=schema)

    rows = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].cast("string").alias("text"))
    return spread(rows.where("doc_id is not null and text is not null")).mapInArrow(run, "doc_id bigint").distinct()
