"""Finding passages of held-out items inside documents by Wu-Manber multi-pattern search.

The patterns are all stretches of ``m`` consecutive symbols of every passage: eight words, or twelve
characters where a passage's script has no blanks between words (Han, Kana, Thai, Lao, Khmer,
Burmese). A passage shorter than that is one pattern as a whole. The search looks at blocks of B
symbols from the right end of a window: a shift table says how far the window may move when its
last block ends no pattern, a bucket of the block holds the patterns that end in it, kept apart by
the block they begin with, and those are compared with the text directly. What is found marks
positions of the passage; a document holds the passage if the marked part reaches the share asked
for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKS = regex.compile(r"\p{M}+")
_TAGS = regex.compile(r"</?[a-z][^<>]{0,200}>|&[a-z]{2,8};")
_APOSTROPHE = regex.compile(r"(?<=\p{L})['’ʼ`´](?=\p{L})")
_POINT = regex.compile(r"(?<=\d)[.,](?=\d)")
_WORDS = regex.compile(r"[\p{L}\p{N}]+")
#: Scripts written without blanks between words: there the symbols are characters.
_DENSE_CLASS = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_DENSE = regex.compile(_DENSE_CLASS)


def plain(text: str) -> str:
    """Text without case, accents and markup; what is left is cut into symbols by :func:`words`."""
    if text.isascii():
        t = text.lower()
    else:
        t = _MARKS.sub("", unicodedata.normalize("NFKD", text).casefold())
    if "<" in t or "&" in t:
        t = _TAGS.sub(" ", t)
    return _POINT.sub("", _APOSTROPHE.sub("", t))


def words(t: str) -> list[str]:
    return _WORDS.findall(t)


class Searcher:
    """Wu-Manber tables over the m-symbol stretches of passages (lists of symbols)."""

    def __init__(self, passages: list[list[str]], m: int, block: int = 3) -> None:
        self.m, self.block = m, min(block, m)
        self.code: dict[str, int] = {}
        self.passages = [[self.code.setdefault(s, len(self.code) + 1) for s in p] for p in passages]
        b = self.block
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, list[tuple[int, int]]]] = {}
        for k, p in enumerate(self.passages):
            for end in range(m, len(p) + 1):  # one pattern p[end - m:end]
                for j in range(b, m + 1):
                    at = tuple(p[end - m + j - b : end - m + j])
                    if m - j < self.shift.get(at, m - b + 1):
                        self.shift[at] = m - j
                last, first = tuple(p[end - b : end]), tuple(p[end - m : end - m + b])
                self.bucket.setdefault(last, {}).setdefault(first, []).append((k, end))

    def marks(self, symbols: list[str]) -> dict[int, int]:
        """Passage -> bit set of its positions that stand in the text in stretches of m symbols."""
        m, b, shift, bucket, passages = self.m, self.block, self.shift, self.bucket, self.passages
        get = self.code.get
        text = [get(s, 0) for s in symbols]
        far, full = m - b + 1, (1 << m) - 1
        found: dict[int, int] = {}
        i, n = m, len(text)
        while i <= n:
            if not text[i - 1]:  # a symbol of no passage: no window over it can match
                i += m
                continue
            last = tuple(text[i - b : i])
            step = shift.get(last, far)
            if step:
                i += step
                continue
            for k, end in bucket[last].get(tuple(text[i - m : i - m + b]), ()):
                if passages[k][end - m : end] == text[i - m : i]:
                    found[k] = found.get(k, 0) | full << (end - m)
            i += 1
        return found


def by_character(symbols: list[str]) -> bool:
    """Whether most characters of a passage belong to scripts without blanks between words."""
    text = "".join(symbols)
    return 2 * len(_DENSE.findall(text)) > len(text)


class ItemSearch:
    """Searches by words and by characters over one block of items, for each length of pattern."""

    def __init__(self, items: list[tuple[int, str]], m_words: int, m_chars: int) -> None:
        groups: dict[tuple[bool, int], list[tuple[int, list[str]]]] = {}
        for i, p in items:
            symbols = words(plain(p))
            dense = by_character(symbols)
            symbols = list("".join(symbols)) if dense else symbols
            if symbols:
                m = min(m_chars if dense else m_words, len(symbols))
                groups.setdefault((dense, m), []).append((i, symbols))
        self.sides = [(dense, [i for i, _ in x], [len(p) for _, p in x], Searcher([p for _, p in x], m)) for (dense, m), x in sorted(groups.items())]
        self.dense = any(side[0] for side in self.sides)

    def __call__(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, symbols of its passage found, symbols of its passage) for each item found at all."""
        w = words(plain(text))
        chars = list("".join(w)) if self.dense and _DENSE.search(text) else None
        for dense, ids, lengths, searcher in self.sides:
            if dense and chars is None:
                continue
            for k, bits in searcher.marks(chars if dense else w).items():
                yield ids[k], bits.bit_count(), lengths[k]


_DDL = "item_id bigint, doc_id bigint, found bigint, length bigint"
_SCHEMA = pa.schema([(c, pa.int64()) for c in ("item_id", "doc_id", "found", "length")])


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    min_share: float = 0.5,
    stretch_words: int = 8,
    stretch_chars: int = 12,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """Pairs of an item and a document that holds at least ``min_share`` of the item's passage.

    Returns ``item_id, doc_id, found, length``: how many words (characters, in scripts without
    blanks between words) of the passage stand in the document in stretches of at least
    ``stretch_words`` (``stretch_chars``) consecutive ones, and how many it has. With ``min_share``
    0 every document that holds one stretch of a passage comes out. Case, accents, punctuation,
    markup and line breaks don't count; an apostrophe inside a word and a point inside a number
    don't part it. Which of the two a passage is searched by goes by its own letters, not by a
    label.

    Null, empty and blank texts hold nothing, and a null passage or one without letters and digits
    is in no document. A passage shorter than a stretch is looked for as a whole. Repeated
    documents each come out; items with the same id come out once each. Empty tables give no rows;
    only the named columns are read.

    Every document is read whole, once for each block of items. A block holds at most
    ``block_chars`` characters of passages (or one longer passage), so its tables are bounded; they
    are made once and broadcast. There is no exchange and no comparison of documents with each
    other.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    want = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(passage).cast("string").alias("passage")).where("passage is not null")
    shared = d.sparkSession.sparkContext

    def search(block: list[tuple[int, str]]) -> DataFrame:
        tables = shared.broadcast(ItemSearch(block, stretch_words, stretch_chars))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = tables.value
            for b in batches:
                rows = [
                    (item, key, found, length)
                    for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                    for item, found, length in find(t)
                    if found >= min_share * length
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], schema=_SCHEMA)

        return d.mapInArrow(run, _DDL)

    out = None
    for block in _blocks(want, block_chars):
        part = search(block)
        out = part if out is None else out.unionByName(part)
    return search([]) if out is None else out


def _blocks(want: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, one block on the driver at a time."""
    parts = max(1, -(-(want.agg(F.sum(F.length("passage"))).first()[0] or 0) // block_chars))
    for k in range(parts):
        mine = want if parts == 1 else want.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(parts)) == k)
        block, held = [], 0
        for r in mine.toLocalIterator():  # hash parts differ in size: a part above the bound is cut
            if block and held + len(r.passage) > block_chars:
                yield block
                block, held = [], 0
            block.append((r.item_id, r.passage))
            held += len(r.passage)
        if block:
            yield block
