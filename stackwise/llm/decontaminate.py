"""Benchmark decontamination by greedy string tiling.

Benchmark items are taken in blocks of a bounded number of tokens; each block's token seeds
(Karp-Rabin hashes of ``min_tile`` tokens) go to the executors as one sorted array, and every
document is scanned whole against it, without a shuffle.  A worker reads documents once for up to
``HELD_BLOCKS`` blocks.  For each document and item that share seeds, which are verified token by
token with other hashes, the tiling repeatedly marks the longest match of unmarked tokens; the share
of the item's tokens in tiles is its coverage, so reordered passages count as fully as verbatim ones.
Where a seed that many items have would make too many hits at once, the items are taken in halves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, without
from .kernels import U64, Words, lean, rolling, slices, window_starts

MIN_TILE, THRESHOLD = 5, 0.8
BLOCK_TOKENS, HELD_BLOCKS, MOST_HITS = 2_000_000, 4, 4_000_000
_FILTER_BITS = 22
_NOT_WORD = re.compile(r"[\W_]+")
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def _tokens(column: pa.Array) -> Words:
    """Tokens: runs of letters and digits of the lower-cased text; nulls have none."""
    texts = []
    for text in column.to_pylist():
        text = (text or "").lower()
        texts.append(text.encode().translate(_FOLD) if text.isascii() else _NOT_WORD.sub(" ", text).encode())
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)


class _Block:
    """The seeds of some items, sorted by hash; ``tokens`` are second hashes of all their tokens."""

    def __init__(self, items: list, sizes: np.ndarray, first: np.ndarray, tokens: np.ndarray, h: np.ndarray, item: np.ndarray, place: np.ndarray):
        self.items, self.sizes, self.first, self.tokens = items, sizes, first, tokens
        self.h, self.item, self.place = h, item, place
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(h >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.parts: list[_Block] = []

    @classmethod
    def of(cls, items: list, texts: list, min_tile: int) -> _Block:
        words = _tokens(pa.array(texts, pa.string()))
        start, item = window_starts(words.first, min_tile)
        h = rolling(words.hashes(1), min_tile)[start]
        order = np.argsort(h, kind="stable")
        return cls(items, words.counts, words.first[:-1], words.hashes(2), h[order], item[order].astype(np.int32), (start - words.first[item])[order].astype(np.int32))

    def halves(self) -> list[_Block]:
        """The seeds of the first and of the second half of the items that have any."""
        if not self.parts:
            own = np.unique(self.item)
            low = self.item < own[len(own) // 2]
            self.parts = [_Block(self.items, self.sizes, self.first, self.tokens, self.h[x], self.item[x], self.place[x]) for x in (low, ~low)]
        return self.parts

    def hits(self, h: np.ndarray) -> Iterator[tuple[_Block, np.ndarray, np.ndarray]]:
        """(block, index into ``h``, index into its seeds) of all equal hashes, all hits of an item
        together."""
        maybe = np.flatnonzero(self.filter[(h >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.h, h[maybe], "left"), np.searchsorted(self.h, h[maybe], "right")
        n = high - low
        if n.sum() > MOST_HITS and self.item.min() < self.item.max():
            for part in self.halves():
                yield from part.hits(h)
        elif n.sum():
            seed = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            yield self, np.repeat(maybe, n), seed


def _blocks(benchmark: DataFrame, item_id: str, text: str, min_tile: int) -> Iterator[_Block]:
    items = benchmark.select(F.col(quoted(item_id)).alias("i"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("t"))
    size = F.size(F.split("t", r"[^\p{L}\p{N}]+")).cast("long")
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = -(-total // BLOCK_TOKENS)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()  # of bounded size
        yield _Block.of([r.i for r in rows], [r.t for r in rows], min_tile)


def _tiles(place: np.ndarray, at: np.ndarray, min_tile: int, tokens: int) -> tuple[int, int]:
    """(tokens in tiles, tiles) of greedy tiling.  ``place`` and ``at`` are starts in the item and
    in the document of all equal windows of ``min_tile`` tokens; on one diagonal, consecutive ones
    make up a maximal match.  Longest first; of equal ones the first in the item, then document."""
    order = np.lexsort((place, at - place))
    place, at = place[order].astype(np.int64), at[order].astype(np.int64)
    used_item, used_doc = np.zeros(tokens, dtype=bool), set()
    covered = tiles = 0
    while len(place):
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(at - place) != 0) | (np.diff(place) != 1)]))
        length = np.diff(np.append(opens, len(place))) + min_tile - 1
        longest = length.max()
        best = opens[length == longest]
        for k in best[np.lexsort((at[best], place[best]))]:
            own, other = range(place[k], place[k] + longest), range(at[k], at[k] + longest)
            if not used_item[own.start : own.stop].any() and used_doc.isdisjoint(other):
                used_item[own.start : own.stop] = True
                used_doc.update(other)
                covered, tiles = covered + int(longest), tiles + 1
        sums = np.concatenate([[0], np.cumsum(used_item)])
        free = sums[place + min_tile] == sums[place]
        doc = np.fromiter(used_doc, dtype=np.int64, count=len(used_doc))
        doc.sort()
        free &= np.searchsorted(doc, at + min_tile) == np.searchsorted(doc, at)
        place, at = place[free], at[free]
    return covered, tiles


def contamination(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``docs`` with ``matches``: an array of (item, coverage, n_matched, n_tiles) of the items of
    which ``threshold`` or more of the tokens lie in tiles of ``min_tile`` or more tokens.

    Items of fewer than ``min_tile`` tokens can't make a tile and match nothing, as do null and
    empty texts of either side.  Repeated items and rows each count.  A column ``matches`` of the
    input is replaced.  An empty benchmark gives empty arrays, no documents give no rows.
    """
    docs = without(docs, "matches")
    kind = benchmark.schema[item_id].dataType.simpleString()
    found = docs.withColumn("matches", F.expr(f"CAST(array() AS array<struct<item:{kind},coverage:double,n_matched:int,n_tiles:int>>)"))
    held: list = []
    for block in chain(_blocks(benchmark, item_id, text, min_tile), [None]):
        if block is not None:
            held.append(docs.sparkSession.sparkContext.broadcast(block))
        if held and (block is None or len(held) == HELD_BLOCKS):
            found = found.mapInArrow(lean(_scan(held, text, min_tile, threshold)), found.schema)
            held = []
    return found


def _scan(shared: list, text: str, min_tile: int, threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=text):
            words = _tokens(part.column(part.schema.get_field_index(text)).cast(pa.string()))
            start, doc = window_starts(words.first, min_tile)
            found: dict[int, list] = {}
            if len(start):
                h, second = rolling(words.hashes(1), min_tile)[start], words.hashes(2)
                for block in shared:
                    for own, at, seed in block.value.hits(h):
                        same = np.ones(len(at), dtype=bool)
                        there = own.first[own.item[seed]] + own.place[seed]
                        for k in range(min_tile):
                            same &= second[start[at] + k] == own.tokens[there + k]
                        at, seed = at[same], seed[same]
                        _match(own, doc[at], (start - words.first[doc])[at], seed, min_tile, threshold, found)
            last = part.schema.get_field_index("matches")
            old = part.column(last)
            if found:
                own = old.to_pylist()
                for d, more in found.items():
                    own[d] = (own[d] or []) + more
                old = pa.array(own, part.schema.field(last).type)
            yield pa.RecordBatch.from_arrays([old if i == last else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return work


def _match(block: _Block, doc: np.ndarray, at: np.ndarray, seed: np.ndarray, min_tile: int, threshold: float, found: dict) -> None:
    if not len(doc):
        return
    item, place = block.item[seed].astype(np.int64), block.place[seed].astype(np.int64)
    pair = doc * len(block.items) + item
    order = np.lexsort((place, pair))
    pair, item, place, at, doc = (x[order] for x in (pair, item, place, at, doc))
    opens = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    # Tokens that any seed touches bound the coverage; most pairs end here.
    new = np.where(np.concatenate([[True], pair[1:] != pair[:-1]]), min_tile, np.minimum(np.diff(place, prepend=0), min_tile))
    most = np.add.reduceat(new, opens)
    ends = np.append(opens[1:], len(pair))
    for k in np.flatnonzero(most >= threshold * block.sizes[item[opens]]):
        i, cut = item[opens[k]], slice(opens[k], ends[k])
        size = int(block.sizes[i])
        covered, tiles = _tiles(place[cut], at[cut], min_tile, size)
        if covered >= threshold * size:
            found.setdefault(int(doc[opens[k]]), []).append({"item": block.items[i], "coverage": covered / size, "n_matched": covered, "n_tiles": tiles})


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc id, item id, coverage, n_matched, n_tiles) of each contaminated document and item."""
    found = contamination(docs.select(quoted(doc_id), quoted(text)), benchmark, min_tile, threshold, item_id, text)
    each = found.select(F.col(quoted(doc_id)), F.explode("matches").alias("m"))
    return each.select(quoted(doc_id), F.col("m.item").alias(item_id), "m.coverage", "m.n_matched", "m.n_tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that no item contaminates, with their columns as they were (a column named
    ``matches`` keeps its place)."""
    names = docs.columns
    inner = docs.select(*[F.col(quoted(c)).alias(f"c{i}" if c != text else text) for i, c in enumerate(names)])
    clean = contamination(inner, benchmark, min_tile, threshold, item_id, text).filter(F.size("matches") == 0)
    return clean.select(*[F.col(f"c{i}" if c != text else quoted(text)).alias(c) for i, c in enumerate(names)])
