"""SimHash near-duplicates found with pivot distance tables.

Documents become 64-bit fingerprints; equal fingerprints are one class from then on.  Two different
fingerprints within ``RADIUS`` bits agree on at least one of four bit blocks, so each class is dealt
out under its four blocks and no pair is lost.  Within such a cell the distances of every fingerprint
to ``PIVOTS`` reference fingerprints are tabulated once; rows are ordered by the first coordinate,
pairs whose coordinates differ by more than the radius anywhere are discarded (triangle inequality),
and survivors are verified bit by bit.  A cell of many fingerprints is split by its free bits in the
same way before pairs are formed.  Each task contracts what it links, so a dense group leaves it as
a tree, not as pairs; the trees are joined into components by alternating star contractions.

``keep_one`` works at a similarity instead of a few bits.  Fingerprints of eight words are dealt out
under 24 blocks of 14 bits, pairs of a cell are kept by the distance of all their words, and what is
kept is verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, quoted, release, without
from .kernels import U64, lean, mix, text_buffers
from .spans import BROADCAST_CHARS, broadcast_if_small

RADIUS = 3
PIVOTS = 24
CELL = 2048
#: ``keep_one``: words of a fingerprint, all of which cells compare; its blocks, of which each makes a
#: cell, and their bits; candidates that a member of a dense cell has at first, and in which blocks.
WORDS, BLOCKS, BLOCK_BITS = 8, 24, 14
PARTNERS, PARTNER_BLOCKS = 4, 6
TILE = 1 << 20  #: pairs of a large cell that are compared at once
_TASK_BYTES = 64 << 20
_PIVOTS = mix(np.arange(1, PIVOTS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_ALL = U64(0xFFFFFFFFFFFFFFFF)
_LANES = U64(0x0101010101010101)


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (long): A-Z lower-cased, words of the whole text, shingles of
    ``shingle`` words joined by one space with repeats (fewer words: the whole sequence), a bit set
    if it is set in over half of the shingles' XXH64 (seed 42).  No word or null: zero."""
    docs = without(docs, "fingerprint", "__text").withColumn("__text", F.col(quoted(text)).cast("string"))
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema if f.name != "__text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.schema.get_field_index("__text")
            prints = _simhash(batch.column(own), shingle)[:, 0]
            keep = [i for i in range(batch.num_columns) if i != own]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(prints.view(np.int64))], names=[*(batch.schema.names[i] for i in keep), "fingerprint"])

    return docs.mapInArrow(lean(work), f"{fields}, fingerprint long")


def _simhash(column: pa.Array, shingle: int, words: int = 1) -> np.ndarray:
    """One row of ``words`` fingerprint words a text; those after the first are of mixed hashes."""
    data, offsets = text_buffers(column)
    found = np.zeros((len(offsets) - 1, words), dtype=U64)
    hashes, owners, size = [], [], 0

    def flush() -> None:
        nonlocal hashes, owners, size
        if owners:
            h, counts = np.concatenate(hashes), np.array([len(h) for h in hashes])
            for w in range(words):
                found[owners, w] = _majority(mix(h + U64(w)) if w else h, counts)
        hashes, owners, size = [], [], 0

    for d in range(len(found)):
        h = _shingles(data[offsets[d] : offsets[d + 1]].tobytes().lower().split(), shingle)
        if len(h):
            hashes.append(h)
            owners.append(d)
            size += len(h)
        if size > 200_000:
            flush()
    flush()
    return found


def _shingles(words: list[bytes], shingle: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), 42)] if words else [], dtype=U64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.fromiter(map(digest, grams, repeat(42)), dtype=U64, count=len(words) - shingle + 1)


def _majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of ``counts`` hashes: the bits set in over half of them.  Eight bits are counted at
    a time in byte lanes over groups of at most 255 hashes."""
    groups = -(-counts // 255)
    first = np.cumsum(counts) - counts
    inner = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
    starts = np.repeat(first, groups) + inner * 255
    owner = np.cumsum(groups) - groups
    found = np.zeros(len(counts), dtype=U64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> U64(bit)) & _LANES, starts)
        totals = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        for byte in range(8):
            found |= (2 * totals[:, byte] > counts).astype(U64) << U64(8 * byte + bit)
    return found


def _fan(df: DataFrame, size: int) -> int:
    """Partitions for the rows of a materialised table at ``size`` bytes each."""
    return max(partitions(df.sparkSession), ceil(df.count() * size / _TASK_BYTES))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): trees whose components are those of all pairs of different values of the long column
    ``fingerprint`` at ``RADIUS`` or fewer differing bits; b < a."""
    dealt = prints.select("fingerprint").mapInArrow(lean(_deal), "cell long, fingerprint long").repartition(_fan(prints, 64), "cell")
    return dealt.mapInArrow(lean(_search), "a long, b long")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(4):
            cell = (f.view(U64) >> U64(16 * k) & U64(0xFFFF)).astype(np.int64) | k << 16
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(f)], names=["cell", "fingerprint"])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs of equal values."""
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return opens, np.diff(np.append(opens, len(key)))


class _Forest:
    """Components of 0 … n - 1, each with its smallest member as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            live = ra != rb
            if not live.any():
                return
            a, b, ra, rb = a[live], b[live], ra[live], rb[live]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells, prints = [], []
    for batch in batches:
        cells.append(batch.column(0).to_numpy(zero_copy_only=False))
        prints.append(batch.column(1).to_numpy(zero_copy_only=False))
    if not cells:
        return
    names, f = np.unique(np.concatenate(prints), return_inverse=True)
    cell = np.concatenate(cells)
    order = np.argsort(cell, kind="stable")
    cell, f = cell[order], f[order]
    forest, held, n = _Forest(len(names)), [], 0
    for a, b in _linked(cell, f, names.view(U64)):
        held.append((a, b))
        n += len(a)
        if n > 1 << 18:
            forest.join(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        forest.join(*map(np.concatenate, zip(*held, strict=True)))
    below = np.flatnonzero(forest.root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[below]), pa.array(names[forest.root[below]])], names=["a", "b"])


def _linked(cell: np.ndarray, f: np.ndarray, names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of indices ``f`` into ``names``, by equal ``cell``."""
    opens, size = _runs(cell)
    small = np.repeat(size <= CELL, size)
    for i, j in _pairs(cell[small], names[f[small]][:, None], RADIUS, PIVOTS):
        yield f[small][i], f[small][j]
    for k in np.flatnonzero(size > CELL):
        own = f[opens[k] : opens[k] + size[k]]
        for i, j in _split(names[own], _ALL):
            yield own[i], own[j]


def _split(f: np.ndarray, free: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one large cell: split by four blocks of the bits in which its members may
    differ, of which close ones share a block, until cells are small or no bits are left."""
    differ = np.bitwise_or.reduce(f ^ f[0]) & free
    bits = [U64(1 << i) for i in range(64) if int(differ) >> i & 1]
    if len(f) <= CELL or len(bits) < 8:
        yield from _pairs(np.zeros(len(f), dtype=np.int64), f[:, None], RADIUS, PIVOTS)
        return
    for k in range(4):
        mask = np.bitwise_or.reduce(np.array(bits[k::4], dtype=U64))
        order = np.argsort(f & mask, kind="stable")
        key = (f & mask)[order]
        opens, size = _runs(key)
        small = order[np.repeat(size <= CELL, size)]
        for i, j in _pairs((f & mask)[small].view(np.int64), f[small][:, None], RADIUS, PIVOTS):
            yield small[i], small[j]
        for r in np.flatnonzero(size > CELL):
            own = order[opens[r] : opens[r] + size[r]]
            if size[r] == len(f):
                for i, j in _pairs(np.zeros(len(f), dtype=np.int64), f[:, None], RADIUS, PIVOTS):
                    yield i, j
                return
            for i, j in _split(f[own], free & ~mask):
                yield own[i], own[j]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16).sum(axis=1)


def _pairs(cell: np.ndarray, f: np.ndarray, radius: int, pivots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within equal ``cell`` at ``radius`` or fewer differing bits of the rows of ``f``,
    by the table of distances to ``pivots`` reference rows."""
    if len(f) < 2:
        return
    table = np.stack([_distance(f, np.roll(_PIVOTS, k)[: f.shape[1]]) for k in range(pivots)], axis=1)
    order = np.lexsort((table[:, 0], cell))
    cell, f, table = cell[order], f[order], table[order]
    near = np.arange(len(f) - 1)
    step = 1
    while near.size:
        near = near[near + step < len(f)]
        other = near + step
        near = near[(cell[near] == cell[other]) & (table[other, 0] - table[near, 0] <= radius)]
        left = near
        for k in range(1, pivots):
            if not left.size:
                break
            left = left[np.abs(table[left, k] - table[left + step, k]) <= radius]
        left = left[_distance(f[left], f[left + step]) <= radius]
        if left.size:
            yield order[left], order[left + step]
        step += 1


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node that can be
    reached.  Large-star and small-star contractions alternate until each node has one link, to a
    root; links that are so from the start cost one look."""
    edges = materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    while not _settled(edges):
        edges = materialise(_star(edges, larger=True))
        edges = materialise(_star(edges, larger=False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").limit(1).count()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links every larger neighbour of a node (or every smaller one and itself) to the smallest."""
    both = edges.union(edges.select("b", "a")) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if larger:
        found = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return found.filter("a != b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``fingerprint`` (16 lowercase hex digits) and ``component_id``
    (the smallest ``doc_id`` reachable over links of ``RADIUS`` or fewer differing bits).

    Null and empty texts have fingerprint zero and link like others.  Null ids count as absent in
    the smallest id; a component of null ids only has a null ``component_id``.  Equal rows stay as
    they are.  Input columns named like a result are replaced; an empty table gives no rows.
    """
    docs = without(docs, "fingerprint", "component_id", "__f", "__root", "__least")
    rows = materialise(fingerprints(docs, shingle, text).drop(text).withColumnRenamed("fingerprint", "__f"))
    classes = materialise(rows.groupBy("__f").agg(F.min(quoted(doc_id)).alias("__least")))
    tree = components(links(classes.select(F.col("__f").alias("fingerprint")))).select(F.col("node").alias("__f"), F.col("root").alias("__root"))
    found = materialise(classes.join(tree, "__f", "left").withColumn("__root", F.coalesce("__root", "__f")))
    least = found.groupBy("__root").agg(F.min("__least").alias("component_id"))
    classes = found.join(least, "__root").select("__f", "component_id")
    release(docs.sparkSession)
    named = F.lower(F.lpad(F.hex("__f"), 16, "0")).alias("fingerprint")
    return rows.join(classes, "__f").select(*[quoted(c) for c in docs.columns if c != text], named, "component_id")


def bits_apart(similarity: float, bits: int) -> int:
    """The distance that SimHashes of ``bits`` bits keep within in nine of ten pairs of texts whose
    sets of shingles are ``similarity`` alike (Jaccard), and in nearly all closer ones: one and a half
    deviations over the mean of the angle's share."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * p + 1.5 * sqrt(bits * p * (1 - p)))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate group: the row with the smallest
    id stays (of equal ids, or where all ids are null, the first in the order read).

    Groups are the components of pairs whose distinct shingles of ``shingle`` words (A-Z lower-cased;
    shorter texts are one shingle) are ``similarity`` alike or more by Jaccard.  Texts of equal words
    are always found, null and empty ones among them; every pair that is linked was verified, and of
    pairs at the similarity itself about nine of ten are found, of closer ones more.  An empty table
    gives no rows; columns stay as they are, whatever their names.
    """
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(names, inner, strict=True))
    rows = materialise(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()))
    sketch = ", ".join(f"w{k} long" for k in range(WORDS))
    words = rows.select("row", F.col(own[doc_id]).alias("id"), F.col(own[text]).cast("string").alias("text"))
    sketched = materialise(words.mapInArrow(lean(_sketch(shingle)), f"row long, id {rows.schema[own[doc_id]].dataType.simpleString()}, same binary, {sketch}"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes = materialise(sketched.groupBy("same").agg(first, *[F.first(f"w{k}").alias(f"w{k}") for k in range(WORDS)]))
    nodes = classes.select(F.col("first.row").alias("node"), *[f"w{k}" for k in range(WORDS)])
    tree = _similar(nodes, words, shingle, similarity)
    best = classes.select(F.col("first.row").alias("node"), "first").join(tree, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    # Narrow rows tell which to drop; the texts stay where they are unless these are too many to send.
    dropped = materialise(sketched.select("row").join(best.select(F.col("first.row").alias("row")), "row", "left_anti"))
    release(docs.sparkSession)
    kept = rows.join(broadcast_if_small(dropped, "row"), "row", "left_anti")
    return kept.select(*[F.col(i).alias(n) for n, i in own.items()])


def _sketch(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _simhash(batch.column(2), shingle, WORDS).view(np.int64)
            same = [xxhash.xxh128_digest(b" ".join((t or "").encode().lower().split())) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(WORDS))], names=["row", "id", "same", *(f"w{k}" for k in range(WORDS))])

    return work


def _similar(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the components of verified pairs.  Members of a cell with more candidates than
    ``PARTNERS`` for each of them have few verified at first: in each block the most central one, and for
    every sixth block the nearest; what is left to compare across components then, between
    those members, is verified whole."""
    radius = bits_apart(similarity, 64 * WORDS)
    labelled = nodes.withColumn("root", F.col("node"))
    found = _searched(labelled, nodes, radius, PARTNERS)
    edges = _verified(found, texts, shingle, similarity)
    tree = components(edges)
    dense = materialise(found.filter("b IS NULL").select(F.col("a").alias("node")).distinct())
    if not dense.limit(1).count():
        return tree
    some = nodes.join(dense, "node", "left_semi").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = _searched(some, dense, radius, None)
    if not found.limit(1).count():
        return tree
    return components(edges.union(_verified(found, texts, shingle, similarity)))


def _searched(labelled: DataFrame, counted: DataFrame, radius: int, partners: int | None) -> DataFrame:
    """Candidates (a, b) of different roots; b is null for members of cells that were cut short."""
    dealt = labelled.mapInArrow(lean(_deal_blocks), "cell int, node long, root long, " + ", ".join(f"w{k} long" for k in range(WORDS)))
    dealt = dealt.repartition(_fan(counted, 4 * WORDS * 60), "cell")
    return materialise(dealt.mapInArrow(lean(_candidates(radius, partners, CELL)), "a long, b long").distinct())


def _deal_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["cell", "node", "root", *(f"w{k}" for k in range(WORDS))]
    for batch in batches:
        held = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for k in range(BLOCKS):
            word = held[f"w{k % WORDS}"].to_numpy(zero_copy_only=False).view(U64)
            cell = _block(word, k // WORDS).astype(np.int32) | np.int32(k << BLOCK_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(held[n] for n in names[1:])], names=names)


def _block(word: np.ndarray, k: int) -> np.ndarray:
    return word >> U64(BLOCK_BITS * k) & U64((1 << BLOCK_BITS) - 1)


def _candidates(radius: int, partners: int | None, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if not parts:
            return
        cell, node, root, *words = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((node, cell))
        cell, node, root, f = cell[order], node[order], root[order], np.stack([w[order].view(U64) for w in words], axis=1)
        opens, size = _runs(cell)
        for part in _together(opens, size, most):
            block = cell[part] >> BLOCK_BITS
            if len(part) > most and cell[part[0]] == cell[part[-1]]:  # one large cell
                yield from _large(node[part], root[part], f[part], int(block[0]), radius, partners)
            else:
                yield from _small(cell[part], block, node[part], root[part], f[part], radius, partners)

    return work


def _together(opens: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indices of the members of cells of two or more: of those of ``most`` or fewer, as many at a time
    as have pairs of two such cells, or one larger cell."""
    held, pairs = [], 0
    for o, k in zip(opens[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        if k > most:
            yield np.arange(o, o + k)
            continue
        if held and pairs + k * k > 2 * most * most:
            yield np.concatenate(held)
            held, pairs = [], 0
        held.append(np.arange(o, o + k))
        pairs += k * k
    if held:
        yield np.concatenate(held)


def _first_shared(x: np.ndarray, block: np.ndarray | int) -> np.ndarray:
    """Whether fingerprints whose differing bits are ``x`` share no block before ``block``: a pair is
    a candidate in the first of its cells only."""
    first = np.ones(len(x), dtype=bool)
    for k in range(int(np.max(block, initial=0))):
        first &= (_block(x[:, k % WORDS], k // WORDS) != 0) | (block <= k)
    return first


def _rows(x: np.ndarray, y: np.ndarray | None = None) -> pa.RecordBatch:
    """Candidates, or nodes of cells that were cut short."""
    if y is None:
        x = np.unique(x)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64())], names=["a", "b"])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _leading(x: np.ndarray, *by: np.ndarray, most: int) -> np.ndarray:
    """Which of the first ``most`` of each ``x`` in the order of ``by`` each row is among."""
    order = np.lexsort((*by[::-1], x))
    opens, size = _runs(x[order])
    keep = np.zeros(len(x), dtype=bool)
    keep[order[np.arange(len(x)) - np.repeat(opens, size) < most]] = True
    return keep


def _partners(x: np.ndarray, y: np.ndarray, f: np.ndarray, block: np.ndarray | int, score: np.ndarray, partners: int) -> np.ndarray:
    """Which candidates y of each x to verify at first: in each block the most central one, to which
    the copies of one text are closer than to each other, and in some the nearest ones."""
    apart = _distance(f[x], f[y])
    near = _leading(x, apart, y, most=-(-partners // 2)) & (block % PARTNER_BLOCKS == 0)
    return near | _leading(x, -score[y], y, most=-(-partners // 4)) & _first_shared(f[x] ^ f[y], block)


def _small(cell: np.ndarray, block: np.ndarray, node: np.ndarray, root: np.ndarray, f: np.ndarray, radius: int, partners: int | None) -> Iterator[pa.RecordBatch]:
    found = list(_pairs(cell, f, radius, 1))
    if not found:
        return
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    across = root[a] != root[b]
    a, b = a[across], b[across]
    if not len(a):
        return
    keep = np.zeros(len(a), dtype=bool)
    if partners is not None:
        _, number = np.unique(cell, return_inverse=True)
        dense = np.bincount(number[a], minlength=number[-1] + 1) > partners * np.bincount(number)
        keep = dense[number[a]]
        if keep.any():
            x, y = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
            score = np.bincount(x, weights=radius + 1 - _distance(f[x], f[y]), minlength=len(node))
            chosen = _partners(x, y, f, block[x], score, partners)
            if chosen.any():
                yield _rows(node[x[chosen]], node[y[chosen]])
            yield _rows(node[x])
    a, b = a[~keep], b[~keep]
    first = _first_shared(f[a] ^ f[b], block[a])
    if first.any():
        yield _rows(node[a[first]], node[b[first]])


def _large(node: np.ndarray, root: np.ndarray, f: np.ndarray, block: int, radius: int, partners: int | None) -> Iterator[pa.RecordBatch]:
    """The same of one large cell, all pairs by strips of rows, so that memory is bounded."""
    n = len(node)
    step = max(1, TILE // n)

    def strips() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, n, step):
            own = slice(at, min(n, at + step))
            apart = np.zeros((own.stop - at, n), dtype=np.uint16)
            for w in range(WORDS):
                apart += np.bitwise_count(f[own, w][:, None] ^ f[None, :, w])
            x, y = np.nonzero((apart <= radius) & (root[own][:, None] != root[None, :]))
            yield x + at, y, apart[x, y].astype(np.int64)

    if partners is not None:
        score, ends = np.zeros(n), np.zeros(n, dtype=np.int64)
        for x, y, apart in strips():
            score += np.bincount(x, weights=radius + 1 - apart, minlength=n)
            ends += np.bincount(x, minlength=n)
        if ends.sum() > 2 * partners * n:
            yield _rows(node[ends > 0])
            for x, y, _ in strips():
                keep = _partners(x, y, f, block, score, partners)
                yield _rows(node[x[keep]], node[y[keep]])
            return
    for x, y, _ in strips():
        x, y = x[x < y], y[x < y]
        first = _first_shared(f[x] ^ f[y], block)
        yield _rows(node[x[first]], node[y[first]])


def _verified(found: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those candidates whose sets of shingles are ``similarity`` alike or more."""
    pairs = found.filter("b IS NOT NULL")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    few = 2 * 48 * pairs.count() <= BROADCAST_CHARS
    held = texts.select("row", "text").join(F.broadcast(ends) if few else ends, "row", "left_semi")
    held = materialise(held.mapInArrow(lean(_shingle_sets(shingle)), "row long, shingles binary"))
    both = pairs.join(held.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
    return materialise(both.select("a", "b", "x", "y").mapInArrow(lean(_alike(similarity)), "a long, b long"))


def _shingle_sets(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingles((t or "").encode().lower().split(), shingle)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["row", "shingles"])

    return work


def _alike(similarity: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(n >= similarity * (len(x) + len(y) - n))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return work
