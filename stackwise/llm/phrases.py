"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing labels each symbol by the lowest bit in which it differs from its left
neighbour and that bit's value; a few rounds leave labels below six, adjacent ones different.  A
local maximum opens a phrase, so borders depend on a few neighbours only, and equal substrings are
cut alike wherever they stand.  A phrase's name is a hash of its symbols; names are the symbols of
the next level.  The fingerprint is a one-permutation min-hash of the names of ``LEVELS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, quoted, without
from .kernels import U64, lean, mix, slices

LEVELS = (3, 4)  # phrases of some 30 and 90 characters
BINS, _EMPTY = 64, 0xFFFF


def _toss_table() -> np.ndarray:
    left, right = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = np.bitwise_count(((left ^ right) & -(left ^ right)) - 1)
    low[left == right] = 0
    return (2 * low + (right >> low & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table()
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=U64))


def _phrases(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the phrases; ``first`` marks the texts' first symbols.  Neighbours differ."""
    n = len(s)
    x = np.empty_like(s)
    x[0] = 1
    x[1:] = s[1:] ^ s[:-1]
    x[first] = 1
    low = np.bitwise_count((x & (~x + s.dtype.type(1))) - s.dtype.type(1))
    label = (low << np.uint8(1)) | (s >> low.astype(s.dtype) & s.dtype.type(1)).astype(np.uint8)
    for _ in range(3):
        index = label.astype(np.uint16)
        index[1:] |= label[:-1].astype(np.uint16) << np.uint16(7)
        start = label[first]
        label = _TOSS[index]
        label[first] = start & np.uint8(1)
    opens = np.zeros(n, dtype=bool)
    rises = label[1:] > label[:-1]
    opens[1:-1] = rises[:-1] & (label[1:-1] > label[2:])
    opens[first[1:] - 1] = False  # a text's last symbol has no right neighbour
    opens[first] = True
    return np.flatnonzero(opens)


def _collapse(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal symbols within a text: (symbol, run length, index of texts' first)."""
    new = np.empty(len(s), dtype=bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(s)))
    return s[at], run, np.searchsorted(at, first)


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    """One row of ``BINS`` 16-bit values a text; equal texts have equal rows."""
    found = np.full((len(texts), BINS), _EMPTY, dtype=np.uint16)
    raw = [t.encode("utf-32-le", "replace") for t in texts]
    size = np.array([len(r) // 4 for r in raw], dtype=np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return found
    points = np.frombuffer(b"".join(raw), dtype="<u4")
    first = (np.cumsum(size) - size)[full]
    s, run, first = _collapse(points, first)
    s = s | (np.minimum(run, 2047).astype(np.uint32) << np.uint32(21))
    flat = found.reshape(-1)
    for level in range(1, max(LEVELS) + 1):
        starts = _phrases(s, first)
        lens = np.diff(np.append(starts, len(s)))
        offset = np.arange(len(s)) - np.repeat(starts, lens)
        values = mix(s.astype(U64)) if level == 1 else s
        name = mix(np.add.reduceat(values * _POWERS[offset & 63], starts) + lens.astype(U64))
        first = np.searchsorted(starts, first)
        if level in LEVELS:
            owner = np.repeat(full, np.diff(np.append(first, len(name))))
            value = np.minimum(name >> U64(48), U64(_EMPTY - 1)).astype(np.uint16)
            np.minimum.at(flat, owner * BINS + (name & U64(BINS - 1)).astype(np.int64), value)
        s, run, first = _collapse(name, first)
        s = np.where(run > 1, mix(s + run.astype(U64)), s)
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either fingerprint fills, row by row; two texts
    without a phrase are alike."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    n = filled.sum(axis=1)
    return np.where(n, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1), 1.0)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (hex of ``BINS`` 16-bit values; ``ffff`` is an empty bin).
    Null is the empty text, all of whose bins are empty; an input column of that name is replaced."""
    docs = without(docs, "fingerprint", "__text")
    rows = docs.withColumn("__text", F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")))
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20, "__text"):
            found = _hex(fingerprint_texts(part.column(part.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], names=[*part.schema.names[:-1], "fingerprint"])

    return rows.mapInArrow(lean(work), f"{fields}, fingerprint string")


def spliced(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: int = 3) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each
    row of ``docs``.  In descending order of the integer id, an edited text has its last
    floor(n_chars / ``part``) code points replaced by the first as many (or all) of the next text;
    the first follows the last.

    Null texts are empty.  Equal ids go by hash of text, then text; null ids come last.  A single
    row follows itself.  An empty table gives no rows.

    Texts move once, dealt out by ranges of the id whose upper ends are ids of the table; the rows
    that open a range also go, unfingerprinted, to the end of the range before.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("i"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    n = partitions(spark)
    steps = min(8 * n, 8000)
    ends = rows.agg(F.max("i").alias("m"), F.percentile_approx("i", [k / steps for k in range(1, steps)] or [0.5], 100 * steps).alias("p")).first()
    tops = np.unique(np.array([-x for x in {ends.m, *(ends.p or [])} if x is not None], dtype=np.int64))
    dealt = rows.mapInArrow(lean(_deal(tops)), "range int, again boolean, i long, text string").repartition(n, "range")
    order = ["range", "again", F.col("i").desc_nulls_last(), F.xxhash64("text"), "text"]
    fields = f"{quoted(doc_id)} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.sortWithinPartitions(*order).mapInArrow(lean(_splice(part, doc_id)), fields)


def _deal(tops: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            i = -batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            last = max(len(tops) - 1, 0)
            own = np.where(null, last, np.searchsorted(tops, i, side="right") - 1) if len(tops) else np.zeros(len(i), dtype=np.int64)
            opens = np.flatnonzero(~null & (tops[own] == i)) if len(tops) else np.arange(len(i))
            before = np.where(own[opens] == 0, last, own[opens] - 1)
            copies = batch.take(pa.array(opens))
            for part, at, again in ((batch, own, False), (copies, before, True)):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([again] * part.num_rows, pa.bool_()), *part.columns], names=["range", "again", "i", "text"])

    return work


def _splice(part: int, doc_id: str):
    names = [doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far, whose next is still to come
        for batch in slices(batches, 1 << 20):
            again, ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            prints = fingerprint_texts(texts)
            if held is not None:
                again, ids, texts, prints = [held[0], *again], [held[1], *ids], [held[2], *texts], np.vstack([held[3], prints])
            held = again[-1], ids[-1], texts[-1], prints[-1]
            rows = [k for k in range(len(ids) - 1) if not again[k]]
            if not rows:
                continue
            edited = []
            for k in rows:
                cut = len(texts[k]) // part
                edited.append(texts[k][: len(texts[k]) - cut] + texts[k + 1][:cut])
            new, own, following = fingerprint_texts(edited), prints[rows], prints[[k + 1 for k in rows]]
            columns = [
                pa.array([ids[k] for k in rows], pa.int64()),
                pa.array([len(texts[k]) for k in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(_hex(own)),
                pa.array(_hex(new)),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, following)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return work
