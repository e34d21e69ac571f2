"""Substring de-duplication with difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: for any two starts s and t some k < PERIOD
makes both s + k and t + k cover positions.  So two equal windows of ``window`` words share an
aligned anchor of ``window - PERIOD + 1`` words, and only cover positions are hashed:

1. hash the anchors at cover positions; keep positions whose anchor occurs twice or more;
2. extend: a window of ``window`` words that holds such an anchor is hashed whole (96 bits), and
   windows that occur twice or more are the repeats;
3. drop the words that repeated windows cover.

Hashes are counted within each task before they are dealt out, so a passage that a third of the
documents share costs one record a task.  Windows travel as runs under their smallest anchor
hash, which equal windows have in common.  The texts move once, into a bucketed table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, materialise, partitions, quoted, scope, stored_bytes, without
from .kernels import U64, Words, lean, rolling, slices, text_buffers, window_starts

PERIOD, COVER = 21, (0, 1, 4, 14, 16)  # a perfect difference set of order 4
#: Hashes that one task is dealt, by estimate.
TASK_BYTES = 96 << 20
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text`` (the kept words joined by one space), ``n_words`` and
    ``n_removed``.  A word is removed if a window of ``window`` words of its text covers it whose
    word sequence starts anywhere else too, in the same text included; windows are judged on the
    input.  A null or empty text has no words and an empty ``kept_text``; equal rows are copies of
    each other; an empty table gives no rows.  Input columns named like a result are replaced.
    """
    if window < PERIOD + 4:
        raise ValueError(f"window must be at least {PERIOD + 4} words")
    spark = docs.sparkSession
    docs = without(docs, "kept_text", "n_words", "n_removed", "__row", "__text")
    with scope() as made:
        table = bucketed(docs.withColumns({"__row": F.monotonically_increasing_id(), "__text": F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))}), "__row")
    texts = table.select("__row", F.col("__text").alias("text"))
    # A task holds the hashes dealt to it: some four bytes for each byte stored.
    fan = max(partitions(spark), ceil(4 * stored_bytes(spark, made[0]) / TASK_BYTES))

    anchors = texts.mapInArrow(lean(_anchors(window - PERIOD + 1, fan)), "bucket int, known boolean, body binary")
    twice = anchors.repartitionById(fan, "bucket").mapInArrow(lean(_repeated_anchors), "__row long, at int")
    twice = materialise(twice.groupBy("__row").agg(F.collect_list("at").alias("anchors")))

    held = texts.join(twice.hint("shuffle_hash"), "__row")
    windows = held.mapInArrow(lean(_windows(window, fan)), "bucket int, body binary, row long, start int, stop int")
    runs = windows.repartitionById(fan, "bucket").mapInArrow(lean(_repeated_windows(window)), "__row long, start int, stop int")
    runs = materialise(runs.groupBy("__row").agg(F.collect_list("start").alias("__starts"), F.collect_list("stop").alias("__stops")))

    joined = table.join(runs.hint("shuffle_hash"), "__row", "left")
    kept = joined.select(*[quoted(c) for c in docs.columns], "__text", "__starts", "__stops")
    fields = ", ".join([f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema] + ["kept_text string", "n_words long", "n_removed long"])
    return kept.mapInArrow(lean(_cut), fields)


def _anchors(width: int, fan: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, places = [], [], []
        for part in slices(batches):
            words = Words(*text_buffers(part.column(1)))
            start, text = window_starts(words.first, width)
            place = start - words.first[text]
            use = _IN_COVER[place % PERIOD]
            hashes.append(rolling(words.hashes(1), width)[start[use]])
            rows.append(part.column(0).to_numpy(zero_copy_only=False)[text[use]])
            places.append(place[use].astype(np.int32))
        if not hashes:
            return
        h, row, place = np.concatenate(hashes), np.concatenate(rows), np.concatenate(places)
        del hashes, rows, places
        order = np.argsort(h, kind="stable")
        h, row, place = h[order], row[order], place[order]
        opens = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.append(opens, len(h)))
        known = np.repeat(times > 1, times)
        # Of each hash one record goes on; what repeats here is a repeat whatever others have.
        yield from _packed(_bucket(h[opens], fan), fan, False, h[opens], row[opens], place[opens], (times > 1).astype(np.uint8))
        yield from _packed((row[known] % fan).astype(np.int32), fan, True, row[known], place[known])

    return work


def _bucket(h: np.ndarray, fan: int) -> np.ndarray:
    return ((h >> U64(20)) % U64(fan)).astype(np.int32)


def _packed(bucket: np.ndarray, fan: int, known: bool, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(fan + 1))
    columns = [c[order] for c in columns]
    full = np.flatnonzero(np.diff(ends))
    for at in range(0, len(full), 256):
        some = full[at : at + 256]
        bodies = [b"".join(c[ends[k] : ends[k + 1]].tobytes() for c in columns) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([known] * len(some)), pa.array(bodies, pa.binary())], names=["bucket", "known", "body"])


def _unpack(body: memoryview, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, found = len(body) // sum(sizes), 0, []
    for t, size in zip(types, sizes, strict=True):
        found.append(np.frombuffer(body, dtype=t, count=n, offset=at))
        at += n * size
    return found


def _rows(names: list[str], *columns: np.ndarray, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + most]) for c in columns], names=names)


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = []
    for batch in batches:
        for known, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            if known:
                row, place = _unpack(memoryview(body.as_buffer()), "<i8", "<i4")
                yield from _rows(["__row", "at"], row, place)
            else:
                parts.append(_unpack(memoryview(body.as_buffer().to_pybytes()), "<u8", "<i8", "<i4", "u1"))
    if parts:
        h, row, place, many = (np.concatenate(x) for x in zip(*parts, strict=True))
        twice = _twice(h, many) & (many == 0)
        yield from _rows(["__row", "at"], row[twice], place[twice])


def _twice(h: np.ndarray, many: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Whether each hash (with ``more`` as further bits) occurs twice or is known to."""
    if not len(h):
        return np.zeros(0, dtype=bool)
    order = np.argsort(h, kind="stable") if more is None else np.lexsort((more, h))
    s = h[order]
    differs = s[1:] != s[:-1]
    if more is not None:
        differs |= more[order][1:] != more[order][:-1]
    opens = np.flatnonzero(np.concatenate([[True], differs]))
    times = np.diff(np.append(opens, len(s)))
    twice = (times > 1) | (np.add.reduceat(many[order].astype(np.int64), opens) > 0)
    found = np.empty(len(h), dtype=bool)
    found[order] = np.repeat(twice, times)
    return found


def _windows(window: int, fan: int):
    width = window - PERIOD + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for part in slices(batches):
            words = Words(*text_buffers(part.column(1)))
            start, text = window_starts(words.first, window)
            if not len(start):
                continue
            lists = part.column(2)
            marks = np.zeros(len(words.starts) + 1, dtype=np.int64)
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            marks[words.first[owner] + lists.flatten().to_numpy() + 1] = 1
            marks = np.cumsum(marks)
            holds = marks[start + PERIOD] > marks[start]
            start, text = start[holds], text[holds]
            own, other = words.hashes(1), words.hashes(2)
            least, step = rolling(own, width), 1
            while step < PERIOD:  # sliding minimum over the PERIOD anchors of a window
                shift = min(step, PERIOD - step)
                least = np.minimum(least[:-shift], least[shift:]) if len(least) > shift else least[:0]
                step += shift
            row = part.column(0).to_numpy(zero_copy_only=False)[text]
            parts.append((rolling(own, window)[start], (rolling(other, window)[start] >> U64(32)).astype(np.uint32), least[start], row, (start - words.first[text]).astype(np.int32)))
        if not parts:
            return
        h, more, least, row, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((more, h))
        same = (h[order][1:] == h[order][:-1]) & (more[order][1:] == more[order][:-1])
        later, many = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.uint8)
        later[order[1:]] = same
        many[order[1:]] |= same
        many[order[:-1]] |= same
        # What repeats within this task is a repeat; of such windows one goes on for the others' sake.
        yield from _known_runs(row[many > 0], place[many > 0], window, fan)
        on = ~later
        h, more, least, row, place, many = (x[on] for x in (h, more, least, row, place, many))
        breaks = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (least[1:] != least[:-1])]) if len(h) else np.zeros(0, bool)
        opens = np.flatnonzero(breaks)
        size = np.diff(np.append(opens, len(h))).astype(np.int32)
        bucket = _bucket(least[opens], fan)
        sort = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[sort], np.arange(fan + 1))
        full = np.flatnonzero(np.diff(ends))
        for at in range(0, len(full), 256):
            bodies = []
            for k in (some := full[at : at + 256]):
                runs = sort[ends[k] : ends[k + 1]]
                n = size[runs].astype(np.int64)
                each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(opens[runs], n)
                bodies.append(np.int64([len(runs), len(each)]).tobytes() + b"".join(x.tobytes() for x in (row[opens[runs]], place[opens[runs]], size[runs], h[each], more[each], many[each])))
            none = [None] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(bodies, pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.int32())], names=["bucket", "body", "row", "start", "stop"])

    return work


def _runs(row: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) in words of what consecutive windows cover."""
    if not len(row):
        return row, place, place
    opens = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]))
    closes = np.append(opens[1:], len(row)) - 1
    return row[opens], place[opens], place[closes] + np.int32(window)


def _known_runs(row: np.ndarray, place: np.ndarray, window: int, fan: int) -> Iterator[pa.RecordBatch]:
    row, start, stop = _runs(row, place, window)
    for at in range(0, len(row), 100_000):
        cut = slice(at, at + 100_000)
        bucket = (row[cut] % fan).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([None] * len(bucket), pa.binary()), pa.array(row[cut]), pa.array(start[cut]), pa.array(stop[cut])], names=["bucket", "body", "row", "start", "stop"])


def _repeated_windows(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            known = batch.filter(batch.column(1).is_null())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(2), known.column(3), known.column(4)], names=["__row", "start", "stop"])
            for body in batch.column(1).drop_null():
                raw = body.as_buffer().to_pybytes()
                runs, each = np.frombuffer(raw, "<i8", 2)
                at, got = 16, []
                for kind, n in (("<i8", runs), ("<i4", runs), ("<i4", runs), ("<u8", each), ("<u4", each), ("u1", each)):
                    got.append(np.frombuffer(raw, kind, n, at))
                    at += n * np.dtype(kind).itemsize
                parts.append(got)
        if not parts:
            return
        row, start, size, h, more, many = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        twice = _twice(h, many, more) & (many == 0)
        n = size.astype(np.int64)
        row = np.repeat(row, n)[twice]
        place = (np.repeat(start, n) + (np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))[twice]
        yield from _rows(["__row", "start", "stop"], *_runs(row, place, window))

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, column="__text"):
        n_in = part.num_columns - 3
        data, offsets = text_buffers(part.column(n_in))
        words = Words(data, offsets)
        starts, stops = part.column(n_in + 1), part.column(n_in + 2)
        change = np.zeros(len(words.starts) + 1, dtype=np.int64)
        owner = np.repeat(np.arange(part.num_rows), np.diff(starts.offsets.to_numpy()))
        np.add.at(change, words.first[owner] + starts.flatten().to_numpy(), 1)
        np.add.at(change, words.first[owner] + stops.flatten().to_numpy(), -1)
        gone = np.cumsum(change)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[words.first[1:]] - total[words.first[:-1]]
        raw, kept = data.tobytes(), []
        for d in range(part.num_rows):
            own = raw[offsets[d] : offsets[d + 1]].split()
            if removed[d]:
                keep = ~gone[words.first[d] : words.first[d + 1]]
                own = [w for w, k in zip(own, keep, strict=True) if k]
            kept.append(b" ".join(own))
        added = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*part.columns[:n_in], *added], names=[*part.schema.names[:n_in], "kept_text", "n_words", "n_removed"])
