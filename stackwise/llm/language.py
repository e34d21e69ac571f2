"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams (n = 1 to 3, the blended spectrum) present in
both, normalised by the root of the product of their own numbers.  It is approximated by Nyström's
method on landmark texts and solved by one-versus-rest ridge regression on the driver, from a
bounded sample.  N-grams are exact codes and all those of the landmarks count.  The landmark matrix
times the weights gives each n-gram its weight for each label; whole texts are then scored in
batches, as presence matrix times that, over the root of the text's own number of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, without
from .kernels import U64, lean, slices

#: Bounds of the training sample: rows for each label, rows in all, and characters of a row (of
#: labels with longer texts only, a piece of that length is learned from, its place chosen by hash).
PER_LABEL, SAMPLE_ROWS, SAMPLE_CHARS = 200, 3000, 8000
LANDMARKS, RIDGE = 256, 1e-3
#: A text is foreign to all labels if it covers less than this share of what all but a hundredth of
#: the labelled sample cover.
FOREIGN = 0.6
#: Cells of a presence matrix at a time.
CELLS = 1 << 23
_LETTERS = np.array([chr(c).isalpha() for c in range(0x33480)])


class Grams:
    """Codes of n-grams -> 0, 1, ...; an open-addressing table, searched a column at a time."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        bits = max(8, (4 * self.n).bit_length())
        self.shift, self.last = U64(64 - bits), (1 << bits) - 1
        self.code, self.number = np.zeros(1 << bits, dtype=U64), np.full(1 << bits, self.n, dtype=np.int32)
        left, step = np.arange(self.n), 0
        while left.size:
            at = (self._home(codes[left]) + step) & self.last
            free = np.flatnonzero(self.code[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.code[at[put]], self.number[at[put]] = codes[left[put]], left[put]
            left, step = np.delete(left, put), step + 1

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code; ``n`` for those that aren't there."""
        at = self._home(codes)
        held = self.code[at]
        found = np.where(held == codes, self.number[at], self.n)
        left, step = np.flatnonzero((held != codes) & (held != 0)), 1
        while left.size:
            at = (self._home(codes[left]) + step) & self.last
            held = self.code[at]
            same = held == codes[left]
            found[left[same]] = self.number[at[same]]
            left, step = left[~same & (held != 0)], step + 1
        return found


@dataclass
class Model:
    labels: list[str]
    grams: Grams  # those of the landmarks
    weights: np.ndarray  # n-grams x labels
    bias: np.ndarray
    floor: float = 0.0  # least coverage of a text in one of the labels' languages


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets, whether a text has a letter): lower-cased; each run of other
    characters than letters is one space."""
    raw = [t.lower().encode("utf-32-le", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)
    points = np.frombuffer(b"".join(raw), dtype="<u4")
    letter = _LETTERS[np.minimum(points, len(_LETTERS) - 1)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[offsets[:-1][offsets[:-1] < len(points)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(letter)])
    points = np.where(letter, points, np.uint32(32))[keep]
    return points, kept[offsets], letters[offsets[1:]] > letters[offsets[:-1]]


def _codes(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes) of the n-grams within texts for n = 1, 2, 3: 21 bits a character."""
    last = np.zeros(len(points) + 1, dtype=np.int64)
    np.add.at(last, offsets[1:], 1)
    x, points = np.zeros(len(points), dtype=U64), points.astype(U64)
    inside = np.ones(len(points), dtype=bool)
    for n in range(3):
        if n:
            inside = inside[:-1] & (last[n : len(points)] == 0) if len(points) > n else inside[:0]
            x = x[:-1]
        x = x | points[n:] << U64(21 * n)
        yield np.flatnonzero(inside), x[inside]


def _presence(points: np.ndarray, offsets: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the n-grams of ``grams`` present (a boolean row), the number of its own distinct
    n-grams, and which share of them is known, with repeats and for the greatest n that it has."""
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    found, covered = np.zeros(rows * (grams.n + 1), dtype=bool), np.zeros(rows)
    strange = []
    for at, codes in _codes(points, offsets):
        number, own = grams.find(codes), owner[at]
        found[own * (grams.n + 1) + number] = True
        unknown = number == grams.n
        strange.append((own[unknown], codes[unknown]))
        total = np.bincount(own, minlength=rows)
        covered = np.where(total > 0, 1 - np.bincount(own[unknown], minlength=rows) / np.maximum(total, 1), covered)
    found = found.reshape(rows, grams.n + 1)[:, : grams.n]
    own, codes = (np.concatenate(x) for x in zip(*strange, strict=True))
    order = np.lexsort((codes, own))
    own, codes = own[order], codes[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (codes[1:] != codes[:-1])
    return found, found.sum(axis=1) + np.bincount(own[new], minlength=rows), covered


def _parts(points: np.ndarray, offsets: np.ndarray, grams: Grams) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Texts in runs whose presence matrices have about ``CELLS`` cells."""
    step = max(1, CELLS // (grams.n + 1))
    for at in range(0, len(offsets) - 1, step):
        own = offsets[at : at + step + 1]
        yield slice(at, at + len(own) - 1), points[own[0] : own[-1]], own - own[0]


def _common(found: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Numbers of n-grams in common, rows by landmarks."""
    total = np.zeros((len(found), len(marks)), dtype=np.float32)
    for at in range(0, found.shape[1], 1 << 15):
        cut = slice(at, at + (1 << 15))
        total += found[:, cut].astype(np.float32) @ marks[:, cut].astype(np.float32).T
    return total


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """The model of a sample; None if no text has a letter.  Deterministic."""
    points, offsets, has = _code_points(texts)
    rows = np.flatnonzero(has)
    if not len(rows):
        return None
    texts, labels = [texts[i] for i in rows], [labels[i] for i in rows]
    points, offsets, _ = _code_points(texts)
    names = sorted(set(labels))
    # Landmarks: as many of each label as there are, in turn.
    turn = {n: 0 for n in names}
    order = sorted(range(len(labels)), key=lambda i: ((turn.__setitem__(labels[i], turn[labels[i]] + 1) or turn[labels[i]]), labels[i], i))
    chosen = sorted(order[:LANDMARKS])
    own = [(points[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])) for i in chosen]
    grams = Grams(np.unique(np.concatenate([np.unique(np.concatenate([c for _, c in _codes(*x)])) for x in own])))
    marks = np.vstack([_presence(*x, grams)[0] for x in own])
    sizes = marks.sum(axis=1)
    kernel, covered = np.zeros((len(texts), len(chosen))), np.zeros(len(texts))
    for cut, p, o in _parts(points, offsets, grams):
        found, total, covered[cut] = _presence(p, o, grams)
        kernel[cut] = _common(found, marks) / np.sqrt(np.outer(total, sizes))
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.hstack([kernel @ root, np.ones((len(texts), 1))])
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    ridge = RIDGE * len(texts) * np.eye(phi.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.linalg.solve(phi.T @ phi + ridge, phi.T @ y)
    weights = _common(marks.T, ((root @ w[:-1]) / np.sqrt(sizes)[:, None]).T)
    # Landmarks are known by construction; the others tell what a text not learned from covers.
    others = np.setdiff1d(np.arange(len(texts)), chosen)
    floor = FOREIGN * float(np.quantile(covered[others if len(others) else slice(None)], 0.01))
    return Model(names, grams, weights, w[-1].astype(np.float32), floor)


def _scored(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    points, offsets, has = _code_points(texts)
    if model is None or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    values, covered = np.zeros((len(texts), len(model.labels))), np.zeros(len(texts))
    for cut, p, o in _parts(points, offsets, model.grams):
        found, total, covered[cut] = _presence(p, o, model.grams)
        values[cut] = (found.astype(np.float32) @ model.weights) / np.sqrt(np.maximum(total, 1))[:, None] + model.bias
    best = values.argmax(axis=1)
    score = np.where(has, np.clip((values[np.arange(len(texts)), best] + 1) / 2, 0, 1), 0)
    return [model.labels[b] if h else "und" for b, h in zip(best, has, strict=True)], score, np.where(has, covered, 0.0)


def predict(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(label or ``und``, score from 0 to 1) of each text; of labels with equal values the first by
    code point."""
    return _scored(model, texts)[:2]


def coverage(model: Model | None, texts: list[str]) -> np.ndarray:
    """Share of each text's n-grams that the model knows, from 0 to 1.  Unlike scores, which for k
    labels are at least 1/k, it falls to 0 for languages that no label has."""
    return _scored(model, texts)[2]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learns from labelled rows whose crc32(id as text) mod 4 is not 2, from a sample of at most
    ``PER_LABEL`` rows a label, ``SAMPLE_ROWS`` in all and ``SAMPLE_CHARS`` characters a row, chosen
    by hash; of more than ``SAMPLE_ROWS`` labels the most frequent are learned.  None if no row has
    a label."""
    rows = docs.select(F.crc32(F.col(quoted(doc_id)).cast("string")).alias("c"), F.col(quoted(text)).cast("string").alias("t"), F.col(quoted(lang)).cast("string").alias("l"))
    rows = rows.filter("c % 4 != 2 AND l IS NOT NULL AND t IS NOT NULL").withColumn("short", F.length("t") <= SAMPLE_CHARS)
    counts = {r.l: (r.n, r.s) for r in rows.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.col("short").cast("long")).alias("s")).orderBy(F.desc("n"), "l").limit(SAMPLE_ROWS).collect()}
    if not counts:
        return None
    per = max(1, min(PER_LABEL, SAMPLE_ROWS // len(counts)))
    # Of each label about twice the rows that are needed, by a hash of text; then the first of them.
    wanted = [(l, s > 0, min(1.0, 2 * per / (s or n)) if (s or n) > 4 * per else 1.0) for l, (n, s) in counts.items()]
    shares = docs.sparkSession.createDataFrame(wanted, "l string, only_short boolean, share double")
    drawn = rows.withColumn("h", F.xxhash64("t", "c")).join(F.broadcast(shares), "l").filter("(short OR NOT only_short) AND (h / 18446744073709551616.0 + 0.5) < share")
    piece = F.expr(f"IF(short, t, substring(t, CAST(1 + pmod(h, length(t) - {SAMPLE_CHARS}) AS INT), {SAMPLE_CHARS}))")
    drawn = drawn.select("l", "h", piece.alias("t"))
    sample: dict[str, list] = {}
    ranked = drawn.groupBy("l").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "t"))), 1, per).alias("rows"))
    for r in ranked.orderBy("l").collect():
        sample[r.l] = [x.t for x in r.rows]
    return fit([t for own in sample.values() for t in own], [l for l, own in sample.items() for _ in own])


def identify(docs: DataFrame, model: Model | None, text: str = "text", covered: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone; with
    ``covered`` also ``coverage`` (0 to 1), to be held against the model's ``floor``.

    Null texts and texts without a letter get ``und`` and 0, as does every text without a model
    (no labelled row).  Of labels with equal values the first by code point is given.  Repeated rows
    get equal results; input columns named like a result are replaced; an empty table gives no rows.
    """
    results = ["lang_pred", "score", *(["coverage"] if covered else [])]
    docs = without(docs, *results, "__text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.withColumn("__text", F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")))
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2 << 20, "__text"):
            labels, *numbers = _scored(shared.value, part.column(part.num_columns - 1).to_pylist())
            found = [pa.array(labels, pa.string()), *map(pa.array, numbers)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found[: len(results)]], names=[*part.schema.names[:-1], *results])

    return rows.mapInArrow(lean(work), f"{fields}, lang_pred string, score double{', coverage double' if covered else ''}")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(quoted(doc_id)).cast("string")) % 4 == 2, F.lit(False))
