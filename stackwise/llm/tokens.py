"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list; a heap yields the adjacent pair of lowest rank (leftmost of
equal ones) until no pair can merge.  A word's count is its symbols minus its merges, so no
identifiers are made.  Counts of words are kept in a bounded table per worker.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, without
from .kernels import lean

CACHE_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordCounter(dict):
    """word -> number of tokens; fills itself on demand and forgets all when it is full."""

    def __init__(self, model: dict):
        super().__init__()
        if model["model"]["type"] != "BPE" or model["model"].get("dropout") or model["model"].get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        kinds = [n["type"] for n in model["normalizer"]["normalizers"]]
        split, level = model["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("normaliser or pre-tokeniser not supported")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(model["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        vocab, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"] or ""
        self.inner = [vocab[s] for s in byte_symbols()]
        self.final = [vocab[s + suffix] for s in byte_symbols()]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = self.merge(word.encode())
        return n

    def merge(self, word: bytes) -> int:
        symbols = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        n = count = len(symbols)
        ranks, merged = self.ranks, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := ranks.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = merged[rank], -1
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (p := before[i]) >= 0 and (r := ranks.get(symbols[p] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, r << 32 | p)
        return count

    def count(self, text: str) -> int:
        """Special strings in the text count one each, as the library reads them by default."""
        if "<|" in text and (special := self.special.findall(text)):
            return len(special) + sum(map(self.ordinary, self.special.split(text)))
        return self.ordinary(text)

    def ordinary(self, text: str) -> int:
        if not text.isascii():
            # Lower-casing goes character by character: no final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.__getitem__, self.words.findall(text.lower())))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``
    tokens) of each whole text, by the BPE file ``vocabulary``, which the driver reads.

    Null counts as the empty text: no bytes, no tokens.  Repeated rows are counted each; input
    columns named like a result are replaced; an empty table gives no rows.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(json.load(file))
    docs = without(docs, "n_bytes", "n_tokens", "over_limit", "__text")
    rows = docs.withColumn("__text", F.col(quoted(text)).cast("string"))
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = [counter.count(t) for t in texts]
            added = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(lean(work), f"{fields}, n_bytes long, n_tokens long, over_limit boolean")


_COUNTERS: dict[int, WordCounter] = {}


def _counter(shared) -> WordCounter:
    """One table per Python worker, kept between its tasks."""
    if shared.value and id(shared.value) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[id(shared.value)] = WordCounter(shared.value)
    return _COUNTERS[id(shared.value)]
