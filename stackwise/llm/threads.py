"""Chat formatting by quotation linking.

Messages are parsed into quote levels; each quoted passage is normalised and hashed and joined to
the message of the conversation that first wrote it.  Following the links gives every message its
parent, root and depth; bodies come without quotes and attribution lines.

The join's key is conversation and passage, with one original for each, so neither a conversation
nor a phrase that holds a third of all messages meets in one task or multiplies rows.  Links are
followed by doubling, in a number of joins that grows with the logarithm of the deepest thread.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, quoted, without
from .kernels import lean

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"(?:on|am|le|el)\b.{0,300}(?:wrote|schrieb|écrit|escribió)\s*:\s*$|-{2,}\s*original message\s*-{2,}\s*$", re.IGNORECASE)


def split_levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line."""
    found = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        mark = _MARK.match(line)
        found.append((mark[1].count(">"), line[mark.end() :]) if mark else (0, line))
    return found


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(level, text) of the passages: lines of one level up to a blank line or another level."""
    found: list[tuple[int, list[str]]] = []
    fresh = True
    for level, line in lines:
        if not line.strip():
            fresh = True
        elif fresh or found[-1][0] != level:
            found.append((level, [line]))
            fresh = False
        else:
            found[-1][1].append(line)
    return [(level, "\n".join(own)) for level, own in found]


def digest(passage: str) -> str | None:
    """Hash of the letters and digits, case folded; None if there is none."""
    plain = " ".join(re.findall(r"[^\W_]+", passage.casefold()))
    return hashlib.sha256(plain.encode()).hexdigest()[:32] if plain else None


def parse(text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
    """(body, hashes of own passages and lines, (level, hash) of quoted passages or, where a passage
    has several lines, of those too)."""
    lines = split_levels(text)
    kept: list[tuple[int, str]] = []
    for k, (level, line) in enumerate(lines):
        following = next((other for other, more in lines[k + 1 :] if more.strip()), 0) if level == 0 and line.strip() and _ATTRIBUTION.match(line.strip()) else 0
        if not following:
            kept.append((level, line))
    own, quotes = {}, {}
    for level, passage in passages(kept):
        for piece in dict.fromkeys([passage, *passage.split("\n")]):
            if (h := digest(piece)) is not None:
                (own if level == 0 else quotes)[(level, h)] = None
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for level, line in kept if level == 0)).strip()
    return body, [h for _, h in own], list(quotes)


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``messages`` without the text, with ``body``, ``message`` (``<|role|>``, a new line and the
    body), ``n_quotes`` (quoted passages and lines), ``n_linked`` (those found in earlier turns of
    the conversation), ``parent_turn``, ``root_turn`` and ``depth``.

    A passage links to the first turn of its conversation that wrote it, if that is earlier.  The
    parent is the linked turn of the lowest quote level, of several the latest; without one a
    message is a root of its own.  Ordered by root, depth and turn, parents come before replies.
    Null texts have an empty body; rows with a null conversation or turn link to nothing; rows of
    equal conversation and turn share their links.  Input columns named like a result are replaced;
    an empty table gives no rows.
    """
    messages = without(messages, "body", "message", "n_quotes", "n_linked", "parent_turn", "root_turn", "depth", "__own", "__quotes", "__text")
    rows = messages.withColumn("__text", F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))).drop(text)
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    parsed = materialise(rows.mapInArrow(lean(_parse), f"{fields}, body string, __own array<string>, __quotes array<struct<level:int,hash:string>>"))

    key = [F.col(quoted(conversation)).alias("c"), F.col(quoted(turn)).alias("t")]
    originals = parsed.select(*key, F.explode("__own").alias("hash")).filter("c IS NOT NULL AND t IS NOT NULL").groupBy("c", "hash").agg(F.min("t").alias("original"))
    quotes = parsed.select(*key, F.explode("__quotes").alias("q")).select("c", "t", "q.level", "q.hash").filter("c IS NOT NULL AND t IS NOT NULL").distinct()
    linked = quotes.join(originals, ["c", "hash"]).filter("original < t")
    best = F.min(F.struct("level", (-F.col("original")).alias("o")))
    parents = linked.groupBy("c", "t").agg(F.count("*").alias("n_linked"), best.alias("b"))
    parents = materialise(parents.select("c", "t", "n_linked", (-F.col("b.o")).alias("parent")))

    # Rows that have reached their root leave; of a thread whose replies are a third of all rows, the
    # others meet at ancestors that have a parent themselves.
    jumps, done = parents.select("c", "t", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), []
    steps = jumps.select("c", F.col("t").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
    while True:
        joined = jumps.join(steps, ["c", "root"], "left")
        joined = materialise(joined.select("c", "t", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        done.append(joined.filter("NOT moved").drop("moved"))
        jumps = joined.filter("moved").drop("moved")
        if not jumps.limit(1).count():
            break
        # A row jumps by what its ancestor has jumped so far, be that ancestor done or not.
        known = reduce(DataFrame.union, [*done, jumps])
        steps = known.select("c", F.col("t").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
    links = parents.join(reduce(DataFrame.union, done), ["c", "t"])
    on = (F.col(quoted(conversation)) == F.col("c")) & (F.col(quoted(turn)) == F.col("t"))
    found = parsed.join(links, on, "left")
    named = [quoted(x) for x in messages.columns if x != text]
    return found.select(
        *named,
        "body",
        F.concat(F.lit("<|"), F.coalesce(F.col(quoted(role)).cast("string"), F.lit("")), F.lit("|>\n"), F.col("body")).alias("message"),
        F.size("__quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", F.col(quoted(turn))).alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parse(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
        quotes = pa.array([[{"level": level, "hash": h} for level, h in q] for _, _, q in found], pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.string())])))
        added = [pa.array([b for b, _, _ in found], pa.string()), pa.array([o for _, o, _ in found], pa.list_(pa.string())), quotes]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "body", "__own", "__quotes"])
