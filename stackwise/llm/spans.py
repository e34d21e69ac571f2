"""Pattern matches with code point positions, as column expressions only.

Java's matcher finds leftmost non-overlapping matches both for ``regexp_extract_all`` and for
``split``, so the lengths of the pieces between matches give the positions in one linear pass.
Patterns passed here must not match the empty text; possessive quantifiers and look-behinds keep
them from scanning a run of characters more than once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,kind:int,stop:int,value:string>"
#: A joined side may be broadcast up to this many characters of content, which is counted first.
BROADCAST_CHARS = 8_000_000


def none(kind: str = SPAN) -> Column:
    return F.expr(f"CAST(array() AS array<{kind}>)")


def matches(text: Column, pattern: str, kind: int = 0, guard: Column | None = None) -> Column:
    """Array of (start, kind, stop, value) of the matches in order.  ``guard``, if given, is a
    cheap condition without which there is no match."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.filter(F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), lambda x: x["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), none().alias("found"))

    def step(acc: Column, x: Column) -> Column:
        opens = acc["at"] + x["gap"]
        stop = opens + F.length(x["value"])
        span = F.struct(opens.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    found = F.aggregate(both, start, step, lambda acc: acc["found"])
    return found if guard is None else F.when(guard, found).otherwise(none())


def looked_up(text: Column, pattern: str, kinds: Column, refined: Callable[[Column, Column], Column]) -> Column:
    """Array of (start, kind, stop, value) of those matches whose lower case is a key of the map
    ``kinds``; the value is in lower case.  Their kind is ``refined`` of the match as it stands and
    the map's value."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.struct(g.alias("gap"), v.alias("word"), F.lower(v).alias("value")))
    rated = F.transform(F.filter(both, lambda x: x["value"].isNotNull()), lambda x: F.struct(x["gap"], F.length(x["word"]).alias("size"), x["value"], refined(x["word"], kinds[x["value"]]).alias("kind")))
    start = F.struct(F.lit(0).alias("at"), none().alias("found"))

    def step(acc: Column, x: Column) -> Column:
        opens = acc["at"] + x["gap"]
        stop = opens + x["size"]
        span = F.struct(opens.alias("start"), x["kind"].alias("kind"), stop.alias("stop"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.when(x["kind"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span))).alias("found"))

    return F.aggregate(rated, start, step, lambda acc: acc["found"])


def ordered(*arrays: Column) -> Column:
    """All spans by start, then kind as listed."""
    return F.array_sort(F.concat(*arrays))


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def overlaps(spans: Column, start: Column, stop: Column) -> Column:
    return F.exists(spans, lambda x: (x["start"] < stop) & (start < x["stop"]))


def replaced(text: Column, spans: Column, marks: list[str]) -> Column:
    """``text`` with each span replaced by the mark of its kind; where spans overlap, the first
    one's mark stands for all."""
    names = F.array(*[F.lit(m) for m in marks])
    state = F.struct(F.lit(0).alias("at"), none("struct<gap:int,from:int,kind:int>").alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        cut = F.struct((x["start"] - acc["at"]).alias("gap"), acc["at"].alias("from"), x["kind"].alias("kind"))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["cuts"], F.array(cut))).otherwise(acc["cuts"]).alias("cuts"))

    done = F.aggregate(spans, state, step)
    # A span inside an earlier one moves "at" only, so the last state tells where the rest begins;
    # a cut's gap starts where the spans before it ended.
    head = F.array_join(F.transform(done["cuts"], lambda c: F.concat(F.substring(text, c["from"] + 1, c["gap"]), F.element_at(names, c["kind"] + 1))), "")
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(head, F.substring(text, done["at"] + 1, F.length(text))))


def broadcast_if_small(df: DataFrame, *content: str) -> DataFrame:
    """``df`` (already materialised) marked for broadcast if the characters in ``content`` and
    40 more for each row come to ``BROADCAST_CHARS`` at most; else as it is, for a shuffled join."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in content])
    total = df.agg(F.coalesce(F.sum(size + 40), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_CHARS else df
