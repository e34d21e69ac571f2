"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each source's budget is met by a threshold on a hash of the document id: sizes are summed by source
and hash bucket, the bucket in which the running sum crosses the budget is found, and only that
bucket is summed again, finer, until one hash is left.  Documents below the threshold are taken;
no document is sorted, and a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, quoted, sheltered, without
from .spans import broadcast_if_small

HASH_BITS, STEP_BITS = 60, 10


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(doc_id: Column) -> Column:
    """A document's place in the mix: 60 bits of the MD5 of its id as text (null: of the empty one)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, repeats: float) -> DataFrame:
    """(key, source_size, target) of (key, source, source_size).  Weights repeat over the sources by
    code point, null last; targets above ``repeats`` times the source's size stop there and the
    excess is shared by weight among the others.  One row a source: windows over them are small."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    each = totals.withColumn("k", F.row_number().over(everything) - 1)
    each = each.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", F.col("source_size") * float(repeats))
    # By cap for weight: the first so many stop at their caps, the rest share what is left.
    ascending = Window.orderBy((F.col("cap") / F.col("w")).asc(), "k")
    whole = Window.partitionBy()
    each = each.withColumn("left", F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(ascending.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    each = each.withColumn("rate", F.col("left") / F.sum("w").over(ascending.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.col("rate") * F.col("w") <= F.col("cap")
    each = each.withColumn("n", F.row_number().over(ascending))
    each = each.withColumn("fair", F.coalesce(F.min(F.when(fits, F.struct("n", "rate"))).over(whole)["rate"], F.lit(float("inf"))))
    return each.select("key", "source_size", F.least(F.col("fair") * F.col("w"), "cap").alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source ``full`` (whole passes), ``low`` (documents at lower positions are taken once more),
    and for those at ``low`` itself: ``need`` words of their ``tied`` words.  ``rows`` has key, size, at."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("full", full).withColumn("need", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long"))
    goals = goals.withColumns({"full": F.when(F.col("need") >= F.col("source_size"), F.col("full") + (F.col("source_size") > 0).cast("long")).otherwise(F.col("full")), "need": F.when(F.col("need") >= F.col("source_size"), F.lit(0)).otherwise(F.col("need"))})
    bounds = materialise(goals.withColumns({"low": F.lit(0).cast("long"), "tied": F.lit(0).cast("long"), "open": F.col("need") > 0}))
    bits = HASH_BITS
    while bits > 0 and bounds.filter("open").limit(1).count():
        bits -= STEP_BITS
        inside = rows.join(broadcast_if_small(bounds.filter("open").select("key", "low"), "key"), "key")
        inside = inside.filter((F.col("at") >= F.col("low")) & (F.shiftright(F.col("at") - F.col("low"), bits) < (1 << STEP_BITS)))
        buckets = inside.groupBy("key", F.shiftright(F.col("at") - F.col("low"), bits).alias("bucket")).agg(F.sum("size").alias("size"), F.min("at").alias("first"), F.max("at").alias("last"))
        running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        crossing = buckets.withColumn("sum", F.sum("size").over(running)).join(bounds.filter("open").select("key", F.col("need").alias("old")), "key").filter("sum > old")
        crossing = crossing.groupBy("key").agg(F.min(F.struct("bucket", "sum", "size", "first", "last")).alias("b"))
        found = bounds.join(crossing, "key", "left")
        one = F.col("b.first") == F.col("b.last")
        low = F.when(one, F.col("b.first")).otherwise(F.col("low") + F.shiftleft(F.col("b.bucket"), bits))
        need = F.col("need") - (F.col("b.sum") - F.col("b.size"))
        some = F.col("b").isNotNull()
        found = found.select("key", "source_size", "target", "full", F.when(some, need).otherwise(F.col("need")).alias("need"), F.when(some, low).otherwise(F.col("low")).alias("low"), F.when(some & one, F.col("b.size")).otherwise(F.col("tied")).alias("tied"), F.coalesce(some & ~one & (need > 0), F.lit(False)).alias("open"))
        bounds = materialise(found)
    return bounds.drop("open")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: float = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words of the text), ``source_size``, ``target`` (words wanted of the
    source) and ``taken`` (words taken of the document, repeats counted: its size for each whole
    pass, and once more below the source's threshold).

    The document at the threshold is taken in part, so that each source meets its target to a word;
    rows of equal id there share it by size, rounded down.  Null texts have no words, null sources
    are a source that comes last, null ids have one position.  An empty table gives no rows; input
    columns named like a result are replaced.  Reruns agree.
    """
    docs, back = sheltered(without(docs, "size", "source_size", "target", "taken"), doc_id, text, source)
    added = {"size": words(F.col(quoted(text)).cast("string")), "at": position(F.col(quoted(doc_id))), "key": _source_key(F.col(quoted(source)))}
    rows = docs.withColumns(added)
    narrow = materialise(rows.select("key", F.col(quoted(source)).cast("string").alias("source"), "size", "at"))
    totals = materialise(narrow.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    bounds = thresholds(narrow.select("key", "size", "at"), targets(totals, weights, share, repeats))
    rows = rows.join(broadcast_if_small(bounds, "key"), "key")
    part = F.floor(F.col("size") * F.col("need") / F.col("tied"))
    once = F.when(F.col("at") < F.col("low"), F.col("size")).when((F.col("at") == F.col("low")) & (F.col("tied") > 0), part).otherwise(F.lit(0))
    taken = (F.col("full") * F.col("size") + once).cast("long")
    return back(rows.withColumn("taken", taken), "size", "source_size", "target", "taken")
