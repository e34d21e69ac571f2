"""Secret scanning by corpus-wide ownership, in DataFrame operations only.

Candidates are assignments, access keys, long hex runs and long mixed tokens.  Their hashes are
counted by distinct owners and by distinct repositories (an owner's documents): what ``shared``
or more owners hold, or ``copied`` or more repositories, is a widely copied example; what few
repositories of few owners hold looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import materialise, quoted, without

KINDS = ("assign", "access", "hex", "live")
MARKS = ["<SECRET>"] * len(KINDS)
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+"
_CREDENTIAL = "struct<start:int,stop:int,hash:string>"


def base_spans(text: Column) -> Column:
    """Base matches of a text, by start and then kind."""
    assign = F.filter(spans.matches(text, ASSIGN, 0, text.contains("=") | text.contains(":")), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= 8)
    access = F.filter(spans.matches(text, ACCESS, 1, text.contains("AKIA")), lambda x: F.length(x["value"]) >= 16)
    return spans.ordered(assign, access, spans.matches(text, HEX, 2, text.rlike("[0-9a-f]{32}")))


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, stop, hash) of credentials: the values of base matches, then mixed tokens
    (upper and lower case and digits) that overlap none of them; equal spans once."""

    def of_base(x: Column) -> Column:
        value = F.when(x["kind"] == 0, F.regexp_extract(x["value"], ASSIGN, 1)).otherwise(x["value"])
        return F.struct((x["stop"] - F.length(value)).alias("start"), x["stop"].alias("stop"), F.sha2(value, 256).alias("hash"))

    loose = F.filter(spans.matches(text, MIXED, 3, text.rlike("[A-Za-z0-9+/_=-]{24}")), lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]") & ~spans.overlaps(base, x["start"], x["stop"]))
    return F.array_distinct(F.concat(F.transform(base, of_base), F.transform(loose, lambda x: F.struct(x["start"], x["stop"], F.sha2(x["value"], 256).alias("hash")))))


def ownership(held: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of rows (owner, repository, credentials)."""
    each = held.select("owner", "repository", F.explode(F.array_distinct(F.transform("credentials", lambda x: x["hash"]))).alias("hash"))
    by_owner = each.distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", shared: int = 3, copied: int = 10) -> DataFrame:
    """``docs`` with ``base`` (spans of the base matches), ``live`` (spans of credentials that fewer
    than ``shared`` owners and fewer than ``copied`` repositories hold), ``n_example`` (credentials
    that more hold) and ``redacted``, the text without base and live spans.

    Spans are (start, kind, stop, value) in code points, stop exclusive.  Null texts count as empty
    and stay null in ``redacted``.  Null owners are one owner; null repositories go by their text.
    Repeated rows count once.  Input columns named like a result are replaced; an empty table gives
    no rows.
    """
    docs = without(docs, "base", "live", "n_example", "redacted", "__text", "__key", "__all")
    rows = docs.withColumn("__text", F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))).withColumn("base", base_spans(F.col("__text")))
    rows = rows.withColumn("__all", candidates(F.col("__text"), F.col("base")))
    rows = rows.withColumn("__key", F.when(F.size("__all") > 0, F.sha2("__text", 256)))
    held = rows.filter(F.size("__all") > 0).select(
        F.coalesce(F.col(quoted(owner)).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(quoted(repository)).cast("string"), F.col("__key")).alias("repository"),
        F.col("__key").alias("key"),
        F.col("__all").alias("credentials"),
    )
    held = materialise(held)
    owned = ownership(held).filter((F.col("n_owners") < shared) & (F.col("n_repositories") < copied)).select("hash")
    owned = spans.broadcast_if_small(materialise(owned), "hash")
    texts = held.groupBy("key").agg(F.first("credentials").alias("credentials"))
    each = texts.select("key", F.explode("credentials").alias("x")).select("key", "x.start", "x.stop", "x.hash").join(owned, "hash")
    span = F.struct(F.col("start"), F.lit(3).alias("kind"), F.col("stop"), F.col("hash").alias("value"))
    found = each.groupBy("key").agg(F.array_sort(F.collect_set(span)).alias("live")).select(F.col("key").alias("__key"), F.col("live").cast(f"array<{spans.SPAN}>").alias("live"))
    found = spans.broadcast_if_small(materialise(found), "__key", "live")
    rows = rows.withColumn("__key", F.coalesce("__key", F.monotonically_increasing_id().cast("string")))
    rows = rows.join(found, "__key", "left").withColumn("live", F.coalesce("live", spans.none()))
    clean = F.when(F.col(quoted(text)).isNotNull(), spans.replaced(F.col("__text"), spans.ordered("base", "live"), MARKS))
    examples = (F.size("__all") - F.size("live")).cast("long")
    return rows.withColumns({"n_example": examples, "redacted": clean}).select(*[quoted(c) for c in docs.columns], "base", "live", "n_example", "redacted")
