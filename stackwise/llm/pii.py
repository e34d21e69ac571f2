"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

E-mail addresses, IP numbers, card numbers and phone numbers are the protected entities.  Words of
the texts that hold them are judged by corpus statistics: with document frequencies df over N
documents, a term t discloses entity e by PMI(e; t) / IC(e), where PMI = log2(df(e,t) N / (df(e) df(t)))
and IC = log2(N / df(e)).  The ratio counts in full where the term shares ``support`` documents with
the entity, or stands within ``reach`` of it in as many, or in all of the entity's if it has fewer;
below that it counts in proportion.  From ``disclose`` on a term is generalised to the class that its
shape shows (a name, an acronym, any other word), from ``remove`` on it is removed, wherever it stands
in a text with the entity.  Ratios are rounded, so that a term at a threshold is judged alike everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import materialise, quoted, without

KINDS = ("email", "ip", "card", "phone", "term", "removed_term", "name_term", "acronym_term")
MARKS = ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", "", "<NAME>", "<ACRONYM>"]
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"\p{L}{3,}+"


def base_spans(text: Column) -> Column:
    """The entities of a text, by start and then kind."""
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    email = spans.matches(text, EMAIL, 0, text.contains("@"))
    ip = F.filter(spans.matches(text, IP, 1, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    card = F.filter(spans.matches(text, CARD, 2, text.rlike(r"[0-9](?:[ -]?[0-9]){13}")), lambda x: F.length(digits(x)).between(14, 19) & F.call_function("luhn_check", digits(x)))
    phone = F.filter(spans.matches(text, PHONE, 3, text.contains("+")), lambda x: F.length(digits(x)).between(10, 15))
    return spans.ordered(email, ip, card, phone)


def _entity(x: Column) -> Column:
    plain = F.when(x["kind"] == 0, F.lower(x["value"])).when(x["kind"] == 1, x["value"]).otherwise(F.regexp_replace(x["value"], "[^0-9]", ""))
    return F.concat(x["kind"].cast("string"), F.lit(":"), plain)


def _near(text: Column, base: Column, reach: int) -> Column:
    """Array of distinct (entity, term): words of three letters or more that lie whole within
    ``reach`` characters of an entity and overlap none."""

    def side(x: Column, opens: Column, size: Column) -> Column:
        part = F.substring(text, opens + 1, size)
        whole = lambda t: ((t["start"] > 0) | (opens == 0) | (opens == x["stop"])) & ((t["stop"] < F.length(part)) | (opens + F.length(part) == F.length(text)) | (opens + F.length(part) == x["start"]))
        found = F.filter(spans.matches(part, TERM), lambda t: whole(t) & ~spans.overlaps(base, opens + t["start"], opens + t["stop"]))
        return F.transform(found, lambda t: F.struct(_entity(x).alias("entity"), F.lower(t["value"]).alias("term")))

    def both(x: Column) -> Column:
        left = F.greatest(x["start"] - reach, F.lit(0))
        return F.concat(side(x, left, x["start"] - left), side(x, x["stop"], F.lit(reach)))

    return F.array_distinct(F.flatten(F.transform(base, both)))


def _class(word: Column, kind: Column) -> Column:
    """The kind of a word to generalise by its shape; others keep theirs."""
    shape = F.when(word.rlike(r"^\p{Lu}+$"), 7).when(word.rlike(r"^\p{Lu}"), 6).otherwise(4)
    return F.when(kind == 4, shape).otherwise(kind)


def _terms(text: Column, base: Column) -> Column:
    """The distinct words of three letters or more outside the entities."""
    outside = spans.replaced(text, base, [" "] * len(MARKS))
    return F.array_distinct(F.transform(F.regexp_extract_all(outside, F.lit(TERM), F.lit(0)), F.lower))


def _key(text: Column, base: Column) -> Column:
    return F.when(F.size(base) > 0, F.sha2(text, 256))


def disclosures(texts: DataFrame, held: DataFrame, support: int, disclose: float, remove: float) -> DataFrame:
    """(entity, term, kind) of the terms to generalise (kind 4) or to remove (kind 5).  ``held`` has
    one row a distinct text: ``n`` documents with it, its ``entities``, ``words`` and ``near`` pairs.  Of entities
    that are not ``common`` only the near pairs are rated, see ``_common``."""
    shared = held.filter(F.size("common") > 0).select("n", "words", F.explode("common").alias("entity")).select("n", "entity", F.explode("words").alias("term"), F.lit(0).alias("n_near"))
    near = held.select("n", "common", F.explode("near").alias("x"))
    near = near.select(F.when(F.array_contains("common", F.col("x.entity")), 0).otherwise(F.col("n")).alias("n"), "x.entity", "x.term", F.col("n").alias("n_near"))
    pairs = shared.unionByName(near).groupBy("entity", "term").agg(F.sum("n").alias("df_both"), F.sum("n_near").alias("df_near"))
    pairs = materialise(pairs)
    terms = spans.broadcast_if_small(materialise(pairs.select("term").distinct()), "term")
    entities = held.select("n", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("n").alias("df_entity"))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    # Counted before they meet the terms, of which there are more the larger the corpus is.
    n_terms = words.groupBy("term").agg(F.count("*").alias("df_term")).join(terms, "term")
    total = texts.agg(F.count("*").alias("total"))
    ratio = F.log2(F.col("df_both") * F.col("total") / (F.col("df_entity") * F.col("df_term"))) / F.log2(F.col("total") / F.col("df_entity"))
    weight = F.least(F.lit(1.0), F.greatest(F.col("df_both") / support, F.col("df_near") / F.least("df_entity", F.lit(support))))
    rated = pairs.join(entities, "entity").join(n_terms, "term").join(F.broadcast(total))  # one row, by construction
    return rated.filter("df_entity < total").withColumn("ratio", F.round(weight * ratio, 9)).filter(F.col("ratio") >= disclose).select("entity", "term", F.when(F.col("ratio") >= remove, 5).otherwise(4).alias("kind"))


def _common(held: DataFrame, support: int, disclose: float) -> DataFrame:
    """``held`` with ``common``, the entities whose whole texts are to be rated.  A term's ratio is
    one at most, so a far term of an entity in a single document comes to 1 / ``support`` at most:
    below ``disclose`` these need not be counted, and of near ones the document counts are known."""
    each = held.select("key", "n", F.explode("entities").alias("entity"))
    if 1 / support < disclose:
        counts = each.groupBy("entity").agg(F.sum("n").alias("df")).filter("df > 1").drop("df")
        each = each.join(counts, "entity")
    found = spans.broadcast_if_small(materialise(each.groupBy("key").agg(F.collect_list("entity").alias("common"))), "key", "common")
    return held.join(found, "key", "left").withColumn("common", F.coalesce("common", F.expr("CAST(array() AS array<string>)")))


def sanitise(docs: DataFrame, text: str = "text", reach: int = 48, support: int = 3, disclose: float = 0.5, remove: float = 0.95) -> DataFrame:
    """``docs`` with ``base`` (spans of the entities), ``terms`` (spans of disclosing words in
    their texts: kinds 4, 6 and 7 generalised, 5 removed) and ``sanitised``, the text without either.

    Spans are (start, kind, stop, value) in code points, stop exclusive.  Null texts count as empty
    and stay null in ``sanitised``.  Copies count as documents each.  Input columns named like a
    result are replaced; an empty table gives no rows.  Words are lower-cased as a whole; a word
    whose lower case differs in length keeps its own position.
    """
    docs = without(docs, "base", "terms", "sanitised", "__text", "__key")
    rows = docs.withColumn("__text", F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))).withColumn("base", base_spans(F.col("__text")))
    rows = rows.withColumn("__key", _key(F.col("__text"), F.col("base")))

    texts = docs.select(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    held = texts.withColumn("base", base_spans(F.col("text"))).filter(F.size("base") > 0)
    held = held.groupBy("text").agg(F.count("*").alias("n")).withColumn("base", base_spans(F.col("text")))
    held = held.select(F.sha2("text", 256).alias("key"), "n", "text", "base", F.array_distinct(F.transform("base", _entity)).alias("entities"), _terms(F.col("text"), F.col("base")).alias("words"), _near(F.col("text"), F.col("base"), reach).alias("near"))
    held = _common(materialise(held), support, disclose)
    rated = spans.broadcast_if_small(materialise(disclosures(texts, held, support, disclose, remove)), "entity", "term")
    each = held.filter(F.size("common") > 0).select("key", "words", F.explode("common").alias("entity")).select("key", "entity", F.explode("words").alias("term"))
    lone = held.select("key", F.explode(F.filter("near", lambda x: ~F.array_contains("common", x["entity"]))).alias("x")).select("key", "x.entity", "x.term")
    each = each.unionByName(lone).join(rated, ["entity", "term"]).groupBy("key", "term").agg(F.max("kind").alias("kind"))
    kinds = each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    marked = held.select("key", "text", "base").join(kinds, "key")
    own = F.filter(spans.looked_up(F.col("text"), TERM, F.col("kinds"), _class), lambda x: ~spans.overlaps(F.col("base"), x["start"], x["stop"]))
    found = materialise(marked.select(F.col("key").alias("__key"), own.cast(f"array<{spans.SPAN}>").alias("terms")))
    found = spans.broadcast_if_small(found, "__key", "terms")
    # Rows without an entity join nothing; a key of their own keeps them from meeting in one task.
    rows = rows.withColumn("__key", F.coalesce("__key", F.monotonically_increasing_id().cast("string")))
    rows = rows.join(found, "__key", "left").withColumn("terms", F.coalesce("terms", spans.none()))
    clean = F.when(F.col(quoted(text)).isNotNull(), spans.replaced(F.col("__text"), spans.ordered("base", "terms"), MARKS))
    return rows.withColumn("sanitised", clean).select(*[quoted(c) for c in docs.columns], "base", "terms", "sanitised")
