"""Profiles of record collections.  Every function takes records in the nested shape and reads no
more of them than it reports on.

What is counted per record is counted in the record's own arrays, so nothing is shuffled by record:
one exchange carries a row for each tag or code of a task.  The expressions below are shared with
the SQL table functions of :mod:`stackwise.sources.sql_tables`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edits as D
from ..functions import expr as E
from ..sources.readers import to_fields, to_subfields

#: Weights of the completeness score.
COMPLETENESS = {"has_title": 30, "has_author": 15, "has_subject": 15, "has_isbn": 10, "has_language": 10, "has_publication": 10, "has_physical": 10}
FLAGS = {
    "has_title": f"{E.place('fields', '245a')} IS NOT NULL",
    "has_author": E.has_tag("fields", "100", "110", "111"),
    "has_subject": "exists(fields, f -> f.tag LIKE '6%')",
    "has_isbn": f"size({E.subfields('fields', E.q('020'), E.q('a'))}) > 0",
    "has_language": f"{E.language_008('fields')} IS NOT NULL OR size({E.subfields('fields', E.q('041'), E.q('a'))}) > 0",
    "has_publication": E.has_tag("fields", "260", "264"),
    "has_physical": E.has_tag("fields", "300"),
}
SCORE = " + ".join(f"{w} * CAST({k} AS INT)" for k, w in COMPLETENESS.items())
#: Fields that have a value or a subfield, and how many of either.
FULL = "filter(fields, f -> f.subfields IS NULL OR size(f.subfields) > 0)"
_ROWS = "IF(f.subfields IS NULL, 1, size(f.subfields))"
SUBFIELD_ROWS = f"aggregate(fields, 0L, (n, f) -> n + {_ROWS})"
#: A record's tags with their occurrences, and of its full fields also with the rows they make.
TAG_COUNTS = "transform(array_distinct(transform(fields, f -> f.tag)), t -> struct(t AS tag, CAST(size(filter(fields, f -> f.tag <=> t)) AS BIGINT) AS n))"
FIELD_COUNTS = f"transform(array_distinct(transform({FULL}, f -> f.tag)), t -> struct(t AS tag, CAST(size(filter({FULL}, f -> f.tag <=> t)) AS BIGINT) AS occurrences, aggregate(filter({FULL}, f -> f.tag <=> t), 0L, (n, f) -> n + {_ROWS}) AS subfields))"


def tag_parts(tag: str) -> str:
    """The subfields of a record's fields with ``tag`` (an SQL expression)."""
    return f"flatten(transform(filter(fields, f -> f.tag = {tag} AND f.subfields IS NOT NULL), f -> f.subfields))"


def code_counts(tag: str) -> str:
    """A record's subfield codes of one tag with their occurrences."""
    codes = f"transform({tag_parts(tag)}, s -> s.code)"
    return f"transform(array_distinct({codes}), c -> struct(c AS code, CAST(size(filter({codes}, x -> x <=> c)) AS BIGINT) AS n))"


def code_values(tag: str) -> str:
    """A record's subfields of one tag, each with whether it is the record's first of its code."""
    parts = tag_parts(tag)
    return f"transform({parts}, (s, i) -> struct(s.code AS code, octet_length(s.value) AS len, NOT exists(slice({parts}, 1, i), x -> x.code <=> s.code) AS first))"


def _share(part: str, whole: str, digits: int = 1):
    return F.round(F.lit(100.0) * F.col(part) / F.col(whole), digits)


def report_tags(records: DataFrame) -> DataFrame:
    """Per tag: occurrences, records with it and their share in percent."""
    per_tag = records.select(F.explode(F.expr(TAG_COUNTS)).alias("t")).groupBy("t.tag").agg(F.sum("t.n").alias("count"), F.count("*").alias("records_with"))
    total = records.agg(F.count("*").alias("total"))
    joined = per_tag.join(F.broadcast(total))  # one row
    return joined.select("tag", "count", "records_with", _share("records_with", "total").alias("pct_records")).orderBy("tag")


def report_subfields(records: DataFrame, tag: str) -> DataFrame:
    """Per code of one tag: occurrences and records with it."""
    each = records.select(F.explode(F.expr(code_counts(E.q(tag)))).alias("c"))
    return each.groupBy("c.code").agg(F.sum("c.n").alias("count"), F.count("*").alias("records_with")).orderBy("code")


def report_completeness(records: DataFrame) -> DataFrame:
    """Seven flags and a score from 0 to 100 for each record."""
    found = records.select("file", "record_no", "control_number", *[F.expr(v).alias(k) for k, v in FLAGS.items()])
    return found.withColumn("completeness", F.expr(SCORE)).orderBy("file", "record_no")


def report_errors(records: DataFrame) -> DataFrame:
    """One row for each structural violation."""
    return records.select("file", "record_no", "control_number", F.explode(F.expr(E.validate("leader", "fields"))).alias("violation")).orderBy("file", "record_no")


def summary(records: DataFrame) -> DataFrame:
    """One row of totals and distributions over all records that have a subfield or control field."""
    each = records.select("file", "leader", F.expr(f"CAST(size({FULL}) AS BIGINT)").alias("fields"), F.expr(SUBFIELD_ROWS).alias("subfields"), F.expr(f"size(array_distinct(transform({FULL}, f -> f.tag)))").alias("tags")).filter("fields > 0")
    spread = []
    for name in ("fields", "subfields"):
        spread += [F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}"), F.round(F.avg(name), 2).alias(f"mean_{name}"), F.round(F.stddev_samp(name), 2).alias(f"stddev_{name}")]
    marc8 = F.sum(F.expr(f"CAST({E.encoding_scheme('leader')} = 'marc8' AS BIGINT)"))
    return each.agg(F.count("*").alias("records"), F.count_distinct("file").alias("files"), F.sum("fields").alias("total_fields"), F.sum("subfields").alias("total_subfields"), *spread, F.round(F.avg("tags"), 2).alias("mean_distinct_tags"), marc8.alias("marc8_records"))


def summary_fields(records: DataFrame) -> DataFrame:
    """Per tag: how often it occurs, overall and per record that has it."""
    each = records.select(F.expr(FIELD_COUNTS).alias("tags")).filter("size(tags) > 0")
    found = each.select(F.explode("tags").alias("t")).select("t.*").groupBy("tag").agg(
        F.sum("occurrences").alias("total_occurrences"),
        F.count("*").alias("records_with"),
        F.min("occurrences").alias("min_per_record"),
        F.max("occurrences").alias("max_per_record"),
        F.round(F.avg("occurrences"), 2).alias("mean_per_record"),
        F.round(F.stddev_samp("occurrences"), 2).alias("stddev_per_record"),
        F.round(F.sum("subfields") / F.sum("occurrences"), 2).alias("mean_subfields_per_field"),
    )
    joined = found.join(F.broadcast(each.agg(F.count("*").alias("total"))))  # one row
    return joined.withColumn("pct_records", _share("records_with", "total")).drop("total").orderBy("tag")


def summary_subfields(records: DataFrame, tag: str) -> DataFrame:
    """Per code of one tag: counts and lengths in bytes."""
    each = records.select(F.explode(F.expr(code_values(E.q(tag)))).alias("s")).select("s.*").groupBy("code").agg(
        F.count("*").alias("occurrences"), F.sum(F.col("first").cast("long")).alias("records_with"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.round(F.avg("len"), 1).alias("mean_len"), F.round(F.stddev_samp("len"), 1).alias("stddev_len")
    )
    return each.orderBy("code")


def check_urls(records: DataFrame) -> DataFrame:
    """Addresses of the 856 fields with their scheme and host in lower case."""
    each = records.select("file", "record_no", F.expr(E.control_field("fields", E.q("001"))).alias("control_number"), F.explode(F.expr(E.urls_856("fields"))).alias("u")).select("file", "record_no", "control_number", "u.*")
    scheme = F.lower(F.regexp_extract("uri", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract("uri", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return each.withColumns({"scheme": F.when(F.col("uri").isNotNull(), scheme), "host": F.when(F.col("uri").isNotNull(), host)}).orderBy("file", "record_no")


def with_rda_issues(records: DataFrame) -> DataFrame:
    """``records`` with ``issues``, the codes of pre-RDA practice."""
    return records.withColumn("issues", F.expr(E.rda_check("leader", "fields", D.rda_expand("fields"))))


__all__ = ["check_urls", "report_completeness", "report_errors", "report_subfields", "report_tags", "summary", "summary_fields", "summary_subfields", "to_fields", "to_subfields", "with_rda_issues"]
