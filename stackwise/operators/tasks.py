"""Workflows of several steps: duplicate reports, RDA upgrades and vendor loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edits as D
from ..functions import expr as E
from ..functions import udfs
from ..types import FIELD_DDL
from .matching import FUZZY_ORDER, dedupe_candidates
from .reports import with_rda_issues


def dedupe_exact(records: DataFrame) -> DataFrame:
    """Groups of records that share a match key."""
    keyed = records.select("control_number", "record_no", udfs.call_once("marc_matchkey_of", *E.match_key_parts("fields")).alias("matchkey")).filter("matchkey IS NOT NULL")
    each = F.array_sort(F.collect_list(F.struct("record_no", "control_number"))).alias("own")
    grouped = keyed.groupBy("matchkey").agg(F.count("*").alias("records"), each).filter("records > 1")
    return grouped.select("matchkey", "records", F.expr("transform(own, x -> x.control_number)").alias("control_numbers"), F.expr("transform(own, x -> x.record_no)").alias("record_nos")).orderBy(F.desc("records"), "matchkey")


def dedupe_fuzzy(records: DataFrame, threshold: float, block: str | None = None) -> DataFrame:
    return dedupe_candidates(records, threshold, block, FUZZY_ORDER)


def dedupe_keepers(records: DataFrame) -> DataFrame:
    """Of each group the record of highest rank; of equal ones the first."""
    rank = F.expr(E.rank("leader", "fields"))
    keyed = records.select("control_number", "record_no", udfs.call_once("marc_matchkey_of", *E.match_key_parts("fields")).alias("matchkey"), rank.alias("rank")).filter("matchkey IS NOT NULL")
    best = F.min(F.struct((-F.col("rank.total")).alias("r"), "record_no", "control_number")).alias("best")
    grouped = keyed.groupBy("matchkey").agg(F.count("*").alias("records"), best).filter("records > 1")
    return grouped.select("matchkey", "records", F.col("best.control_number").alias("keep_control_number"), F.col("best.record_no").alias("keep_record_no"), (-F.col("best.r")).alias("keeper_rank")).orderBy(F.desc("records"), "matchkey")


def rda_profile(records: DataFrame) -> DataFrame:
    return with_rda_issues(records).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "issue")


def rda_worklist(records: DataFrame) -> DataFrame:
    found = with_rda_issues(records).filter(F.size("issues") > 0)
    return found.select("record_no", "control_number", F.expr(E.place("fields", "245a")).alias("title"), "issues").orderBy(F.desc(F.size("issues")), "record_no")


def rda_upgraded(records: DataFrame) -> DataFrame:
    """``records`` with 33X fields, spelt-out abbreviations, $e rda, no 245$h and Leader/18 set.  Only
    the 33X fields need Python; the other edits are expressions."""
    made = records.withColumn("fields", udfs.call("marc_generate_33x", F.col("leader"), F.expr(D.remove_subfield("fields", "245", "h"))))
    return made.withColumns({"fields": F.expr(D.set_subfield(D.rda_expand("fields"), "040", "e", "'rda'")), "leader": F.expr("concat(substring(leader, 1, 18), 'i', substring(leader, 20, 99))")})


def rda_upgrade_file(records: DataFrame) -> DataFrame:
    """Upgraded where there are issues, else as they are."""
    found = with_rda_issues(records).withColumn("old", F.struct("leader", "fields"))
    made = rda_upgraded(found).withColumn("new", F.struct("leader", "fields"))
    return made.select(F.when(F.size("issues") > 0, F.col("new")).otherwise(F.col("old")).alias("r")).select("r.leader", "r.fields")


def stamped(fields: str, org: str) -> str:
    """The expression that adds a 949 with the organisation and today's date."""
    parts = f"array(named_struct('code', 'a', 'value', {E.q(org)}), named_struct('code', 'd', 'value', date_format(current_date(), 'yyyy-MM-dd')))"
    return D.add_field(fields, f"CAST(named_struct('tag', '949', 'ind1', ' ', 'ind2', ' ', 'value', CAST(NULL AS STRING), 'subfields', {parts}) AS {FIELD_DDL})")


def vendor_load(records: DataFrame, org: str) -> DataFrame:
    """Without vendor 9XX fields and 856$9, stamped."""
    return records.select("leader", F.expr(stamped(D.remove_subfield(D.remove_fields("fields", "9.."), "856", "9"), org)).alias("fields"))


def vendor_report(records: DataFrame) -> DataFrame:
    """What there is to know of each record before a load."""
    found = with_rda_issues(records)
    return found.select(
        "record_no",
        "control_number",
        F.expr(E.format_of("leader")).alias("format"),
        udfs.call("marc_validate_format", "leader", "fields").alias("violations"),
        F.size("issues").alias("rda_issues"),
        F.expr("size(filter(fields, f -> f.tag RLIKE '^9..$'))").alias("vendor_9xx_dropped"),
        F.expr(E.place("fields", "245a")).alias("title"),
    )
