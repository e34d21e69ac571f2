"""Registered queries of the SQL table functions, which read record files, and their DuckDB SQL.

The catalogue projection is written once a session and scale to the shared scratch folder, one file
in the order of the records' numbers; the functions read it by their SQL names.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sql_tables
from ..sources.writers import write_records
from . import catalogue as C
from .catalogue import _HEADINGS, _ISSUES, _KEYS, _NACO, _SIZES, _TAGS, query
from .projection import bib

_WRITTEN: dict[tuple[str, str, str], str] = {}


def _file(spark: SparkSession, sf_dir: str, fmt: str = "marc") -> str:
    key = (spark.sparkContext.applicationId, sf_dir, fmt)
    if key not in _WRITTEN:
        top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
        folder = f"{top.rstrip('/')}/stackwise-files/{uuid.uuid4().hex}"
        records = bib(spark, sf_dir, in_order=True)
        write_records(records, folder, fmt, single_file=True)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _WRITTEN[key] = f"{folder}/part-*"
    return _WRITTEN[key]


def ask(spark: SparkSession, sf_dir: str, sql: str, fmt: str = "marc") -> DataFrame:
    """The SQL over the file, whose name is quoted in place of ``$``.  The projection's numbers start
    at 0, a file's at 1."""
    sql_tables.register_for(spark, sql)
    found = spark.sql(sql.replace("$", "'" + _file(spark, sf_dir, fmt) + "'"))
    return found.withColumns({c: F.col(c) - 1 for c in found.columns if "record_no" in c})


def _same_as(name: str) -> str:
    """The SQL of a query of the operator of that name, less the projection's."""
    return C.ORACLE_SQL[name].removeprefix(C.SQL)


@query(_same_as("report_tags"))
def sql_report_tags(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT * FROM marc_report_tags($)")


@query(_same_as("report_subfields"))
def sql_report_subfields(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT * FROM marc_report_subfields($, '100')")


@query(_same_as("report_completeness"))
def sql_report_completeness(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT 'part' AS file, * EXCEPT (file) FROM marc_report_completeness($)")


@query(_same_as("report_errors"))
def sql_report_errors(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT 'part' AS file, * EXCEPT (file) FROM marc_report_errors($)")


@query(_SIZES + "SELECT count(*)::BIGINT AS records, sum(f)::BIGINT AS total_fields, sum(n)::BIGINT AS total_subfields, max(f)::BIGINT AS max_fields, round(avg(n), 2) AS mean_subfields, round(avg(d), 2) AS mean_distinct_tags FROM z")
def sql_summary(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT records, total_fields, total_subfields, max_fields, mean_subfields, mean_distinct_tags FROM marc_summary($)")


@query(_same_as("summary_fields"))
def sql_summary_fields(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT * FROM marc_summary_fields($)")


@query(_same_as("summary_subfields"))
def sql_summary_subfields(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT * FROM marc_summary_subfields($, '245')")


@query(_same_as("check_urls"))
def sql_check_urls(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT 'part' AS file, * EXCEPT (file) FROM marc_check_urls($)")


@query(_same_as("cluster_headings"))
def sql_cluster_headings(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT key, n_headings, n_variants, array_join(members, '|') AS members FROM marc_cluster_headings($, 'fingerprint')")


@query(_same_as("reconcile_headings"))
def sql_reconcile_headings(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT * FROM marc_reconcile_headings($, 'idloc')")


@query(_TAGS + ", n AS (SELECT k, ctl, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS i FROM b) SELECT k AS record_no, ctl AS control_number, i::INT AS field_no, tag FROM n")
def sql_readfields(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, control_number, field_no, tag FROM marc_readfields($)")


_N = ", n AS (SELECT k, unnest(tags) AS tag FROM b) SELECT k AS record_no, count(*)::BIGINT AS fields, string_agg(tag, ' ' ORDER BY tag) AS tags FROM n GROUP BY k"


@query(_N)
def sql_readfieldsxml(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, count(*) AS fields, array_join(array_sort(collect_list(tag)), ' ') AS tags FROM marc_readfieldsxml($) GROUP BY record_no", "marcxml")


@query(_N)
def sql_readfieldsbreaker(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, count(*) AS fields, array_join(array_sort(collect_list(tag)), ' ') AS tags FROM marc_readfieldsbreaker($) GROUP BY record_no", "mrk")


_NESTED = "SELECT k AS record_no, ctl AS control_number, len(tags)::INT AS fields, t1 || ' :' AS title FROM b"


@query(_NESTED)
def sql_read_marc(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, control_number, size(fields) AS fields, marc_subfield(fields, '245', 'a') AS title FROM read_marc($)")


@query(_NESTED)
def sql_readnestedxml(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, control_number, size(fields) AS fields, marc_subfield(fields, '245', 'a') AS title FROM marc_readnestedxml($)", "marcxml")


@query(_NESTED)
def sql_readnestedbreaker(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, control_number, size(fields) AS fields, marc_subfield(fields, '245', 'a') AS title FROM marc_readnestedbreaker($)", "mrk")


_ROWS = _SIZES + "SELECT k AS record_no, n::BIGINT AS subfields FROM z"


@query(_ROWS)
def sql_read_marc_subfields(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, count(*) AS subfields FROM read_marc_subfields($) GROUP BY record_no")


@query(_ROWS)
def sql_read_marcxml(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, count(*) AS subfields FROM read_marcxml($) GROUP BY record_no", "marcxml")


@query(_ROWS)
def sql_read_marc_breaker(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, count(*) AS subfields FROM read_marc_breaker($) GROUP BY record_no", "mrk")


@query(_ROWS)
def sql_read_marcjson(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, count(*) AS subfields FROM read_marcjson($) GROUP BY record_no", "marcjson")


@query("SELECT k AS record_no, ctl AS control_number, NULL::VARCHAR AS error, 'n' || kind || level AS kinds, true AS ends FROM b")
def sql_read_marc_raw(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, control_number, error, substring(leader, 6, 3) AS kinds, hex(raw) LIKE '%1E1D' AS ends FROM read_marc_raw($)")


@query(_KEYS + "SELECT k AS record_no, title, tk AS tkey, mk AS matchkey FROM m")
def sql_nearest_recs(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, title, tkey, matchkey FROM marc_nearest_recs($)")


@query(_same_as("dedupe_candidates"))
def sql_dedupe_candidates(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no_a, record_no_b, round(similarity, 9) AS similarity, same_matchkey FROM marc_dedupe_candidates($, 0.93D)")


@query(_same_as("dedupe_candidates"))
def sql_task_dedupe_fuzzy(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no_a, record_no_b, round(similarity, 9) AS similarity, same_matchkey FROM task_dedupe_fuzzy($, 0.93D)")


@query(_same_as("nearest_dupes"))
def sql_nearest_dupes(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no_a, record_no_b, round(similarity, 9) AS similarity, same_matchkey FROM marc_nearest_dupes($, 0.8D)")


_MATCHES = _KEYS + ", s AS (SELECT x.k AS a, y.k AS b, jaro_winkler_similarity(x.tk, y.tk) AS sim FROM m x, m y), w AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM s WHERE sim IS NOT NULL) SELECT a AS record_no_q, b AS record_no_t, round(sim, 9) AS similarity FROM w WHERE rn <= {}"


@query(_MATCHES.format("5 AND sim >= 0.9"))
def sql_nearest_matches(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no_q, record_no_t, round(similarity, 9) AS similarity FROM marc_nearest_matches($, $, 0.9D)")


@query(_MATCHES.format("2"))
def sql_nearest_matches_k(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no_q, record_no_t, round(similarity, 9) AS similarity FROM marc_nearest_matches_k($, $, 2)")


@query(_HEADINGS + f", g AS (SELECT heading, count(*)::BIGINT AS n_occurrences, {_NACO.format('heading')} AS hk FROM h GROUP BY heading), s AS (SELECT heading, n_occurrences, label, round(jaro_winkler_similarity(hk, {_NACO.format('label')}), 9) AS similarity FROM g, (SELECT unnest(['Things, promo', 'Brand 1', 'Helper Brand', 'Economy Catalogues']) AS label)), w AS (SELECT *, row_number() OVER (PARTITION BY heading ORDER BY similarity DESC, label) AS rn FROM s) SELECT heading, n_occurrences, label, similarity FROM w WHERE rn <= 3 AND similarity >= 0.6")
def sql_nearest_headings(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT heading, n_occurrences, label, round(similarity, 9) AS similarity FROM marc_nearest_headings($, array('Things, promo', 'Brand 1', 'Helper Brand', 'Economy Catalogues'), 0.6D)")


@query(_same_as("task_dedupe_exact"))
def sql_task_dedupe_exact(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT matchkey, records, array_join(control_numbers, '|') AS control_numbers FROM task_dedupe_exact($)")


#: Six tenths of the encoding level's rank, 100 for all, and four of completeness as in ``rank``.
_KEEPERS = _KEYS + ", r AS (SELECT m.mk, m.k, m.ctl, (600 + 4 * ((m.k % 17 <> 0)::INT * 20 + 10 + (m.k % 8 = 0)::INT * 10 + 3 + (m.k % 3 = 0)::INT * 3 + 40))::INT // 10 AS total FROM m) SELECT mk AS matchkey, count(*)::BIGINT AS records, arg_min(ctl, -total * 10000000 + k) AS keep_control_number, arg_min(k, -total * 10000000 + k)::BIGINT AS keep_record_no, max(total)::INT AS keeper_rank FROM r WHERE mk IS NOT NULL GROUP BY mk HAVING count(*) > 1"


@query(_KEEPERS)
def sql_task_dedupe_keepers(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT * FROM task_dedupe_keepers($)")


@query(_same_as("task_rda_profile"))
def sql_task_rda_profile(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT * FROM task_rda_profile($)")


@query(_ISSUES + "SELECT k AS record_no, ctl AS control_number, t1 || ' :' AS title, array_to_string(issues, '|') AS issues FROM i")
def sql_task_rda_worklist(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, control_number, title, array_join(issues, '|') AS issues FROM task_rda_worklist($)")


@query("SELECT ctl AS id, 'n' || kind || level AS kinds, 'i' AS form, 'rda' AS conventions, p_size || ' pages :' AS extent FROM b")
def sql_task_rda_upgrade_file(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT marc_control_field(fields, '001') AS id, substring(leader, 6, 3) AS kinds, substring(leader, 19, 1) AS form, marc_subfield(fields, '040', 'e') AS conventions, marc_subfield(fields, '300', 'a') AS extent FROM task_rda_upgrade_file($)")


@query("SELECT ctl AS id, 'ORG' AS org, true AS dated FROM b")
def sql_task_vendor_load(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT marc_control_field(fields, '001') AS id, marc_subfield(fields, '949', 'a') AS org, marc_subfield(fields, '949', 'd') RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}' AS dated FROM task_vendor_load($, 'ORG')")


@query(_same_as("task_vendor_report"))
def sql_task_vendor_report(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT record_no, format, array_join(violations, '|') AS violations, rda_issues, vendor_9xx_dropped FROM task_vendor_report($)")


@query("SELECT 27::BIGINT AS sheets, 27::BIGINT AS described, 16::BIGINT AS from_marc")
def sql_xslt_functions(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT count(*) AS sheets, count_if(length(description) > 20) AS described, count_if(source_format = 'MARC') AS from_marc FROM marc_xslt_functions()")


@query(_KEYS + "SELECT mk AS matchkey, count(*)::BIGINT AS records, string_agg(ctl, '|' ORDER BY k) AS control_numbers FROM m GROUP BY mk HAVING count(*) > 1")
def copy_round_trip(spark, sf_dir):
    """The projection written through the data source and read back, keyed as before."""
    from ..operators import tasks
    from ..sources.datasource import register_sources

    register_sources(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    folder = f"{top.rstrip('/')}/stackwise-files/{uuid.uuid4().hex}"
    bib(spark, sf_dir).orderBy("record_no").select("leader", "fields").write.format("marcjson").mode("append").save(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    back = spark.read.format("marcjson").load(folder).withColumn("record_no", F.expr("CAST(substring(control_number, 2) AS BIGINT)"))
    return tasks.dedupe_exact(back).select("matchkey", "records", F.array_join("control_numbers", "|").alias("control_numbers"))
