"""All functions by SQL name: parameters, kind, category; and their registration in a session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..types import FIELD_DDL, FIELDS_DDL, RECORD_DDL
from . import edits as D
from . import expr as E
from . import udfs
from .expr import q

_TYPES = {"record": RECORD_DDL, "fields": FIELDS_DDL, "field": FIELD_DDL, "pos": "int", "start_pos": "int", "len": "int", "is_books": "boolean", "count_": "int", "max_records": "int", "limit_": "int", "validate": "boolean", "stale_version_check": "boolean", "lim": "int", "off": "int", "k": "double"}


@dataclass(frozen=True)
class SqlFunction:
    """A SQL function whose body is an expression in its parameters; ``name=default`` is optional."""

    parameters: str
    body: Callable[..., str]
    category: str

    def statement(self, name: str) -> str:
        declared, used = [], []
        for p in self.parameters.split(", "):
            key, _, default = p.partition("=")
            declared.append(f"{key} {_TYPES.get(key, 'string')}" + (f" DEFAULT {default}" if default else ""))
            used.append(key)
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(declared)}) RETURN {self.body(*used)}"


def _area(n: int) -> Callable[..., str]:
    return lambda *args: E.isbd_areas(args[0] if len(args) > 1 else "''", args[-1])[n]


def _stamp(org: str) -> str:
    """The 949 field with the organisation and today's date."""
    parts = f"array(named_struct('code', 'a', 'value', {org}), named_struct('code', 'd', 'value', date_format(current_date(), 'yyyy-MM-dd')))"
    return f"CAST(named_struct('tag', '949', 'ind1', ' ', 'ind2', ' ', 'value', CAST(NULL AS STRING), 'subfields', {parts}) AS {FIELD_DDL})"


def _upgraded(leader: str, fields: str) -> str:
    """Only the 33X fields need Python."""
    made = f"marc_generate_33x({leader}, {D.remove_subfield(fields, '245', 'h')})"
    return f"named_struct('leader', concat(substring({leader}, 1, 18), 'i', substring({leader}, 20)), 'fields', {D.set_subfield(D.rda_expand(made), '040', 'e', q('rda'))})"


EXPRESSIONS: dict[str, SqlFunction] = {
    "marc_leader_pos": SqlFunction("leader, pos", E.leader_pos, "access"),
    "marc_control_pos": SqlFunction("val, start_pos, len", E.control_pos, "access"),
    "marc_record_type": SqlFunction("leader", E.record_type, "access"),
    "marc_bib_level": SqlFunction("leader", E.bib_level, "access"),
    "marc_encoding_scheme": SqlFunction("leader", E.encoding_scheme, "access"),
    "marc_fields": SqlFunction("fields, tag_", E.fields_of, "access"),
    "marc_subfields": SqlFunction("fields, tag_, code_", E.subfields, "access"),
    "marc_subfield": SqlFunction("fields, tag_, code_", E.subfield, "access"),
    "marc_control_field": SqlFunction("fields, tag_", E.control_field, "access"),
    "marc_fieldbreak": SqlFunction("field", E.fieldbreak, "display"),
    "marc_recordbreak": SqlFunction("leader, fields", E.recordbreak, "display"),
    "marc_format": SqlFunction("leader", E.format_of, "access"),
    "marc_validate": SqlFunction("leader, fields", E.validate, "validation"),
    "marc_folio_check": SqlFunction("leader, fields", E.folio_check, "validation"),
    "marc_trim_punct": SqlFunction("s", E.trim_punct, "display"),
    "marc_xml_escape": SqlFunction("s", E.xml_escape, "display"),
    "marc_leader_struct": SqlFunction("leader", E.leader_struct, "access"),
    "marc_008_books": SqlFunction("v", E.books_008, "access"),
    "marc_008_parts": SqlFunction("v, is_books", E.parts_008, "access"),
    "marc_008_struct": SqlFunction("leader, fields", E.struct_008, "access"),
    "marc_instance": SqlFunction("leader, fields", E.instance, "crosswalks"),
    "marc_type_of_resource": SqlFunction("leader", E.type_of_resource, "crosswalks"),
    "marc_dublin_core": SqlFunction("leader, fields", E.dublin_core, "crosswalks"),
    "marc_uris": SqlFunction("fields", E.uris, "linking"),
    "marc_sf01": SqlFunction("fields", E.sf01, "linking"),
    "marc_ids_lc": SqlFunction("fields", E.ids_lc, "linking"),
    "marc_ids_viaf": SqlFunction("fields", E.ids_viaf, "linking"),
    "marc_ids_fast": SqlFunction("fields", E.ids_fast, "linking"),
    "marc_heading_join": SqlFunction("field", E.heading_join, "headings"),
    "marc_headings": SqlFunction("fields", E.headings, "headings"),
    "marc_urls_856": SqlFunction("fields", E.urls_856, "linking"),
    "marc_rda_check": SqlFunction("leader, fields", lambda leader, fields: E.rda_check(leader, fields, D.rda_expand(fields)), "rda"),
    "marc_variant": SqlFunction("leader, fields", E.variant, "codecs"),
    "marc_variant_record": SqlFunction("record", lambda record: E.variant(f"{record}.leader", f"{record}.fields"), "codecs"),
    "marc_isbd_nn": SqlFunction("v", E.nonempty, "international"),
    **{f"marc_isbd_area{n}": SqlFunction("fields", _area(n), "international") for n in (1, 2, 4, 5, 6)},
    "marc_isbd_area8": SqlFunction("leader, fields", _area(8), "international"),
    "marc_isbd": SqlFunction("leader, fields", E.isbd, "international"),
    "marc_unimarc_label": SqlFunction("leader", E.unimarc_label, "international"),
    "marc_from_unimarc_label": SqlFunction("label", E.from_unimarc_label, "international"),
    "marc_oai_url": SqlFunction("base, metadata_prefix='marc21', set_=NULL, from_=NULL, until_=NULL", E.oai_url, "services"),
    "marc_oai_page_url": SqlFunction("base, resumption_token", E.oai_page_url, "services"),
    "marc_oai_extract_token": SqlFunction("xml", E.oai_extract_token, "services"),
    "marc_idloc_label_url": SqlFunction("label, scheme='names'", E.idloc_label_url, "services"),
    "marc_idloc_suggest_url": SqlFunction("term, scheme='names', count_=5", E.idloc_suggest_url, "services"),
    "marc_viaf_search_url": SqlFunction("term, index_='local.mainHeadingEl', max_records=5", E.viaf_search_url, "services"),
    "marc_wikidata_search_url": SqlFunction("term, language='en', limit_=5", E.wikidata_search_url, "services"),
    "marc_idloc_candidates": SqlFunction("j", E.idloc_candidates, "services"),
    "marc_viaf_candidates": SqlFunction("j", E.viaf_candidates, "services"),
    "marc_wikidata_candidates": SqlFunction("j", E.wikidata_candidates, "services"),
    "marc_alma_put_url": SqlFunction("base, mms_id, apikey=NULL, validate=false, stale_version_check=false", E.alma_put_url, "ils"),
    "marc_alma_headers": SqlFunction("apikey", E.alma_headers, "ils"),
    "marc_alma_sql_quote": SqlFunction("s", E.sql_quote, "ils"),
    "marc_nearest_sql_quote": SqlFunction("s", E.sql_quote, "matching"),
    "marc_alma_put_sql": SqlFunction("base, mms_id, apikey, bib_body, validate=false, stale_version_check=false", E.alma_put_statement, "ils"),
    "marc_nearest_matches_sql": SqlFunction("query_path, target_path, k", E.nearest_statement, "matching"),
    "marc_xslt_shell_arg": SqlFunction("s", E.shell_arg, "crosswalks"),
    "marc_stamp": SqlFunction("fields, org_code", lambda fields, org: f"marc_add_local({fields}, '949', ' ', ' ', array('a', 'd'), array({org}, date_format(current_date(), 'yyyy-MM-dd')))", "building"),
    "task_vendor_clean": SqlFunction("fields, org_code", lambda fields, org: D.add_field(D.remove_subfield(D.remove_fields(fields, "9.."), "856", "9"), _stamp(org)), "tasks"),
    "task_rda_upgrade": SqlFunction("leader, fields", _upgraded, "tasks"),
}


def register_all(spark: SparkSession) -> list[str]:
    """Makes every function a temporary SQL function of the session; the names."""
    udfs.register(spark)
    for name, function in EXPRESSIONS.items():
        spark.sql(function.statement(name))
    return sorted([*udfs.FUNCTIONS, *EXPRESSIONS])


def describe() -> list[tuple[str, str, str]]:
    """(name, parameters, category) of every function."""
    found = [(n, p, c) for n, (_, p, _, c) in udfs.FUNCTIONS.items()]
    return sorted(found + [(n, f.parameters, f.category) for n, f in EXPRESSIONS.items()])
