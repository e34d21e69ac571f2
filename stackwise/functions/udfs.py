"""Python functions as Arrow UDFs, by their SQL names.

One table gives each function's Python implementation and types; ``call`` builds a column and
``register`` makes all of them SQL functions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..codecs import breaker, iso2709, marcjson, marcxml
from ..operators import crosswalk_files
from ..types import FIELD_DDL, FIELDS_DDL, RECORD_DDL
from . import crosswalks as X
from . import marcspec as S
from . import records as R
from . import rulepacks
from . import text as T

STRINGS = "array<string>"
DIFF_DDL = "array<struct<kind:string,tag:string,field_no_a:int,field_no_b:int,a:string,b:string>>"
MAPPING_DDL = "array<struct<tag:string,i1:string,i2:string,code:string,value:string>>"
DC_DDL = "struct<title:string,creator:string,subject:array<string>,description:string,publisher:string,contributor:array<string>,date:string,type:string,format:string,identifier:array<string>,language:string,relation:string,coverage:string,rights:string>"


def _on_fields(fn: Callable) -> Callable:
    """Edits of NULL fields are NULL."""
    return lambda fields, *args: None if fields is None else fn(fields, *args)


@cache
def _avram(text: str) -> dict:
    return json.loads(text)


def _spec(leader, fields, spec):
    return None if spec is None else S.evaluate(_parsed_spec(spec), leader, fields)


_parsed_spec = cache(S.parse)


def _validate_format(leader, fields):
    from .expr import FORMATS

    kind = FORMATS.get((leader or "")[6:7], "bibliographic")
    pack = rulepacks.PACKS.get(kind)
    return R.validate_avram(fields, pack) if pack else structure(leader, fields)


def structure(leader, fields):
    """Structural violations of formats without a rule pack (the JVM expression's rules)."""
    if fields is None or leader is None:
        return None
    odd = [f["tag"] for f in fields if len(f["tag"] or "") != 3]
    ids = sum(f["tag"] == "001" for f in fields)
    found = [
        (len(leader) != 24, f"leader is {len(leader)} chars, expected 24"),
        (leader[9:10] not in ("a", " "), f"leader/09 is {leader[9:10]}, expected 'a' or blank"),
        (bool(odd), f"tag not 3 characters: {next(iter(odd), '')}"),
        (ids > 1, f"001 is not repeatable but occurs {ids} times"),
        (any(f["subfields"] is not None and not f["subfields"] for f in fields), "data field with no subfields"),
    ]
    return [text for bad, text in found if bad]


def _pack(name: str) -> Callable:
    return lambda leader, fields: R.validate_avram(fields, rulepacks.PACKS[name])


def _first_json(text):
    return None if text is None else marcjson.parse(text)[0]


#: SQL name -> (function, parameters, result type, category)
FUNCTIONS: dict[str, tuple[Callable, str, str, str]] = {
    "marc_spec": (_spec, "leader, fields, spec", STRINGS, "access"),
    "marc_validate_avram": (lambda leader, fields, schema: None if schema is None else R.validate_avram(fields, _avram(schema)), "leader, fields, schema_json", STRINGS, "validation"),
    "marc_validate_bib": (_pack("bibliographic"), "leader, fields", STRINGS, "validation"),
    "marc_validate_auth": (_pack("authority"), "leader, fields", STRINGS, "validation"),
    "marc_validate_holdings": (_pack("holdings"), "leader, fields", STRINGS, "validation"),
    "marc_validate_format": (_validate_format, "leader, fields", STRINGS, "validation"),
    "marc_add_field": (_on_fields(R.add_field), "fields, field", FIELDS_DDL, "editing"),
    "marc_remove_fields": (_on_fields(R.remove_fields), "fields, tagpat", FIELDS_DDL, "editing"),
    "marc_remove_subfield": (_on_fields(R.remove_subfield), "fields, tagpat, code", FIELDS_DDL, "editing"),
    "marc_set_subfield": (_on_fields(R.set_subfield), "fields, tagpat, code, value", FIELDS_DDL, "editing"),
    "marc_replace_values": (_on_fields(R.replace_values), "fields, tagpat, code, regex, replacement", FIELDS_DDL, "editing"),
    "marc_replace_all": (_on_fields(R.replace_all), "fields, rules", FIELDS_DDL, "editing"),
    "marc_set_indicators": (_on_fields(R.set_indicators), "fields, tagpat, ind1, ind2", FIELDS_DDL, "editing"),
    "marc_swap_fields": (_on_fields(R.swap_fields), "fields, tag_a, tag_b", FIELDS_DDL, "editing"),
    "marc_sort_fields": (_on_fields(R.sort_fields), "fields", FIELDS_DDL, "editing"),
    "marc_rename_subfield": (_on_fields(R.rename_subfield), "fields, tagpat, from_code, to_code", FIELDS_DDL, "editing"),
    "marc_move_field": (_on_fields(R.move_field), "fields, from_tagpat, to_tag", FIELDS_DDL, "editing"),
    "marc_copy_field": (_on_fields(R.copy_field), "fields, tagpat, new_tag", FIELDS_DDL, "editing"),
    "marc_change_case": (_on_fields(R.change_case), "fields, tagpat, code, mode", FIELDS_DDL, "editing"),
    "marc_build_field": (_on_fields(R.build_field), "fields, template", FIELDS_DDL, "editing"),
    "marc_remove_fields_where": (_on_fields(R.remove_fields_where), "fields, tagpat, code, regex", FIELDS_DDL, "editing"),
    "marc_set_linked_uri": (_on_fields(R.set_linked_uri), "fields, tagpat, heading, uri, code", FIELDS_DDL, "linking"),
    "marc_clear_linked_uris": (_on_fields(R.clear_linked_uris), "fields, tagpat, code", FIELDS_DDL, "linking"),
    "marc_merge": (R.merge, "base, incoming, protected, replaced, added, action", FIELDS_DDL, "merging"),
    "marc_diff": (R.diff, "leader_a, fields_a, leader_b, fields_b", DIFF_DDL, "merging"),
    "marc_rank": (R.rank, "leader, fields", "struct<encoding_level_rank:int,completeness:int,total:int>", "quality"),
    "marc_new_record": (R.new_record, "material", RECORD_DDL, "building"),
    "marc_rda_expand": (_on_fields(R.rda_expand), "fields", FIELDS_DDL, "rda"),
    "marc_generate_33x": (lambda leader, fields: None if fields is None else R.generate_33x(leader, fields), "leader, fields", FIELDS_DDL, "rda"),
    "marc_isbn13": (T.isbn13, "value", "string", "identifiers"),
    "marc_issn": (T.issn, "value", "string", "identifiers"),
    "marc_lccn": (T.lccn, "value", "string", "identifiers"),
    "marc_oclc": (T.oclc, "value", "string", "identifiers"),
    "marc_naco": (T.naco, "value", "string", "headings"),
    "marc_fingerprint": (T.fingerprint, "value", "string", "headings"),
    "marc_ngram_fingerprint": (T.ngram_fingerprint, "value, n", "string", "headings"),
    "jaro_winkler_similarity": (T.jaro_winkler, "a, b", "double", "matching"),
    "marc_matchkey": (T.match_key, "fields", "string", "matching"),
    "marc_dedupe_key": (T.match_key, "fields", "string", "matching"),
    "marc_matchkey_of": (T.match_key_of, "title, numbers, year", "string", "matching"),
    "marc_nearest_key": (lambda fields: T.naco(None if (a := X.first(fields, ("245", "a"))) is None else " ".join(v for v in (a, X.first(fields, ("245", "b"))) if v is not None)), "fields", "string", "matching"),
    "marc_headings_naco": (lambda fields: None if fields is None else [T.naco(h) for h in X.headings(fields)], "fields", STRINGS, "headings"),
    "marc_heading_flips": (X.heading_flips, "bib_headings, auth_refs", "array<struct<heading:string,authorized:string>>", "authorities"),
    "marc_authority_refs": (X.authority_refs, "leader, fields", "array<struct<kind:string,tag:string,heading:string>>", "authorities"),
    "marc_parse_json": (_first_json, "json", RECORD_DDL, "codecs"),
    "marc_lcc_parse": (T.lcc_parse, "callnum", "struct<class:string,number:string,decimal:string,cutters:array<string>,year:string,rest:string,valid:boolean>", "call numbers"),
    "marc_lcc_sortkey": (T.lcc_sortkey, "callnum", "string", "call numbers"),
    "marc_ddc_sortkey": (T.ddc_sortkey, "callnum", "string", "call numbers"),
    "marc_cutter_valid": (T.cutter_valid, "cutter", "boolean", "call numbers"),
    "marc_mods_xml": (X.mods_xml, "leader, fields", "string", "crosswalks"),
    "marc_mods_origininfo": (lambda p: None if p is None else X.mods_origin(p["place"], p["publisher"], p["date"]), "publication", "string", "crosswalks"),
    "marc_jsonld": (X.jsonld, "leader, fields", "string", "crosswalks"),
    "marc_jsonld_type": (X.jsonld_type, "leader", "string", "crosswalks"),
    "marc_jsonld_str": (X.json_text, "value", "string", "crosswalks"),
    "marc_jsonld_arr": (X.json_array, "vals", "string", "crosswalks"),
    "marc_jsonld_body": (X.jsonld_body, "leader, fields, dc", STRINGS, "crosswalks"),
    "marc_bf_str": (X.json_text, "value", "string", "bibframe"),
    "marc_bf_obj": (X.json_object, "parts", "string", "bibframe"),
    "marc_bf_chomp": (X.bf_chomp, "value", "string", "bibframe"),
    "marc_bf_chompd": (X.bf_chompd, "value", "string", "bibframe"),
    "marc_bf_date": (X.bf_date, "value", "string", "bibframe"),
    "marc_bf_sfvals": (X.field_values, "field, code", STRINGS, "bibframe"),
    "marc_bf_sf": (X.field_value, "field, code", "string", "bibframe"),
    "marc_bf_sfjoin": (X.bf_sfjoin, "field, codes, sep", "string", "bibframe"),
    "marc_bf_worktype": (X.bf_worktype, "leader", "string", "bibframe"),
    "marc_bf_id": (X.bf_id, "fields", "string", "bibframe"),
    "marc_bf_lang": (X.bf_lang, "fields", "string", "bibframe"),
    "marc_bf_title": (X.bf_title, "fields", "string", "bibframe"),
    "marc_bf_contrib": (X.bf_contrib, "field", "string", "bibframe"),
    "marc_bf_subject": (X.bf_subject, "field", "string", "bibframe"),
    "marc_bf_pubfield": (X.bf_pubfield, "fields", FIELD_DDL, "bibframe"),
    "marc_bf_provision": (X.bf_provision, "field", "string", "bibframe"),
    "marc_bf_ident": (X.bf_ident, "kind, val", "string", "bibframe"),
    "marc_bf_idents": (X.bf_idents, "fields", STRINGS, "bibframe"),
    "marc_bf_vocab": (X.bf_vocab, "vals, base", "string", "bibframe"),
    "marc_bf_contribs": (X.bf_contribs, "fields", STRINGS, "bibframe"),
    "marc_bf_subjects": (X.bf_subjects, "fields", STRINGS, "bibframe"),
    "marc_bf_classes": (X.bf_classes, "fields", STRINGS, "bibframe"),
    "marc_bf_work": (X.bf_work, "leader, fields, uri", "string", "bibframe"),
    "marc_bf_instance": (X.bf_instance, "leader, fields, uri", "string", "bibframe"),
    "marc_bibframe_jsonld": (X.bibframe_jsonld, "leader, fields", "string", "bibframe"),
    "marc_86x_zip": (X.zip_86x, "cap_field, val_field", "array<struct<code:string,cap:string,val:string>>", "holdings"),
    "marc_holdings_pairs": (X.holdings_pairs, "fields", f"array<struct<link:string,caption_field:{FIELD_DDL},value_field:{FIELD_DDL}>>", "holdings"),
    "marc_expand_863": (X.expand_863, "cap_field, val_field", "string", "holdings"),
    "marc_xslt_sheet_file": (crosswalk_files.sheet_file, "alias_or_path", "string", "crosswalks"),
    "marc_xslt_command": (crosswalk_files.command, "crosswalk, input_path, output_path", "string", "crosswalks"),
    "marc_alma_xml_escape": (X.alma_escape, "value", "string", "ils"),
    "marc_alma_bib_body": (X.alma_bib_body, "leader, fields", "string", "ils"),
    "marc_kbart_856": (X.kbart_856, "title_url, link_text", FIELD_DDL, "building"),
    "marc_kbart_to_marc": (X.kbart_to_marc, "publication_title, online_identifier, title_url, publisher_name", RECORD_DDL, "building"),
    "marc_add_local": (lambda fields, tag, i1, i2, codes, vals: None if fields is None else R.add_field(fields, R.data(tag, i1, i2, *zip(codes, vals, strict=True))), "fields, tag, ind1, ind2, codes, vals", FIELDS_DDL, "building"),
    "marc_delimited_clean": (X.delimited_clean, "mapping", MAPPING_DDL, "building"),
    "marc_delimited_build": (X.delimited_build, "mapping", FIELDS_DDL, "building"),
    "marc_delimited_tagsort": (X.delimited_tagsort, "fields", FIELDS_DDL, "building"),
    "marc_delimited_assemble": (X.delimited_assemble, "material, built", RECORD_DDL, "building"),
    "marc_from_delimited": (X.from_delimited, "material, mapping", RECORD_DDL, "building"),
    "marc_from_delimited_url": (X.from_delimited, "material, mapping, url, link_text", RECORD_DDL, "building"),
    "marc_delimited_preset_books": (X.preset_books, "title, author, isbn, publisher, pubyear", MAPPING_DDL, "building"),
    "marc_delimited_preset_serials": (X.preset_serials, "title, issn, publisher", MAPPING_DDL, "building"),
    "marc_delimited_preset_eresources": (X.preset_eresources, "title, url, isbn", MAPPING_DDL, "building"),
    "marc_260c_copyright_year": (X.copyright_year, "value", "string", "rda"),
    "marc_264_publication": (X.publication_264, "field", FIELD_DDL, "rda"),
    "marc_264_copyright": (X.copyright_264, "field", FIELD_DDL, "rda"),
    "marc_264_from_260": (X.fields_264_from_260, "fields", FIELDS_DDL, "rda"),
    "marc_to_iso2709": (lambda leader, fields, encoding, normalize: None if fields is None else iso2709.write(leader, fields, encoding or "utf8", normalize or "nfc"), "leader, fields, encoding, normalize", "binary", "codecs"),
    "marc_to_xml": (lambda leader, fields: None if fields is None else marcxml.write(leader, fields), "leader, fields", "string", "codecs"),
    "marc_to_breaker": (lambda leader, fields: None if fields is None else breaker.write(leader, fields), "leader, fields", "string", "codecs"),
    "marc_to_json": (lambda leader, fields: None if fields is None else marcjson.write(leader, fields), "leader, fields", "string", "codecs"),
}


#: Functions that a filter on their result must not evaluate a second time.
ONCE = {"marc_matchkey_of"}


def rows_of(column: pa.Array | pa.ChunkedArray) -> list:
    """``column.to_pylist()``, by whole child arrays instead of value by value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if pa.types.is_list(kind):
        inner, ends = rows_of(column.values), column.offsets.to_pylist()
        found = [inner[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    elif pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        found = [dict(zip(names, row, strict=True)) for row in zip(*(rows_of(column.field(k)) for k in range(len(names))), strict=True)]
    else:
        return column.to_pylist()
    return [x if ok else None for x, ok in zip(found, column.is_valid().to_pylist(), strict=True)] if column.null_count else found


@cache
def udf(name: str, once: bool = False):
    """The Arrow UDF of a function; ``once`` gives a copy that Catalyst won't duplicate."""
    function, _, ddl, _ = FUNCTIONS[name]
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(ddl))

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*map(rows_of, columns), strict=True)
        return pa.array([function(*row) for row in rows], kind)

    run.__name__ = name
    made = F.arrow_udf(run, ddl)
    return made.asNondeterministic() if once else made


def call(name: str, *arguments: Column | str) -> Column:
    """A column of the function over columns (or SQL expressions)."""
    return udf(name)(*[F.expr(a) if isinstance(a, str) else a for a in arguments])


def call_once(name: str, *arguments: Column | str) -> Column:
    """``call``, marked so that a later filter on the column doesn't evaluate it a second time."""
    return udf(name, True)(*[F.expr(a) if isinstance(a, str) else a for a in arguments])


def register(spark: SparkSession) -> None:
    for name in FUNCTIONS:
        spark.udf.register(name, udf(name, name in ONCE))
