"""Record functions as Spark SQL expressions.

Each function takes and returns SQL text, so that they nest, inline into lambdas, and serve both
``F.expr`` and SQL functions from one definition.  Nothing here leaves the JVM.
"""

from __future__ import annotations

from .crosswalks import HEADING_TAGS, NAMES, RESOURCE_TYPES
from .records import ENCODING_RANKS


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(value: str, items) -> str:
    return f"{value} IN ({', '.join(map(q, items))})"


def case(value: str, table: dict[str, str], default: str = "NULL") -> str:
    groups: dict[str, list[str]] = {}
    for k, v in table.items():
        groups.setdefault(v, []).append(k)
    return "CASE " + " ".join(f"WHEN {in_list(value, ks)} THEN {q(v)}" for v, ks in groups.items()) + f" ELSE {default} END"


def compact(*items: str) -> str:
    return f"array_compact(array({', '.join(items)}))"


def joined(items: str, separator: str) -> str:
    """Elements joined, NULL if there is none."""
    return f"CASE WHEN exists({items}, x -> x IS NOT NULL) THEN array_join({items}, {q(separator)}) END"


def given(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# ---- navigation ------------------------------------------------------------------------------


def control_pos(value: str, start: str | int, size: str | int) -> str:
    return f"substring({value}, {start} + 1, {size})"


def leader_pos(leader: str, pos: str | int) -> str:
    return control_pos(leader, pos, 1)


def record_type(leader: str) -> str:
    return leader_pos(leader, 6)


def bib_level(leader: str) -> str:
    return leader_pos(leader, 7)


def encoding_scheme(leader: str) -> str:
    return f"CASE WHEN {leader_pos(leader, 9)} = 'a' THEN 'utf8' ELSE 'marc8' END"


def fields_of(fields: str, tag: str) -> str:
    return f"filter({fields}, f -> f.tag = {tag})"


def subfields(fields: str, tag: str, code: str) -> str:
    inner = f"flatten(transform(filter({fields}, f -> f.tag = {tag} AND f.subfields IS NOT NULL), f -> f.subfields))"
    return f"transform(filter({inner}, s -> s.code = {code}), s -> s.value)"


def subfield(fields: str, tag: str, code: str) -> str:
    return f"get({subfields(fields, tag, code)}, 0)"


def place(fields: str, spec: str) -> str:
    """First value at a literal place such as ``245a``."""
    return subfield(fields, q(spec[:3]), q(spec[3]))


def control_field(fields: str, tag: str) -> str:
    return f"get(transform({fields_of(fields, tag)}, f -> f.value), 0)"


def field_value(f: str, code: str) -> str:
    return f"get(transform(filter({f}.subfields, s -> s.code = {q(code)}), s -> s.value), 0)"


def has_tag(fields: str, *tags: str) -> str:
    return f"exists({fields}, f -> {in_list('f.tag', tags)})"


def fieldbreak(f: str) -> str:
    blank = lambda x: f"replace({f}.{x}, ' ', '\\\\')"
    body = joined(f"transform({f}.subfields, s -> concat('$', s.code, s.value))", "")
    return f"concat('=', {f}.tag, '  ', CASE WHEN {f}.subfields IS NULL THEN {f}.value ELSE concat({blank('ind1')}, {blank('ind2')}, {body}) END)"


def recordbreak(leader: str, fields: str) -> str:
    return f"concat('=LDR  ', {leader}, '\\n', {joined(f'transform({fields}, f -> {fieldbreak("f")})', chr(10))})"


# ---- fixed fields and checks -----------------------------------------------------------------

#: Formats other than bibliographic by Leader/06.
FORMATS = {"z": "authority", "u": "holdings", "v": "holdings", "x": "holdings", "y": "holdings", "w": "classification", "q": "community"}


def format_of(leader: str) -> str:
    return case(record_type(leader), FORMATS, "'bibliographic'")


def validate(leader: str, fields: str) -> str:
    odd = f"filter({fields}, f -> length(f.tag) != 3)"
    ids = f"size({fields_of(fields, q('001'))})"
    return compact(
        f"CASE WHEN length({leader}) != 24 THEN concat('leader is ', length({leader}), ' chars, expected 24') END",
        f"CASE WHEN {leader_pos(leader, 9)} NOT IN ('a', ' ') THEN concat('leader/09 is ', {leader_pos(leader, 9)}, ', expected \\'a\\' or blank') END",
        f"CASE WHEN size({odd}) > 0 THEN concat('tag not 3 characters: ', get({odd}, 0).tag) END",
        f"CASE WHEN {ids} > 1 THEN concat('001 is not repeatable but occurs ', {ids}, ' times') END",
        f"CASE WHEN {format_of(leader)} = 'bibliographic' AND NOT {has_tag(fields, '245')} THEN 'no 245 (title) field' END",
        f"CASE WHEN exists({fields}, f -> f.subfields IS NOT NULL AND size(f.subfields) = 0) THEN 'data field with no subfields' END",
    )


def folio_check(leader: str, fields: str) -> str:
    return compact(
        f"CASE WHEN NOT {has_tag(fields, '001')} THEN 'no 001: FOLIO data import uses 001 as the incoming record identifier' END",
        f"CASE WHEN {has_tag(fields, '001')} AND NOT {has_tag(fields, '003')} THEN '001 without 003: FOLIO qualifies the 001 control number by the 003 source' END",
        f"CASE WHEN exists({fields}, f -> f.tag = '999' AND f.ind1 = 'f' AND f.ind2 = 'f') THEN '999 ff present: FOLIO reserves 999 ff for its own instance/SRS identifiers' END",
        f"CASE WHEN {leader_pos(leader, 9)} != 'a' THEN 'leader/09 is not \\'a\\': FOLIO expects UTF-8 encoded records' END",
    )


def trim_punct(value: str) -> str:
    return f"TRIM(TRAILING ' /:;=,.' FROM {value})"


def xml_escape(value: str) -> str:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = f"replace({value}, {q(raw)}, {q(name)})"
    return value


#: Names and places (start, size) of the fixed fields.
LEADER_PARTS = {"status": (5, 1), "type": (6, 1), "bib_level": (7, 1), "control_type": (8, 1), "encoding": None, "indicator_count": (10, 1), "subfield_code_count": (11, 1), "base_address": (12, 5), "encoding_level": (17, 1), "cataloging_form": (18, 1), "multipart_level": (19, 1)}
FIXED_PARTS = {"date_entered": (0, 6), "date_type": (6, 1), "date1": (7, 4), "date2": (11, 4), "place": (15, 3), "language": (35, 3), "modified": (38, 1), "cataloging_source": (39, 1)}
BOOK_PARTS = {"illustrations": (18, 4), "audience": (22, 1), "form": (23, 1), "nature_of_contents": (24, 4), "government_publication": (28, 1), "conference": (29, 1), "festschrift": (30, 1), "index": (31, 1), "literary_form": (33, 1), "biography": (34, 1)}


def _parts(value: str, places: dict) -> str:
    return ", ".join(f"{q(name)}, {control_pos(value, *at)}" for name, at in places.items())


def leader_struct(leader: str) -> str:
    members = [f"'record_length', try_cast({control_pos(leader, 0, 5)} AS INT)"]
    for name, at in LEADER_PARTS.items():
        value = encoding_scheme(leader) if at is None else control_pos(leader, *at)
        members.append(f"{q(name)}, {f'try_cast({value} AS INT)' if name == 'base_address' else value}")
    return f"named_struct({', '.join(members)})"


def books_008(value: str) -> str:
    return f"named_struct({_parts(value, BOOK_PARTS)})"


def parts_008(value: str, is_books: str) -> str:
    return f"named_struct({_parts(value, FIXED_PARTS)}, 'books', CASE WHEN {is_books} THEN {books_008(value)} END)"


def struct_008(leader: str, fields: str) -> str:
    value = control_field(fields, q("008"))
    books = f"{in_list(record_type(leader), 'at')} AND {in_list(bib_level(leader), 'acdm')}"
    return f"CASE WHEN {value} IS NOT NULL THEN {parts_008(value, books)} END"


def language_008(fields: str) -> str:
    return f"nullif(trim({control_pos(control_field(fields, q('008')), 35, 3)}), '')"


# ---- crosswalk structs -----------------------------------------------------------------------


def _first_of(fields: str, *specs: str) -> str:
    found = [place(fields, s) for s in specs]
    return found[0] if len(found) == 1 else f"coalesce({', '.join(found)})"


def _trimmed(fields: str, *specs: str) -> str:
    return trim_punct(_first_of(fields, *specs))


def _headed(fields: str, test: str) -> str:
    return f"filter(transform(filter({fields}, f -> {test} AND f.subfields IS NOT NULL), f -> {trim_punct(field_value('f', 'a'))}), v -> v IS NOT NULL)"


def _title(fields: str, codes: str) -> str:
    return f"nullif({trim_punct(f'concat_ws({q(" ")}, {", ".join(place(fields, "245" + c) for c in codes)})')}, '')"


def type_of_resource(leader: str) -> str:
    return case(record_type(leader), RESOURCE_TYPES)


def dublin_core(leader: str, fields: str) -> str:
    dated = f"nullif(trim({control_pos(control_field(fields, q('008')), 7, 4)}), '')"
    members = {
        "title": _title(fields, "ab"),
        "creator": _trimmed(fields, "100a", "110a", "111a"),
        "subject": _headed(fields, "f.tag LIKE '6%'"),
        "description": _first_of(fields, "520a", "500a"),
        "publisher": _trimmed(fields, "260b", "264b"),
        "contributor": _headed(fields, in_list("f.tag", ("700", "710", "711"))),
        "date": trim_punct(f"coalesce({place(fields, '260c')}, {place(fields, '264c')}, {dated})"),
        "type": type_of_resource(leader),
        "format": _trimmed(fields, "300a"),
        "identifier": f"concat({', '.join(subfields(fields, q(s[:3]), q(s[3])) for s in ('020a', '022a', '856u'))})",
        "language": f"coalesce({language_008(fields)}, {place(fields, '041a')})",
        "relation": _trimmed(fields, "530a", "787t"),
        "coverage": _trimmed(fields, "651a"),
        "rights": _first_of(fields, "506a", "540a"),
    }
    return f"named_struct({', '.join(f'{q(k)}, {v}' for k, v in members.items())})"


def publication(fields: str) -> str:
    return f"named_struct({', '.join(f'{q(k)}, {_trimmed(fields, "260" + c, "264" + c)}' for k, c in (('place', 'a'), ('publisher', 'b'), ('date', 'c')))})"


def instance(leader: str, fields: str) -> str:
    kinds = (("lccn", "010"), ("isbn", "020"), ("issn", "022"), ("system-control-number", "035"))
    ids = ", ".join(f"transform({subfields(fields, q(tag), q('a'))}, v -> named_struct('type', {q(k)}, 'value', {'trim(v)' if k == 'lccn' else 'v'}))" for k, tag in kinds)
    members = {
        "title": _title(fields, "abc"),
        "contributors": _headed(fields, in_list("f.tag", NAMES)),
        "identifiers": f"concat({ids})",
        "publication": publication(fields),
        "languages": f"filter(concat(array({language_008(fields)}), {subfields(fields, q('041'), q('a'))}), v -> v IS NOT NULL)",
        "subjects": _headed(fields, "f.tag LIKE '6%'"),
        "edition": _trimmed(fields, "250a"),
        "physical_description": _trimmed(fields, "300a"),
    }
    return f"named_struct({', '.join(f'{q(k)}, {v}' for k, v in members.items())})"


# ---- links, headings, urls -------------------------------------------------------------------


def uris(fields: str) -> str:
    return f"flatten(transform(filter({fields}, f -> f.subfields IS NOT NULL), f -> transform(filter(f.subfields, s -> s.code IN ('0', '1') AND s.value LIKE 'http%'), s -> named_struct('tag', f.tag, 'code', s.code, 'uri', s.value))))"


def sf01(fields: str) -> str:
    return f"transform(filter(flatten(transform(filter({fields}, f -> f.subfields IS NOT NULL), f -> f.subfields)), s -> s.code IN ('0', '1')), s -> s.value)"


def _like(fields: str, *patterns: str) -> str:
    return f"filter({sf01(fields)}, v -> {' OR '.join(f'v LIKE {q(p)}' for p in patterns)})"


def ids_lc(fields: str) -> str:
    return _like(fields, "%id.loc.gov%")


def ids_viaf(fields: str) -> str:
    return _like(fields, "%viaf.org%")


def ids_fast(fields: str) -> str:
    return _like(fields, "(OCoLC)fst%", "%worldcat.org/fast%", "%fast.oclc.org%")


def heading_join(f: str) -> str:
    return joined(f"transform(filter({f}.subfields, s -> s.code BETWEEN 'a' AND 'z' AND s.code != 'w'), s -> s.value)", " ")


def match_key_parts(fields: str) -> list[str]:
    """Title, ISBN fields and year that ``marc_matchkey_of`` makes the match key of, so that Python gets
    these instead of whole records; NULL where fields are."""
    values = lambda own, codes: f"transform(filter({own}, s -> {in_list('s.code', codes)}), s -> coalesce(s.value, ''))"
    each = lambda tags, code: f"flatten(transform(filter({fields}, f -> {in_list('f.tag', tags)} AND f.subfields IS NOT NULL), f -> {values('f.subfields', (code,))}))"
    title = f"array_join({values(f"get(filter({fields}, f -> f.tag = '245' AND f.value IS NULL), 0).subfields", ('a', 'b'))}, ' ')"
    year = f"get(filter(transform({each(('260', '264'), 'c')}, v -> regexp_extract(v, '[0-9]{{4}}', 0)), y -> y != ''), 0)"
    return [f"IF({fields} IS NULL, NULL, coalesce({title}, ''))", each(("020",), "a"), f"IF({fields} IS NULL, NULL, coalesce({year}, ''))"]


def match_key(fields: str) -> str:
    return f"marc_matchkey_of({', '.join(match_key_parts(fields))})"


def nearest_title(fields: str) -> str:
    """Title and remainder, whose NACO form ``marc_nearest_key`` is; NULL without a title."""
    title = place(fields, "245a")
    return f"IF({title} IS NULL, NULL, concat_ws(' ', {title}, {place(fields, '245b')}))"


def rank(leader: str, fields: str) -> str:
    """Rank of the encoding level, weighted completeness and (6 rank + 4 completeness) div 10."""
    level = f"CASE substring({leader}, 18, 1) " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in ENCODING_RANKS.items()) + " ELSE 0 END"
    parts = f"filter({fields}, f -> f IS NOT NULL AND NOT (f.value IS NOT NULL AND f.subfields IS NULL))"
    some = lambda test, points: f"IF(coalesce(exists({parts}, f -> coalesce({test}, false)), false), {points}, 0)"
    titled = lambda code: f"f.tag = '245' AND exists(f.subfields, s -> coalesce(s.code = '{code}' AND s.value != '', false))"
    language = f"substring(get(filter({fields}, f -> f.tag = '008' AND f.value IS NOT NULL AND f.subfields IS NULL), 0).value, 36, 3)"
    score = [some(titled("a"), 15), some(titled("b"), 5), *(some(f"f.tag LIKE '{d}%'", n) for d, n in (("1", 10), ("7", 10), ("5", 5)))]
    score += [f"least(15, 3 * size(filter({parts}, f -> f.tag LIKE '6%')))", *(some(in_list("f.tag", tags), 10) for tags in (("300",), ("260", "264"), ("020", "010")))]
    score += [f"IF({some("f.tag = '336'", 1)} + {some("f.tag = '337'", 1)} + {some("f.tag = '338'", 1)} = 3, 5, 0)", f"IF(coalesce(length({language}) = 3 AND {language} NOT IN ('   ', '|||'), false), 10, 0)"]
    made = f"transform(array(named_struct('l', {level}, 's', {' + '.join(score)})), x -> named_struct('encoding_level_rank', x.l, 'completeness', x.s, 'total', CAST((6 * x.l + 4 * x.s) DIV 10 AS INT)))[0]"
    return f"IF({fields} IS NULL, NULL, {made})"


def headings(fields: str) -> str:
    return f"transform(filter({fields}, f -> f.subfields IS NOT NULL AND (f.tag LIKE '6%' OR {in_list('f.tag', HEADING_TAGS)})), f -> {heading_join('f')})"


def urls_856(fields: str) -> str:
    return (
        f"transform(filter({fields}, f -> f.tag = '856' AND exists(f.subfields, s -> s.code = 'u')), f -> "
        f"named_struct('uri', {field_value('f', 'u')}, 'link_text', coalesce({field_value('f', 'y')}, {field_value('f', 'z')}), 'materials', {field_value('f', '3')}))"
    )


def rda_check(leader: str, fields: str, expanded: str) -> str:
    """Codes of pre-RDA practice; ``expanded`` is the fields with abbreviations spelt out."""
    missing = [f"CASE WHEN NOT {has_tag(fields, t)} THEN 'missing_{t}' END" for t in ("336", "337", "338")]
    norelator = lambda tags: f"exists({fields}, f -> {in_list('f.tag', tags)} AND NOT coalesce(exists(f.subfields, s -> s.code IN ('e', '4')), false))"
    said = lambda code, text: f"exists({subfields(fields, q('260'), q(code))}, v -> coalesce(v ILIKE {q(text)}, false))"
    found = compact(
        f"CASE WHEN {leader_pos(leader, 18)} = 'a' THEN 'desc_aacr2' END",
        f"CASE WHEN NOT exists({subfields(fields, q('040'), q('e'))}, v -> coalesce(v = 'rda', false)) THEN 'no_040e_rda' END",
        *missing,
        f"CASE WHEN {place(fields, '245h')} IS NOT NULL THEN 'gmd_245h' END",
        f"CASE WHEN {has_tag(fields, '260')} AND NOT {has_tag(fields, '264')} THEN 'only_260' END",
        f"CASE WHEN NOT {expanded} <=> {fields} THEN 'aacr2_abbreviations' END",
        f"CASE WHEN {said('a', '%[s.l.%')} OR {said('b', '%[s.n.%')} THEN 'sl_sn_260' END",
        f"CASE WHEN {place(fields, '245c')} ILIKE '%et al%' THEN 'et_al_245' END",
        f"CASE WHEN {norelator(('100', '110', '111'))} THEN 'no_relator_1xx' END",
        f"CASE WHEN {norelator(('700', '710', '711'))} THEN 'no_relator_7xx' END",
    )
    return f"CASE WHEN {format_of(leader)} = 'bibliographic' THEN {found} ELSE CAST(array() AS array<string>) END"


# ---- ISBD and UNIMARC ------------------------------------------------------------------------


def nonempty(value: str) -> str:
    return f"nullif({value}, '')"


def _area(separator: str, *parts: str) -> str:
    return nonempty(f"concat_ws({q(separator)}, {', '.join(parts)})")


def isbd_areas(leader: str, fields: str) -> dict[int, str]:
    at = lambda *specs: _trimmed(fields, *specs)
    series, number, serial = place(fields, "490a"), place(fields, "020a"), place(fields, "022a")
    return {
        1: _area(" / ", _area(" : ", at("245a"), at("245b")), at("245c")),
        2: _area(" / ", at("250a"), at("250b")),
        4: _area(", ", _area(" : ", at("260a", "264a"), at("260b", "264b")), at("260c", "264c")),
        5: _area(" ; ", _area(" : ", at("300a"), at("300b")), at("300c")),
        6: f"CASE WHEN {series} IS NOT NULL THEN concat('(', concat_ws(' ; ', {at('490a')}, {at('490v')}), ')') END",
        8: f"CASE WHEN {in_list(bib_level(leader), 'bis')} AND {serial} IS NOT NULL THEN concat('ISSN ', {trim_punct(serial)}) WHEN {number} IS NOT NULL THEN concat('ISBN ', {trim_punct(number)}) END",
    }


def isbd(leader: str, fields: str) -> str:
    return nonempty(f"array_join({compact(*isbd_areas(leader, fields).values())}, '. — ')")


def _mapped(value: str, table: dict[str, str], same: str, default: str) -> str:
    rules = "".join(f" WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    keep = "".join(f" WHEN {q(k)} THEN {q(k)}" for k in same)
    return f"CASE {value}{rules}{keep} ELSE {q(default)} END"


def unimarc_label(leader: str) -> str:
    at = lambda p: leader_pos(leader, p)
    return "concat({}, {}, {}, {}, '0 22', {}, {}, {}, ' 450 ')".format(
        control_pos(leader, 0, 5),
        _mapped(at(5), {"a": "c"}, "cdp", "n"),
        _mapped(at(6), {"t": "b", "m": "l", "o": "m", "p": "a"}, "acdefgijkr", "a"),
        _mapped(at(7), {"b": "a", "d": "m"}, "acims", "m"),
        control_pos(leader, 12, 5),
        _mapped(at(17), {"8": "1", "5": "3", "1": " ", "4": " "}, "3 ", "2"),
        _mapped(at(18), {"a": " ", "i": " ", "u": " ", "c": "i"}, "", "n"),
    )


def from_unimarc_label(label: str) -> str:
    at = lambda p: leader_pos(label, p)
    return "concat({}, {}, {}, {}, ' a22', {}, {}, {}, ' 4500')".format(
        control_pos(label, 0, 5),
        _mapped(at(5), {"o": "c"}, "cdp", "n"),
        _mapped(at(6), {"b": "t", "l": "m", "m": "o"}, "acdefgijkr", "a"),
        _mapped(at(7), {}, "acims", "m"),
        control_pos(label, 12, 5),
        _mapped(at(17), {"1": "8", "2": "5"}, "3", " "),
        _mapped(at(18), {"n": " "}, "", "i"),
    )


# ---- addresses -------------------------------------------------------------------------------


def url_encode(value: str) -> str:
    """RFC 3986 escapes: a blank is %20, the tilde stays and the asterisk does not."""
    return f"replace(replace(replace(url_encode({value}), '+', '%20'), '%7E', '~'), '*', '%2A')"


def _option(name: str, value: str) -> str:
    return f"coalesce(concat('&{name}=', {url_encode(value)}), '')"


def oai_url(base: str, prefix: str = "'marc21'", set_: str = "NULL", from_: str = "NULL", until: str = "NULL") -> str:
    return f"concat({base}, '?verb=ListRecords&metadataPrefix=', {prefix}, {_option('set', set_)}, {_option('from', from_)}, {_option('until', until)})"


def oai_page_url(base: str, token: str) -> str:
    return f"concat({base}, '?verb=ListRecords&resumptionToken=', {url_encode(token)})"


_TOKEN = "<(?:[A-Za-z_][A-Za-z0-9_.-]*:)?resumptionToken"


def oai_extract_token(xml: str) -> str:
    return nonempty(f"trim(regexp_extract({xml}, {q(_TOKEN + '[^>]*>([^<]*)')}, 1))")


def oai_token_attribute(xml: str, name: str) -> str:
    return nonempty(f"regexp_extract({xml}, {q(_TOKEN + f'[^>]*{name}="([^"]*)"')}, 1)")


def sru_url(base: str, query: str, most: str = "50") -> str:
    return f"concat({base}, '?version=1.1&operation=searchRetrieve&recordSchema=marcxml&maximumRecords=', {most}, '&query=', {url_encode(query)})"


def idloc_label_url(label: str, scheme: str = "'names'") -> str:
    return f"concat('https://id.loc.gov/authorities/', {scheme}, '/label/', {url_encode(label)})"


def idloc_suggest_url(term: str, scheme: str = "'names'", count: str = "5") -> str:
    return f"concat('https://id.loc.gov/authorities/', {scheme}, '/suggest2?q=', {url_encode(term)}, '&count=', {count})"


def viaf_search_url(term: str, index: str = "'local.mainHeadingEl'", most: str = "5") -> str:
    asked = f"concat({index}, ' all \"', {term}, '\"')"
    return f"concat('https://viaf.org/viaf/search?query=', {url_encode(asked)}, '&maximumRecords=', {most}, '&httpAccept=application/json')"


def wikidata_search_url(term: str, language: str = "'en'", limit: str = "5") -> str:
    return f"concat('https://www.wikidata.org/w/api.php?action=wbsearchentities&format=json&language=', {language}, '&uselang=', {language}, '&type=item&limit=', {limit}, '&search=', {url_encode(term)})"


def alma_put_url(base: str, mms_id: str, apikey: str = "NULL", validate_: str = "false", stale: str = "false") -> str:
    return f"concat({base}, '/almaws/v1/bibs/', {mms_id}, '?validate=', {validate_}, '&stale_version_check=', {stale}, {_option('apikey', apikey)})"


def alma_headers(apikey: str) -> str:
    return f"CASE WHEN {apikey} IS NULL THEN map('Accept', 'application/xml') ELSE map('Accept', 'application/xml', 'Authorization', concat('apikey ', {apikey})) END"


def sql_quote(value: str) -> str:
    return f"concat('\\'', replace({value}, '\\'', '\\'\\''), '\\'')"


def _literal(value: str) -> str:
    return f"coalesce({sql_quote(value)}, 'NULL')"


def alma_put_statement(base: str, mms_id: str, apikey: str, body: str, validate_: str = "false", stale: str = "false") -> str:
    """The statement that writes a record back: it holds the key, so treat it as a credential."""
    own = ", ', ', ".join([*map(_literal, (base, mms_id, apikey, body)), f"CAST({validate_} AS STRING)", f"CAST({stale} AS STRING)"])
    return f"concat('SELECT status, content_type, body FROM marc_alma_update_bib(', {own}, ')')"


def nearest_statement(queries: str, targets: str, k: str) -> str:
    """The statement of the k nearest matches; k is checked here."""
    whole = f"CASE WHEN {k} >= 1 AND {k} = floor({k}) THEN CAST(CAST({k} AS BIGINT) AS STRING) ELSE raise_error('marc_nearest_matches_sql: k must be a positive integer') END"
    return f"concat('SELECT * FROM marc_nearest_matches_k(', {_literal(queries)}, ', ', {_literal(targets)}, ', ', {whole}, ')')"


def shell_arg(value: str) -> str:
    return f"concat('\\'', replace({value}, '\\'', '\\'\\\\\\'\\''), '\\'')"


# ---- answers of reconciliation services ------------------------------------------------------


def idloc_candidates(text: str) -> str:
    hits = f"from_json({text}, 'hits array<struct<aLabel:string,uri:string,token:string>>').hits"
    return f"transform({hits}, h -> named_struct('label', h.aLabel, 'uri', h.uri, 'token', h.token))"


def viaf_candidates(text: str) -> str:
    cluster = "recordData struct<VIAFCluster:struct<viafID:string,nameType:string,mainHeadings:struct<data:array<struct<text:string>>>>>"
    records = f"from_json({text}, 'searchRetrieveResponse struct<records:struct<record:array<struct<{cluster.replace(' ', ':', 1)}>>>>').searchRetrieveResponse.records.record"
    return f"transform({records}, r -> named_struct('viaf_id', r.recordData.VIAFCluster.viafID, 'name_type', r.recordData.VIAFCluster.nameType, 'heading', get(r.recordData.VIAFCluster.mainHeadings.data, 0).text))"


def wikidata_candidates(text: str) -> str:
    found = f"from_json({text}, 'search array<struct<id:string,label:string,description:string,concepturi:string>>').search"
    return f"transform({found}, e -> named_struct('id', e.id, 'label', e.label, 'description', e.description, 'concepturi', e.concepturi))"


def variant(leader: str, fields: str) -> str:
    """The record as VARIANT; NULL members are absent."""
    return f"parse_json(to_json(named_struct('leader', {leader}, 'fields', {fields})))"
