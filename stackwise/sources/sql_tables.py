"""Table functions by SQL name.

``read_marc('path')`` and the like are SQL functions over files that the executors reach: one task
lists pieces of them (:mod:`stackwise.sources.pieces`), all tasks count and then parse those.  Profiles,
duplicate reports, workflows and service readers are SQL functions over the readers, of the expressions
that the operators use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import catalog, udfs
from ..functions import expr as E
from ..operators import matching as M
from ..operators import reports as R
from ..operators.crosswalk_files import CROSSWALKS
from ..types import FIELDS_DDL, RECORD_DDL
from . import pieces

_FLAT_DDL = "record_no bigint, file string, control_number string, leader string, field_no int, tag string, ind1 string, ind2 string, subfield_no int, code string, value string"
#: SQL name of the reader of each format; those but the first give the flat shape.
READERS = {"read_marc": "marc", "read_marc_subfields": "marc", "read_marcxml": "marcxml", "read_marc_breaker": "mrk", "read_marcjson": "marcjson", "read_alephseq": "alephseq", "read_microlif": "microlif"}


def _flat(records: Iterator[tuple], wanted: frozenset[str] | None) -> Iterator[tuple]:
    for n, file, number, leader, fields in records:
        for k, (tag, ind1, ind2, value, parts) in enumerate(fields, 1):
            if wanted is None or tag in wanted:
                for j, (code, text) in enumerate([(None, value)] if parts is None else parts, 1):
                    yield n, file, number, leader, k, tag, ind1, ind2, j, code, text


class _Raw:
    def eval(self, path: str, encoding: str = "auto"):
        from ..codecs import iso2709
        from ..codecs.errors import RecordError
        from .datasource import _files, read_bytes

        for file in _files(path):
            pieces = [p.lstrip(b"\n\r ") for p in read_bytes(file).split(iso2709.RT)]
            for n, piece in enumerate((p for p in pieces if p), 1):
                number = error = None
                try:
                    number = next((f["value"] for f in iso2709.parse(piece, encoding)["fields"] if f["tag"] == "001"), None)
                except RecordError as e:
                    error = str(e)
                yield n, file, number, piece[:24].decode("latin-1") if len(piece) >= 24 else None, piece + iso2709.RT, error


class _Crosswalks:
    def eval(self):
        yield from CROSSWALKS


class _Kbart:
    """Tab-separated with a header; the columns are the file's, all text."""

    @staticmethod
    def analyze(path: AnalyzeArgument) -> AnalyzeResult:
        from .datasource import _files, read_bytes

        names = read_bytes(_files(path.value)[0]).decode("utf-8-sig").split("\n", 1)[0].rstrip("\r").split("\t")
        return AnalyzeResult(StructType([StructField(n, StringType()) for n in names]))

    def eval(self, path: str):
        import csv
        import io

        from .datasource import _files, read_bytes

        for file in _files(path):
            lines = csv.reader(io.StringIO(read_bytes(file).decode("utf-8-sig"), newline=""), delimiter="\t")
            width = len(next(lines, []))
            for line in lines:
                if line:
                    yield tuple((line + [""] * width)[k] or None for k in range(width))


class _Answer:
    """Records of one address, in the flat shape."""

    def eval(self, url: str, fmt: str):
        from .readers import TEXT_FORMATS, _number
        from .services import _get

        parsed = TEXT_FORMATS[fmt](_get(url).decode("utf-8", "replace"))
        rows = ((n, url, _number(r["fields"]), r["leader"], [(f["tag"], f["ind1"], f["ind2"], f["value"], None if f["subfields"] is None else [(s["code"], s["value"]) for s in f["subfields"]]) for f in r["fields"]]) for n, r in enumerate(parsed, 1))
        yield from _flat(rows, None)


class _Text:
    def eval(self, url: str):
        from .datasource import _files, read_bytes
        from .services import _get

        if url.startswith(("http://", "https://")):
            yield (_get(url).decode("utf-8", "replace"),)
        else:
            for file in _files(url):
                yield (read_bytes(file).decode("utf-8", "replace"),)


class _Put:
    """Writes a record back; a task that Spark runs twice puts the same body twice."""

    def eval(self, url: str, body: str, apikey: str):
        from .services import put_record

        yield put_record(url, body, {"Accept": "application/xml"} | ({"Authorization": f"apikey {apikey}"} if apikey else {}), confirm=True)


_ROW = "file, record_no, control_number"
_TITLE = E.place("fields", "245a")
_EACH = "read_marc(path)"
_KEYED = f"file, record_no, {_TITLE} AS title, marc_naco({E.nearest_title("fields")}) AS tkey, {E.match_key("fields")} AS matchkey"
_ISSUES = f"(SELECT *, marc_rda_check(leader, fields) AS issues FROM {_EACH})"
_JOIN_TEXT = "jaro_winkler_similarity({}, {})"
#: Stands for the number of tasks that sort pairs, until a session registers the function.
_SORTING = "SORTING_TASKS"


def _measures(name: str, digits: int = 2) -> str:
    return f"min({name}) AS min_{name}, max({name}) AS max_{name}, round(avg({name}), {digits}) AS mean_{name}, round(stddev_samp({name}), {digits}) AS stddev_{name}"


def _nearest(queries: str, targets: str, a: str, b: str, k: str, least: str, but: str = "") -> str:
    """The ``k`` nearest targets of each query record.  Query and target keys are compared once each,
    and only the first k records of a target key can be among the nearest."""
    names = ", ".join(f"{s}.{c} AS {c}_{s}" for s in (a, b) for c in ("file", "record_no", "title"))
    if queries == targets:
        read = f"q AS (SELECT * FROM marc_nearest_recs({queries}) WHERE tkey IS NOT NULL)"
        own = "q"
    else:
        read = f"both AS (SELECT * FROM marc_nearest_both({queries}, {targets}) WHERE tkey IS NOT NULL), q AS (SELECT * FROM both WHERE asked)"
        own = "both WHERE searched"
    return f"""WITH {read},
        t AS (SELECT *, row_number() OVER (PARTITION BY tkey ORDER BY file, record_no) AS place FROM {own}),
        scored AS (SELECT qk, tk, {_JOIN_TEXT.format("qk", "tk")} AS similarity FROM (SELECT DISTINCT tkey AS qk FROM q) CROSS JOIN (SELECT DISTINCT tkey AS tk FROM t)),
        leading AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY qk ORDER BY similarity DESC) AS level FROM scored) WHERE level <= {k}),
        few AS (SELECT * FROM (SELECT l.qk, l.similarity, t.*, row_number() OVER (PARTITION BY l.qk ORDER BY l.similarity DESC, t.file, t.record_no) AS nearest FROM leading l JOIN t ON t.tkey = l.tk AND t.place <= {k}) WHERE nearest <= {k})
        SELECT {names.replace(f"{a}.", "q.").replace(f"{b}.", "few.")}, similarity, coalesce(q.matchkey = few.matchkey, false) AS same_matchkey FROM q JOIN few ON few.qk = q.tkey
        WHERE (similarity >= {least} OR coalesce(q.matchkey = few.matchkey, false)){but} ORDER BY file_{a}, record_no_{a}, similarity DESC, file_{b}, record_no_{b}"""


def _blocks(keys: str, width: int) -> str:
    """The records of ``r`` with equal ``keys``, the first not NULL, and of ``width`` numbers of a file as one row."""
    parts = ", ".join(f"transform(own, x -> x.{c}) AS {c}s" for c in ("record_no", "title", "matchkey"))
    return f"""(SELECT {keys}, file, block, least, most, {parts} FROM (SELECT {keys}, file, record_no div {width} AS block, array_sort(collect_list(struct(record_no, title, matchkey))) AS own, min(record_no) AS least, max(record_no) AS most
            FROM r WHERE {keys.partition(',')[0]} IS NOT NULL GROUP BY {keys}, file, record_no div {width}))"""


def _candidates(*order: str) -> str:
    """The pairs by ``order`` and by both records, made from blocks of records as in
    ``matching.dedupe_candidates``."""
    ends = ", ".join(f"{side}.{c} AS {c}_{side}" for side in "ab" for c in ("file", "block", *M.LISTS))
    held = ", ".join(f"{c}_{side}" if c not in M.LISTS else f"IF(copy = 0, {c}_{side}, NULL) AS {c}_{side}" for side in "ab" for c in ("file", "block", *M.LISTS))
    follows = "(a.file < b.file OR (a.file = b.file AND a.least < b.most))"
    first = ", ".join([*(f"order_{i}" for i in range(len(order))), "file_a", "block_a"])
    return f"""WITH n AS (SELECT file, record_no, title, matchkey, marc_naco(title) AS naco FROM marc_nearest_recs(path)),
        r AS (SELECT file, record_no, title, naco, IF(count(*) OVER (PARTITION BY matchkey, IF(matchkey IS NULL, record_no, NULL)) = 1, NULL, matchkey) AS matchkey FROM n),
        k AS (SELECT naco, octet_length(naco) AS n FROM (SELECT DISTINCT naco FROM r WHERE naco IS NOT NULL)),
        wide AS (SELECT naco, explode(sequence(CAST(ceil(n * greatest(0, 3 * IF(threshold <= 0.7, threshold, greatest(0.7, (threshold - 0.4) / 0.6)) - 2 - 1e-9)) AS INT), n)) AS n FROM k),
        keys AS (SELECT w.naco AS x, k.naco AS y FROM wide w JOIN k ON w.n = k.n),
        alike AS (SELECT x, y, {_JOIN_TEXT.format("x", "y")} AS similarity FROM (SELECT x, y FROM keys UNION SELECT y, x FROM keys)),
        found AS (SELECT {ends}, similarity, false AS same_matchkey FROM {_blocks("naco", M.FIRST)} a JOIN alike ON a.naco = x JOIN {_blocks("naco", M.SECOND)} b ON b.naco = y WHERE similarity >= threshold AND {follows}
            UNION ALL SELECT {ends}, {_JOIN_TEXT.format("a.naco", "b.naco")}, true FROM {_blocks("matchkey, naco", M.FIRST)} a JOIN {_blocks("matchkey, naco", M.SECOND)} b ON a.matchkey = b.matchkey WHERE {follows}),
        dealt AS (SELECT /*+ REPARTITION_BY_RANGE({_SORTING}, {first}) */ * FROM (SELECT {held}, similarity, same_matchkey{"".join(f", {e} AS order_{i}" for i, e in enumerate(order))} FROM found LATERAL VIEW explode({M.COPIES}) v AS copy)),
        pair AS (SELECT {first}, record_no_a, file_b, record_no_b, get(titles_a, i) AS title_a, get(titles_b, j) AS title_b, similarity, same_matchkey FROM dealt LATERAL VIEW OUTER posexplode(record_nos_a) v AS i, record_no_a LATERAL VIEW OUTER posexplode(record_nos_b) w AS j, record_no_b
            WHERE i IS NOT NULL AND j IS NOT NULL AND (file_a < file_b OR (file_a = file_b AND record_no_a < record_no_b)) AND (same_matchkey OR NOT coalesce(get(matchkeys_a, i) = get(matchkeys_b, j), false)))
        SELECT file_a, record_no_a, file_b, record_no_b, title_a, title_b, similarity, same_matchkey FROM pair ORDER BY {first}, record_no_a, file_b, record_no_b"""


def _url(first: str, **options: str) -> str:
    """The expression of an address with options that are left out where NULL."""
    return f"concat({first}" + "".join(f", coalesce(concat('{sign}{name}=', {E.url_encode(name)}), '')" for name, sign in options.items()) + ")"


def _read(url: str, fmt: str = "marcxml") -> str:
    return f"SELECT * FROM marc_read_answer({url}, '{fmt}')"


#: SQL name -> (parameters, body) of the table functions over the readers.
TABLES: dict[str, tuple[str, str]] = {
    "marc_report_tags": ("path STRING", f"SELECT tag, sum(n) AS `count`, count(*) AS records_with, round(100.0D * count(*) / any_value(total), 1) AS pct_records FROM (SELECT t.tag, t.n, total FROM {_EACH} CROSS JOIN (SELECT count(*) AS total FROM {_EACH}) LATERAL VIEW explode({R.TAG_COUNTS}) x AS t) GROUP BY tag ORDER BY tag"),
    "marc_report_subfields": ("path STRING, tag_ STRING", f"SELECT c.code, sum(c.n) AS `count`, count(*) AS records_with FROM {_EACH} LATERAL VIEW explode({R.code_counts('tag_')}) x AS c GROUP BY c.code ORDER BY c.code"),
    "marc_report_completeness": ("path STRING", f"SELECT *, {R.SCORE} AS completeness FROM (SELECT {_ROW}, {', '.join(f'{v} AS {k}' for k, v in R.FLAGS.items())} FROM {_EACH}) ORDER BY file, record_no"),
    "marc_report_errors": ("path STRING", f"SELECT {_ROW}, explode({E.validate('leader', 'fields')}) AS violation FROM {_EACH}"),
    "marc_summary": ("path STRING", f"SELECT count(*) AS records, count(DISTINCT file) AS files, sum(fields) AS total_fields, sum(subfields) AS total_subfields, {_measures('fields')}, {_measures('subfields')}, round(avg(tags), 2) AS mean_distinct_tags, count_if({E.encoding_scheme('leader')} = 'marc8') AS marc8_records FROM (SELECT file, leader, CAST(size({R.FULL}) AS BIGINT) AS fields, {R.SUBFIELD_ROWS} AS subfields, size(array_distinct(transform({R.FULL}, f -> f.tag))) AS tags FROM {_EACH}) WHERE fields > 0"),
    "marc_summary_fields": ("path STRING", f"WITH r AS (SELECT tags FROM (SELECT {R.FIELD_COUNTS} AS tags FROM {_EACH}) WHERE size(tags) > 0) SELECT t.tag, sum(t.occurrences) AS total_occurrences, count(*) AS records_with, round(100.0D * count(*) / any_value(total), 1) AS pct_records, min(t.occurrences) AS min_per_record, max(t.occurrences) AS max_per_record, round(avg(t.occurrences), 2) AS mean_per_record, round(stddev_samp(t.occurrences), 2) AS stddev_per_record, round(sum(t.subfields) / sum(t.occurrences), 2) AS mean_subfields_per_field FROM r CROSS JOIN (SELECT count(*) AS total FROM r) LATERAL VIEW explode(tags) x AS t GROUP BY t.tag ORDER BY t.tag"),
    "marc_summary_subfields": ("path STRING, tag_ STRING", f"SELECT s.code, count(*) AS occurrences, sum(CAST(s.first AS BIGINT)) AS records_with, min(s.len) AS min_len, max(s.len) AS max_len, round(avg(s.len), 1) AS mean_len, round(stddev_samp(s.len), 1) AS stddev_len FROM {_EACH} LATERAL VIEW explode({R.code_values('tag_')}) x AS s GROUP BY s.code ORDER BY s.code"),
    "marc_check_urls": ("path STRING", f"SELECT {_ROW}, u.uri, u.link_text, u.materials, lower(regexp_extract(u.uri, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(u.uri, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM {_EACH} LATERAL VIEW explode({E.urls_856('fields')}) x AS u"),
    "marc_headings_used": ("path STRING", f"SELECT heading, count(*) AS n_occurrences FROM {_EACH} LATERAL VIEW explode({E.headings('fields')}) x AS heading GROUP BY heading"),
    "marc_reconcile_headings": ("path STRING, base STRING", f"SELECT *, CASE base WHEN 'idloc' THEN {E.idloc_suggest_url('heading')} WHEN 'viaf' THEN {E.viaf_search_url('heading')} WHEN 'wikidata' THEN {E.wikidata_search_url('heading')} ELSE concat(base, {E.url_encode('heading')}) END AS url FROM marc_headings_used(path) ORDER BY n_occurrences DESC, heading"),
    "marc_cluster_headings": ("path STRING, method STRING", "SELECT key, sum(n_occurrences) AS n_headings, count(*) AS n_variants, array_sort(collect_list(heading)) AS members FROM (SELECT *, CASE method WHEN 'fingerprint' THEN marc_fingerprint(heading) WHEN 'ngram' THEN marc_ngram_fingerprint(heading, 2) ELSE raise_error('marc_cluster_headings: method must be fingerprint or ngram') END AS key FROM marc_headings_used(path)) WHERE key <> '' GROUP BY key ORDER BY n_variants DESC, n_headings DESC, key"),
    **{
        name: ("path STRING", f"SELECT record_no, file, control_number, leader, f_no + 1 AS field_no, f.tag, f.ind1, f.ind2, f.value AS control_value, f.subfields FROM {source} LATERAL VIEW posexplode(fields) x AS f_no, f")
        for name, source in (("marc_readfields", _EACH), ("marc_readfieldsxml", "marc_readnestedxml(path)"), ("marc_readfieldsbreaker", "marc_readnestedbreaker(path)"))
    },
    "marc_nearest_recs": ("path STRING", f"SELECT {_KEYED} FROM {_EACH}"),
    "marc_dedupe_candidates": ("path STRING, threshold DOUBLE", _candidates()),
    "marc_nearest_dupes": ("path STRING, min_similarity DOUBLE DEFAULT 0.0", _nearest("path", "path", "a", "b", "6", "min_similarity", " AND NOT (q.file = few.file AND q.record_no = few.record_no)")),
    "marc_nearest_matches_k": ("query_path STRING, target_path STRING, k INT", _nearest("query_path", "target_path", "q", "t", "IF(k >= 1, k, raise_error('marc_nearest_matches_k: k must be a positive integer'))", "-1.0")),
    "marc_nearest_matches": ("query_path STRING, target_path STRING, min_similarity DOUBLE DEFAULT 0.0", _nearest("query_path", "target_path", "q", "t", "5", "min_similarity")),
    "marc_nearest_headings": ("path STRING, labels ARRAY<STRING>, min_similarity DOUBLE DEFAULT 0.0", f"""SELECT heading, n_occurrences, label, similarity FROM (SELECT *, row_number() OVER (PARTITION BY heading ORDER BY similarity DESC, label) AS nearest
        FROM (SELECT *, {_JOIN_TEXT.format("marc_naco(heading)", "marc_naco(label)")} AS similarity FROM marc_headings_used(path) LATERAL VIEW explode(labels) x AS label) WHERE similarity IS NOT NULL)
        WHERE nearest <= 3 AND similarity >= min_similarity ORDER BY n_occurrences DESC, heading, similarity DESC, label"""),
    "task_dedupe_exact": ("path STRING", f"SELECT matchkey, count(*) AS records, transform(array_sort(collect_list(struct(record_no, control_number))), x -> x.control_number) AS control_numbers, array_sort(collect_list(record_no)) AS record_nos FROM (SELECT record_no, control_number, {E.match_key("fields")} AS matchkey FROM {_EACH}) WHERE matchkey IS NOT NULL GROUP BY matchkey HAVING count(*) > 1 ORDER BY records DESC, matchkey"),
    "task_dedupe_fuzzy": ("path STRING, threshold DOUBLE", _candidates(*M.FUZZY_ORDER)),
    "task_dedupe_keepers": ("path STRING", f"SELECT matchkey, records, best.control_number AS keep_control_number, best.record_no AS keep_record_no, -best.low AS keeper_rank FROM (SELECT matchkey, count(*) AS records, min(struct(-total AS low, record_no, control_number)) AS best FROM (SELECT record_no, control_number, {E.match_key("fields")} AS matchkey, {E.rank("leader", "fields")}.total AS total FROM {_EACH}) WHERE matchkey IS NOT NULL GROUP BY matchkey) WHERE records > 1 ORDER BY records DESC, matchkey"),
    "task_rda_profile": ("path STRING", f"SELECT issue, count(*) AS records FROM {_ISSUES} LATERAL VIEW explode(issues) x AS issue GROUP BY issue ORDER BY records DESC, issue"),
    "task_rda_worklist": ("path STRING", f"SELECT record_no, control_number, {_TITLE} AS title, issues FROM {_ISSUES} WHERE size(issues) > 0 ORDER BY size(issues) DESC, record_no"),
    "task_rda_upgrade_file": ("path STRING", f"SELECT r.leader, r.fields FROM (SELECT IF(size(issues) > 0, task_rda_upgrade(leader, fields), named_struct('leader', leader, 'fields', fields)) AS r FROM {_ISSUES})"),
    "task_vendor_load": ("path STRING, org_code STRING", f"SELECT leader, task_vendor_clean(fields, org_code) AS fields FROM {_EACH}"),
    "task_vendor_report": ("path STRING", f"SELECT record_no, control_number, {E.format_of('leader')} AS format, marc_validate_format(leader, fields) AS violations, size(issues) AS rda_issues, size(filter(fields, f -> f.tag RLIKE '^9..$')) AS vendor_9xx_dropped, {_TITLE} AS title FROM {_ISSUES}"),
    "marc_readsru": ("base STRING, query_ STRING, max_records INT DEFAULT 50", _read(E.sru_url("base", "query_", "max_records"))),
    "marc_readoai": ("base STRING, metadata_prefix STRING DEFAULT 'marc21', set_ STRING DEFAULT NULL", _read(E.oai_url("base", "metadata_prefix", "set_", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"))),
    "marc_readoai_page": ("base STRING, resumption_token STRING", _read(E.oai_page_url("base", "resumption_token"))),
    "marc_oai_token": ("url STRING", f"SELECT {E.oai_extract_token('content')} AS token, try_cast({E.oai_token_attribute('content', 'completeListSize')} AS BIGINT) AS complete_list_size, try_cast({E.oai_token_attribute('content', 'cursor')} AS BIGINT) AS cursor, {E.oai_token_attribute('content', 'expirationDate')} AS expiration_date FROM marc_read_content(url)"),
    "marc_readalma": ("base STRING, mms_id STRING, apikey STRING DEFAULT NULL", _read(_url("base, '/almaws/v1/bibs/', mms_id", apikey="?"))),
    "marc_readalma_bibs": ("base STRING, mms_ids STRING, apikey STRING DEFAULT NULL", _read(_url("base, '/almaws/v1/bibs?view=full&expand=None&mms_id=', mms_ids", apikey="&"))),
    "marc_readalma_sru": ("base STRING, inst_code STRING, query_ STRING, max_records INT DEFAULT 50", "SELECT * FROM marc_readsru(concat(base, '/view/sru/', inst_code), query_, max_records)"),
    "marc_readkoha": ("base STRING, biblio_id STRING", _read("concat(base, '/api/v1/biblios/', biblio_id)")),
    "marc_readkoha_public": ("base STRING, biblio_id STRING", _read("concat(base, '/api/v1/public/biblios/', biblio_id)")),
    "marc_readkoha_opac": ("opac_base STRING, biblio_id STRING", _read("concat(opac_base, '/cgi-bin/koha/opac-export.pl?op=export&format=marcxml&bib=', biblio_id)")),
    "marc_readworldshare": ("base STRING, oclc_number STRING", _read("concat(base, '/worldcat/manage/bibs/', oclc_number)")),
    "marc_readfolio_srs": ("okapi_base STRING, instance_uuid STRING", _read("concat(okapi_base, '/source-storage/records/', instance_uuid, '/formatted?idType=INSTANCE')", "marcjson")),
    "marc_readfolio_record": ("okapi_base STRING, record_uuid STRING", _read("concat(okapi_base, '/source-storage/records/', record_uuid)", "marcjson")),
    "marc_readfolio_source_records": ("okapi_base STRING, lim INT, off INT", _read("concat(okapi_base, '/source-storage/source-records?limit=', lim, '&offset=', off)", "marcjson")),
    "marc_alma_update_bib": ("base STRING, mms_id STRING, apikey STRING, bib_body STRING, validate BOOLEAN DEFAULT false, stale_version_check BOOLEAN DEFAULT false", f"SELECT * FROM marc_put_answer({E.alma_put_url('base', 'mms_id', 'CAST(NULL AS STRING)', 'validate', 'stale_version_check')}, bib_body, apikey)"),
}
#: Functions over others come after them.
_ORDER = ["marc_headings_used", "marc_nearest_recs", "marc_dedupe_candidates", "marc_readsru"]
_NESTED = {"marc_readnestedxml": "marcxml", "marc_readnestedbreaker": "mrk"}
_OPTIONS = "path STRING, encoding STRING DEFAULT 'auto', tags STRING DEFAULT NULL, ignore_errors BOOLEAN DEFAULT false"


def _nested(fmt: str, tasks: int, tags: str = "tags", options: str = "encoding AS coding, {tags} AS wanted, ignore_errors AS lenient", source: str = "SELECT * FROM marc_pieces('{fmt}', path)", more: str = "") -> str:
    """The body of a reader of records.  Numbers come from the records counted in the pieces before."""
    of_file = "OVER (PARTITION BY file"
    return f"""WITH p AS (SELECT /*+ REPARTITION({tasks}) */ * FROM ({source.format(fmt=fmt)})),
        c AS (SELECT p.*, k.n, k.whole FROM p, LATERAL marc_count_piece('{fmt}', p.file, p.start, p.stop, p.parts) k),
        w AS (SELECT *, coalesce(sum(n) {of_file} ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(whole) {of_file}) AS one FROM c),
        o AS (SELECT /*+ REPARTITION({tasks}) */ file, start, stop, IF(one, 1, parts) AS parts, before, {options.format(tags=tags)}{more} FROM w WHERE NOT one OR start = 0)
        SELECT record_no, file, control_number, leader, fields{more} FROM ({_parsed(fmt, more)})"""


def _parsed(fmt: str, more: str = "") -> str:
    """The records of the pieces ``o``: parsed by Python one by one, or a whole piece's at once."""
    found = f"SELECT o.file{more}, r.* FROM o, LATERAL marc_read_piece('{fmt}', o.file, o.start, o.stop, o.parts, o.before, o.coding, o.wanted, o.lenient) r"
    if fmt not in pieces.PLAIN:
        return f"SELECT record_no, file, control_number, leader, from_json(fields, '{FIELDS_DDL}') AS fields{more} FROM ({found})"
    python = f"array(named_struct('leader', leader, 'fields', from_json(fields, '{FIELDS_DDL}')))"
    piece = f"from_json(raw, 'array<{RECORD_DDL}>', map('mode', 'FAILFAST'))"
    return f"""SELECT record_no + IF(whole, i + 1, 0) AS record_no, file, IF(whole, get(filter(x.fields, f -> f.tag = '001'), 0).value, control_number) AS control_number, x.leader, x.fields{more}
        FROM (SELECT record_no, file, control_number, whole, i, x{more} FROM (SELECT *, raw IS NOT NULL AS whole FROM ({found})) LATERAL VIEW posexplode(IF(whole, {piece}, {python})) v AS i, x)"""


def _both(tasks: int) -> str:
    """The keys of the records of two paths; a file of both is read once."""
    source = "SELECT * FROM marc_pieces_of_both('{fmt}', query_path, target_path)"
    body = _nested("marc", tasks, options="'auto' AS coding, CAST(NULL AS STRING) AS wanted, false AS lenient", source=source, more=", asked, searched")
    return f"SELECT {_KEYED}, asked, searched FROM ({body})"


def _subfields(fmt: str, tasks: int) -> str:
    """The body of a reader of subfields, one row each and one for a control field."""
    one = "array(named_struct('code', CAST(NULL AS STRING), 'value', f.value))"
    return f"""SELECT record_no, file, control_number, leader, f_no + 1 AS field_no, f.tag, f.ind1, f.ind2, s_no + 1 AS subfield_no, s.code, s.value
        FROM ({_nested(fmt, tasks, "CAST(NULL AS STRING)")}) LATERAL VIEW posexplode(fields) x AS f_no, f LATERAL VIEW posexplode(IF(f.subfields IS NULL, {one}, f.subfields)) y AS s_no, s
        WHERE coalesce(tags, '') = '' OR array_contains(transform(split(tags, ','), t -> trim(t)), f.tag)"""


_PYTHON = {
    "marc_pieces": (pieces.Pieces, "file string, start bigint, stop bigint, parts bigint"),
    "marc_pieces_of_both": (pieces.Both, "file string, start bigint, stop bigint, parts bigint, asked boolean, searched boolean"),
    "marc_count_piece": (pieces.Count, "n bigint, whole boolean"),
    "marc_read_piece": (pieces.Read, "record_no bigint, control_number string, leader string, fields string, raw string"),
    "read_marc_raw": (_Raw, "record_no bigint, file string, control_number string, leader string, raw binary, error string"),
    "marc_xslt_functions": (_Crosswalks, "alias string, path string, source_format string, target_format string, description string"),
    "marc_read_kbart": (_Kbart, None),
    "marc_read_answer": (_Answer, _FLAT_DDL),
    "marc_read_content": (_Text, "content string"),
    "marc_put_answer": (_Put, "status int, content_type string, body string"),
}


def _bodies(spark: SparkSession) -> dict[str, tuple[str, str]]:
    """(parameters, body) of the table functions in SQL."""
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    readers = {name: (_nested if name == "read_marc" else _subfields)(fmt, tasks) for name, fmt in READERS.items()}
    readers |= {name: _nested(fmt, tasks) for name, fmt in _NESTED.items()}
    both = {"marc_nearest_both": ("query_path STRING, target_path STRING", _both(tasks))}
    over = {name: (TABLES[name][0], TABLES[name][1].replace(_SORTING, str(M.sorting_tasks(spark)))) for name in [*_ORDER, *(n for n in TABLES if n not in _ORDER)]}
    return {name: (_OPTIONS, body) for name, body in readers.items()} | both | over


def _register_python(spark: SparkSession, name: str) -> None:
    kind, ddl = _PYTHON[name]
    spark.udtf.register(name, F.udtf(kind, returnType=ddl) if ddl else F.udtf(kind))


def _register_sql(spark: SparkSession, name: str, parameters: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN {body}")


def register_tables(spark: SparkSession) -> list[str]:
    """Registers the table functions (after ``catalog.register_all``); their names."""
    tables = _bodies(spark)
    for name in _PYTHON:
        _register_python(spark, name)
    for name, (parameters, body) in tables.items():
        _register_sql(spark, name, parameters, body)
    return [*_PYTHON, *tables]


def register_for(spark: SparkSession, sql: str) -> list[str]:
    """Registers the functions that a statement calls, those that they call before them; their names.
    To register all takes longer than many a statement."""
    tables, done = _bodies(spark), []

    def add(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b([a-z_][a-z0-9_]*)\s*\(", text.lower())):
            if name in done:
                continue
            if name in catalog.EXPRESSIONS:
                statement = catalog.EXPRESSIONS[name].statement(name)
                add(statement.partition(") RETURN ")[2])
                spark.sql(statement)
            elif name in udfs.FUNCTIONS:
                spark.udf.register(name, udfs.udf(name, name in udfs.ONCE))
            elif name in _PYTHON:
                _register_python(spark, name)
            elif name in tables:
                add(tables[name][1])
                _register_sql(spark, name, *tables[name])
            else:
                continue
            done.append(name)

    add(sql)
    return done
