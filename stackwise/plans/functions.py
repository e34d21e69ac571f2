"""Registered queries of single functions over the catalogue projection and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.crosswalks import CONTEXT
from ..types import FIELDS_DDL
from .catalogue import _HEADINGS, _NACO, at, call, columns, query
from .projection import bib

# ---- BIBFRAME documents ----------------------------------------------------------------------


def _ref(uri: str) -> str:
    return f"'{{\"@id\":\"' || {uri} || '\"}}'"


def _agent(label: str, kind: str = '"bf:Contribution"', role: str = "''") -> str:
    return f"""'{{"@type":{kind},"bf:agent":{{"@type":"bf:Person","rdfs:label":"' || {label} || '"}}' || {role} || '}}'"""


_ROLE = """CASE WHEN k % 4 = 0 THEN ',"bf:role":{"@type":"bf:Role","rdfs:label":"author"}' ELSE '' END"""
_TITLE = """CASE WHEN t1 IS NULL THEN '' ELSE ',"bf:title":{"@type":"bf:Title","bf:mainTitle":"' || t1 || '","bf:subtitle":"' || t2 || '"}' END"""
_CLASS = """'{"@type":"bf:ClassificationLcc","bf:classificationPortion":"QA' || (k % 900 + 1) || '.' || p_size || '","bf:itemPortion":".B' || p_size || ' ' || year || '"}'"""
_WORK = f"""'{{"@id":"' || ctl || '#work","@type":["bf:Work","' || CASE kind WHEN 'a' THEN 'bf:Text' ELSE 'bf:Audio' END || '"]' || {_TITLE}
 || ',"bf:contribution":[' || {_agent("p_brand", '["bf:Contribution","bflc:PrimaryContribution"]', _ROLE)} || CASE WHEN k % 8 = 0 THEN ',' || {_agent("'Helper, ' || p_brand")} ELSE '' END || ']'
 || ',"bf:subject":[{{"@type":"bf:Topic","rdfs:label":"' || p_type || '--Catalogues"}}' || CASE WHEN k % 3 = 0 THEN ',{{"@type":"bf:Topic","rdfs:label":"Things, ' || p_type || '"}}' ELSE '' END || ']'
 || ',"bf:language":{{"@id":"http://id.loc.gov/vocabulary/languages/eng"}},"bf:classification":[' || {_CLASS} || '],"bf:hasInstance":' || {_ref("ctl || '#instance'")} || '}}'"""
_INSTANCE = f"""'{{"@id":"' || ctl || '#instance","@type":"bf:Instance","bf:instanceOf":' || {_ref("ctl || '#work'")} || {_TITLE} || CASE WHEN tc IS NULL THEN '' ELSE ',"bf:responsibilityStatement":"' || tc || '"' END
 || ',"bf:provisionActivity":{{"@type":"bf:Publication","bf:place":{{"@type":"bf:Place","rdfs:label":"' || rtrim(pa, ' :') || '"}},"bf:agent":{{"@type":"bf:Agent","rdfs:label":"' || p_brand || ' Press"}},"bf:date":"' || year || '"}}'
 || ',"bf:identifiedBy":[{{"@type":"bf:Isbn","rdf:value":"' || isbn || '"}}],"bf:extent":{{"@type":"bf:Extent","rdfs:label":"' || p_size || ' p."}},"bf:electronicLocator":[' || {_ref("url")} || ']}}'"""
_CONTEXT = '{"@context":{' + ",".join(f'"{k}":"{v}"' for k, v in CONTEXT.items()) + '},"@graph":['


@query(f"SELECT k AS record_no, ctl AS id, {_WORK} AS work, {_INSTANCE} AS instance, '{_CONTEXT}' || {_WORK} || ',' || {_INSTANCE} || ']}}' AS document FROM b")
def bibframe_documents(spark, sf_dir):
    made = bib(spark, sf_dir).withColumn("id", call("marc_bf_id", "fields"))
    return made.select("record_no", "id", call("marc_bf_work", "leader", "fields", "id").alias("work"), call("marc_bf_instance", "leader", "fields", "id").alias("instance"), call("marc_bibframe_jsonld", "leader", "fields").alias("document"))


_HELPER = f"CASE WHEN k % 8 = 0 THEN {_agent(chr(39) + 'Helper, ' + chr(39) + ' || p_brand')} END"


@query(f"""SELECT k AS record_no, {_CLASS} AS classes, '[{{"@id":"http://v/' || p_brand || '"}},{{"@id":"http://v/x"}}]' AS vocab, {_HELPER} AS contrib, '{{"@type":"bf:Topic","rdfs:label":"' || p_type || '--Catalogues"}}' AS subject, '{{"@type":"bf:Isbn","rdf:value":"' || isbn || '"}}' AS ident,
 '"' || p_brand || ' \\"x\\""' AS str, '{{"a":1}}' AS obj, p_brand AS chomp, p_brand || ' Press' AS chompd, year AS date, p_type || '.' AS sf, p_type || '.|Catalogues' AS vals, p_type || '~Catalogues' AS joined FROM b""")
def bibframe_parts(spark, sf_dir):
    of = lambda tag: f"get(filter(fields, f -> f.tag = '{tag}'), 0)"
    return columns(
        spark, sf_dir, classes=F.array_join(call("marc_bf_classes", "fields"), "|"), vocab=call("marc_bf_vocab", f"array(rtrim(',', {at('100a')}), NULL, ' x ')", "'http://v/'"),
        contrib=call("marc_bf_contrib", of("700")), subject=call("marc_bf_subject", of("650")), ident=call("marc_bf_ident", "'bf:Isbn'", at("020a")), str=call("marc_bf_str", f"concat(rtrim(',', {at('100a')}), ' \"x\"')"),
        obj=call("marc_bf_obj", "array('\"a\":1', NULL)"), chomp=call("marc_bf_chomp", at("100a")), chompd=call("marc_bf_chompd", f"concat(rtrim(',', {at('100a')}), ' Press., ')"), date=call("marc_bf_date", f"coalesce({at('260c')}, {at('264c')})"),
        sf=call("marc_bf_sf", of("650"), "'a'"), vals=F.array_join(call("marc_bf_sfvals", "named_struct('tag', '650', 'ind1', ' ', 'ind2', ' ', 'value', CAST(NULL AS STRING), 'subfields', transform(get(filter(fields, f -> f.tag = '650'), 0).subfields, s -> named_struct('code', 'a', 'value', s.value)))", "'a'"), "|"),
        joined=call("marc_bf_sfjoin", of("650"), "'ax'", "'~'"),
    )


# ---- validation ------------------------------------------------------------------------------

_SCHEMA = '{"fields":{"300":{"repeatable":true,"subfields":{"a":{},"b":{}}},"500":{"required":true},"650":{"repeatable":false},"856":{"indicator1":{"codes":{"0":{}}},"subfields":{"u":{}}}}}'


@query("""SELECT k AS record_no, CASE WHEN t1 IS NULL THEN '245: required field missing' ELSE '' END AS bib, concat_ws('|', CASE WHEN k % 7 = 0 THEN '100$0: not in schema' END, CASE WHEN k % 4 = 0 THEN '100$e: not in schema' END) AS auth, '' AS holdings,
 concat_ws('|', '500: required field missing', CASE WHEN k % 3 = 0 THEN '650: non-repeatable field occurs 2 times' END, '300$c: not in schema', '856 ind1: ''4'' not one of [0]', CASE WHEN k % 3 = 1 THEN '856$y: not in schema' END) AS avram FROM b""")
def validate_packs(spark, sf_dir):
    one = lambda name, *more: F.array_join(call(name, *more), "|")
    return columns(spark, sf_dir, bib=one("marc_validate_bib", "leader", "fields"), auth=one("marc_validate_auth", "leader", "fields"), holdings=one("marc_validate_holdings", "leader", "fields"), avram=F.array_join(call("marc_validate_avram", F.col("leader"), F.col("fields"), F.lit(_SCHEMA)), "|"))


# ---- building --------------------------------------------------------------------------------


@query("""SELECT k AS record_no, '00000n' || CASE k % 7 WHEN 0 THEN 'am' WHEN 1 THEN 'as' WHEN 2 THEN 'gm' WHEN 3 THEN 'em' WHEN 4 THEN 'cm' WHEN 5 THEN 'mm' ELSE 'z ' END || CASE k % 7 WHEN 6 THEN ' a2200000o  4500' ELSE ' a22000005i 4500' END AS leader,
 CASE k % 7 WHEN 6 THEN '008 100' ELSE '008 245' END AS tags, 40::INT AS len FROM b""")
def new_record(spark, sf_dir):
    made = bib(spark, sf_dir).select("record_no", call("marc_new_record", "element_at(array('book', 'serial', 'video', 'map', 'music', 'electronic', 'authority'), CAST(record_no % 7 AS INT) + 1)").alias("r"))
    return made.select("record_no", "r.leader", F.array_join(F.transform("r.fields", lambda f: f["tag"]), " ").alias("tags"), F.expr("length(r.fields[0].value)").alias("len"))


@query("SELECT k AS record_no, t1 AS title, 'Lists' AS list, p_type || '!' AS subject FROM b")
def edit_replace_all(spark, sf_dir):
    rules = "array(named_struct('tag', '245', 'code', 'a', 'find', ' :$', 'replace', ''), named_struct('tag', '650', 'code', '', 'find', 'Catalogues', 'replace', 'Lists'), named_struct('tag', '6..', 'code', 'a', 'find', '\\\\.$', 'replace', '!'))"
    made = bib(spark, sf_dir).select("record_no", call("marc_replace_all", "fields", rules).alias("fields"))
    return made.select("record_no", F.expr(at("245a")).alias("title"), F.expr(at("650x")).alias("list"), F.expr(at("650a")).alias("subject"))


@query("""SELECT p_partkey AS record_no, '008 022 245 264|' || p_brand AS serial, '008 020 245 856|' || p_name AS electronic, '00000nas a22000005i 4500' AS serial_leader, 2::INT AS cleaned, '100 245' AS built, '100 245 500' AS sorted FROM part""")
def delimited_presets(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("record_no"), "p_name", "p_brand")
    made = part.withColumns({
        "s": call("marc_from_delimited", F.lit("serial"), call("marc_delimited_preset_serials", "p_name", F.lit("1234-5679"), F.col("p_brand"))),
        "e": call("marc_from_delimited", F.lit("electronic"), call("marc_delimited_preset_eresources", "p_name", F.lit("http://x"), F.lit("9780000000002"))),
        "c": call("marc_delimited_clean", "array(named_struct('tag', '245', 'i1', '0', 'i2', '0', 'code', 'a', 'value', p_name), named_struct('tag', '100', 'i1', '1', 'i2', ' ', 'code', 'a', 'value', p_brand), named_struct('tag', '500', 'i1', ' ', 'i2', ' ', 'code', 'a', 'value', '  '))"),
    })
    made = made.withColumn("b", call("marc_delimited_tagsort", call("marc_delimited_build", "c")))
    made = made.withColumn("a", call("marc_delimited_tagsort", F.expr(f"CAST(array(named_struct('tag', '500', 'ind1', ' ', 'ind2', ' ', 'value', CAST(NULL AS STRING), 'subfields', array(named_struct('code', 'a', 'value', p_name))), b[1], b[0]) AS {FIELDS_DDL})")))
    tags = lambda c: F.array_join(F.transform(c, lambda f: f["tag"]), " ")
    return made.select("record_no", F.concat(tags("s.fields"), F.lit("|"), F.expr(E.place("s.fields", "264b"))).alias("serial"), F.concat(tags("e.fields"), F.lit("|"), F.expr(E.place("e.fields", "245a"))).alias("electronic"), F.col("s.leader").alias("serial_leader"), F.size("c").alias("cleaned"), tags("b").alias("built"), tags("a").alias("sorted"))


# ---- headings, call numbers, keys ------------------------------------------------------------

_GRAMS = "array_to_string(list_sort(list_distinct(list_transform(range(1, length(z)), lambda i: z[i : i + 1]))), '')"


@query(f"SELECT k AS record_no, 'QA' AS class, (k % 900 + 1)::VARCHAR AS number, p_size::VARCHAR AS decimal, 'B' || p_size AS cutters, year, true AS valid, {_GRAMS} AS grams, array_to_string(list_sort(list_distinct(string_split(lower(replace(p_type, '.', '')), ' '))), ' ') AS fingerprint FROM (SELECT *, lower(replace(p_brand, '#', '')) AS z FROM b)")
def keys_of_text(spark, sf_dir):
    made = columns(spark, sf_dir, c=call("marc_lcc_parse", f"concat({at('050a')}, ' ', {at('050b')})"), grams=call("marc_ngram_fingerprint", f"rtrim(',', {at('100a')})", "2"), fingerprint=call("marc_fingerprint", at("650a")))
    return made.select("record_no", "c.class", "c.number", "c.decimal", F.array_join("c.cutters", "|").alias("cutters"), "c.year", "c.valid", "grams", "fingerprint")


@query(_HEADINGS + f"SELECT k AS record_no, string_agg({_NACO.format('heading')}, '|' ORDER BY {_NACO.format('heading')}) AS nacos FROM h GROUP BY k")
def headings_naco(spark, sf_dir):
    return columns(spark, sf_dir, nacos=F.array_join(F.array_sort(call("marc_headings_naco", "fields")), "|"))


@query("SELECT k AS record_no, CASE WHEN k % 8 = 0 THEN 'Helper, ' || p_brand || ' > Aide' ELSE '' END AS flips FROM b")
def heading_flips(spark, sf_dir):
    refs = f"array(named_struct('kind', 'authorized', 'tag', '100', 'heading', 'Aide'), named_struct('kind', 'see_from', 'tag', '400', 'heading', concat('HELPER ', rtrim(',', {at('100a')}))), named_struct('kind', 'see_also', 'tag', '500', 'heading', {at('650a')}))"
    made = columns(spark, sf_dir, f=call("marc_heading_flips", E.headings("fields"), refs))
    return made.select("record_no", F.array_join(F.transform("f", lambda x: F.concat(x["heading"], F.lit(" > "), x["authorized"])), "|").alias("flips"))


# ---- texts for other systems -----------------------------------------------------------------


@query("""SELECT p_partkey AS record_no, p_name || ' &amp; &lt;i&gt; &quot;x&quot;' AS xml, '''' || p_name || ' ''''s''' AS quoted, '''' || p_name || ' ''\\''''s''' AS shell, p_name || ' &amp; &lt;' AS alma, 'marcxml-to-mods.xsl' AS sheet, 'xsltproc --output ''o'' ''marcxml-to-ris.xsl'' ''' || p_name || '''' AS command, NULL::VARCHAR AS unknown FROM part""")
def escapes(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = "concat(p_name, ' & <i> \"x\"')"
    own = {"xml": F.expr(E.xml_escape(text)), "quoted": F.expr(E.sql_quote("concat(p_name, ' \\'s')")), "shell": F.expr(E.shell_arg("concat(p_name, ' \\'s')")), "alma": call("marc_alma_xml_escape", "concat(p_name, ' & <')"), "sheet": call("marc_xslt_sheet_file", "'marc=>mods'"), "command": call("marc_xslt_command", "'MARC=>RIS'", "p_name", "'o'"), "unknown": call("marc_xslt_command", "p_name", "'i'", "'o'")}
    return part.select(F.col("p_partkey").alias("record_no"), *[e.alias(n) for n, e in own.items()])


@query("""SELECT p_partkey AS record_no, 'http://o?verb=ListRecords&resumptionToken=' || url_encode(p_type || '/!') AS page, p_type AS token, NULL::VARCHAR AS no_token, 'https://id.loc.gov/authorities/subjects/label/' || url_encode(p_type) AS label, 'https://www.wikidata.org/w/api.php?action=wbsearchentities&format=json&language=de&uselang=de&type=item&limit=3&search=' || url_encode(p_name) AS wikidata, 'apikey ' || p_brand AS auth, 'application/xml' AS accept, 1::INT AS plain_headers FROM part""")
def service_texts(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = {"page": E.oai_page_url("'http://o'", "concat(p_type, '/!')"), "token": E.oai_extract_token("concat('<r><oai:resumptionToken cursor=\"0\"> ', p_type, ' </oai:resumptionToken></r>')"), "no_token": E.oai_extract_token("concat('<r><resumptionToken> </resumptionToken>', p_type, '</r>')"), "label": E.idloc_label_url("p_type", "'subjects'"), "wikidata": E.wikidata_search_url("p_name", "'de'", "3"), "auth": f"{E.alma_headers('p_brand')}['Authorization']", "accept": f"{E.alma_headers('p_brand')}['Accept']", "plain_headers": f"size({E.alma_headers('CAST(NULL AS STRING)')})"}
    return part.select(F.col("p_partkey").alias("record_no"), *[F.expr(e).alias(n) for n, e in own.items()])


@query("""SELECT p_partkey AS record_no, p_name || '|http://i/' || p_partkey || '|n' || p_partkey AS idloc, 'v' || p_partkey || '|Personal|' || p_name AS viaf, 'Q' || p_partkey || '|' || p_name || '|' || p_type || '|http://w' AS wikidata, 2::INT AS n FROM part""")
def service_candidates(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    made = part.selectExpr(
        "p_partkey AS record_no",
        f"{E.idloc_candidates("to_json(named_struct('hits', array(named_struct('aLabel', p_name, 'uri', concat('http://i/', p_partkey), 'token', concat('n', p_partkey)), named_struct('aLabel', 'x', 'uri', 'y', 'token', 'z'))))")} AS i",
        f"{E.viaf_candidates("concat('{\"searchRetrieveResponse\":{\"records\":{\"record\":[{\"recordData\":{\"VIAFCluster\":{\"viafID\":\"v', p_partkey, '\",\"nameType\":\"Personal\",\"mainHeadings\":{\"data\":[{\"text\":\"', p_name, '\"}]}}}}]}}}')")} AS v",
        f"{E.wikidata_candidates("to_json(named_struct('search', array(named_struct('id', concat('Q', p_partkey), 'label', p_name, 'description', p_type, 'concepturi', 'http://w'))))")} AS w",
    )
    return made.selectExpr("record_no", "concat_ws('|', i[0].label, i[0].uri, i[0].token) AS idloc", "concat_ws('|', v[0].viaf_id, v[0].name_type, v[0].heading) AS viaf", "concat_ws('|', w[0].id, w[0].label, w[0].description, w[0].concepturi) AS wikidata", "size(i) AS n")


# ---- ISBD area 6, records as variants, paired captions ---------------------------------------


@query("SELECT k AS record_no, '(' || p_type || CASE WHEN k % 2 = 0 THEN ' ; ' || k ELSE '' END || ')' AS area, CASE WHEN k % 3 = 0 THEN 'ISSN 1234-5679' ELSE 'ISBN 1' END AS number, leader AS leader, 'eng' AS language FROM b")
def isbd_series(spark, sf_dir):
    one = lambda tag, *parts: f"named_struct('tag', '{tag}', 'ind1', ' ', 'ind2', ' ', 'value', CAST(NULL AS STRING), 'subfields', array_compact(array({', '.join(parts)})))"
    sub = lambda code, value: f"named_struct('code', '{code}', 'value', {value})"
    made = bib(spark, sf_dir).withColumn("type", F.expr(f"rtrim('.', {at('650a')})"))
    made = made.withColumn("own", F.expr(f"CAST(array({one('020', sub('a', "'1 :'"))}, {one('022', sub('a', "'1234-5679'"))}, {one('490', sub('a', "concat(type, ' ;')"), f"IF(record_no % 2 = 0, {sub('v', 'CAST(record_no AS STRING)')}, NULL)")}) AS {FIELDS_DDL})"))
    serial = "concat(substring(leader, 1, 7), IF(record_no % 3 = 0, 's', 'm'), substring(leader, 9))"
    areas = E.isbd_areas(serial, "own")
    made = made.withColumn("v", F.expr(E.variant("leader", "fields")))
    language = "substring(get(filter(fields, f -> f.tag = '008'), 0).value, 36, 3) AS language"
    return made.selectExpr("record_no", f"{areas[6]} AS area", f"{areas[8]} AS number", "variant_get(v, '$.leader', 'string') AS leader", language)


@query("SELECT l_orderkey AS order_no, l_linenumber AS line_no, 'a=v.=' || l_linenumber || '|b=no.=' || l_quantity::BIGINT AS zipped FROM lineitem")
def holdings_zip(spark, sf_dir):
    data = lambda tag, parts: f"named_struct('tag', '{tag}', 'ind1', ' ', 'ind2', ' ', 'value', CAST(NULL AS STRING), 'subfields', array({', '.join(f"named_struct('code', '{c}', 'value', {v})" for c, v in parts)}))"
    cap = data("853", (("8", "'1'"), ("a", "'v.'"), ("b", "'no.'"), ("i", "'(year)'")))
    val = data("863", (("8", "'1.1'"), ("a", "CAST(l_linenumber AS STRING)"), ("b", "CAST(CAST(l_quantity AS BIGINT) AS STRING)"), ("i", "'1999'")))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"), call("marc_86x_zip", cap, val).alias("z"))
    return lines.select("order_no", "line_no", F.array_join(F.transform("z", lambda x: F.concat_ws("=", x["code"], x["cap"], x["val"])), "|").alias("zipped"))


@query("""SELECT p_partkey AS record_no, 'SELECT status, content_type, body FROM marc_alma_update_bib(''https://a'', ''' || p_partkey || ''', NULL, ''<bib>' || p_name || '''''s</bib>'', true, false)' AS put, 'SELECT * FROM marc_nearest_matches_k(''a.mrc'', ''' || p_name || '.mrc'', ' || (1 + p_size) || ')' AS nearest FROM part""")
def statements(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    put = E.alma_put_statement("'https://a'", "CAST(p_partkey AS STRING)", "CAST(NULL AS STRING)", "concat('<bib>', p_name, '\\'s</bib>')", "true", "false")
    return part.select(F.col("p_partkey").alias("record_no"), F.expr(put).alias("put"), F.expr(E.nearest_statement("'a.mrc'", "concat(p_name, '.mrc')", "CAST(1 + p_size AS DOUBLE)")).alias("nearest"))
