import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from socketserver import BaseRequestHandler, ThreadingTCPServer

import pytest

from stackwise.codecs import breaker, iso2709, lines, marc8, marcjson, marcxml
from stackwise.codecs.errors import RecordError
from stackwise.functions import catalog
from stackwise.operators import crosswalk_files, reports
from stackwise.sources import readers, services, writers, z3950
from stackwise.streaming import ingest
from stackwise.types import FIELDS_DDL, control, data

RECORDS = [
    [control("001", "r1"), control("008", "x" * 40), data("245", "1", "0", ("a", "Łódź & <co> :"), ("b", ""), ("c", "$5\n~")), data("650", " ", "0", ("a", "Ünï"))],
    [control("001", "r2"), data("245", "0", "4", ("a", "日本語 😀"))],
    [control("001", "r3"), data("245", "0", "0", ("a", "plain")), data("500")],
]


@pytest.mark.parametrize("codec", [breaker, marcxml, marcjson])
def test_text_round_trips(codec):
    some = [[f for f in r] for r in RECORDS]
    some[0][2] = data("245", "1", "0", ("a", "Łódź & <co> :"), ("b", ""), ("c", "$5 ~"))
    for fields in some:
        assert codec.parse(codec.write("00000nam a2200000 a 4500", fields))[0]["fields"] == fields


def test_iso2709_round_trips_and_errors():
    for fields in RECORDS:
        assert iso2709.parse(iso2709.write(None, fields))["fields"] == fields
    raw = iso2709.write(None, RECORDS[0])
    lying = b"99999" + raw[5:12] + b"00000" + raw[17:]
    assert iso2709.parse(lying)["fields"] == RECORDS[0] and iso2709.parse(lying)["leader"].startswith("99999")
    for bad, said in ((raw[:20], "record shorter than leader"), (raw[:30], "no directory terminator"), (raw[:24] + b"x" + raw[24:], "not multiple of 12"), (raw[:27] + b"abcd" + raw[31:], "non-numeric directory entry for tag 001"), (raw[:-20], "extends past end of record")):
        with pytest.raises(RecordError, match=said):
            iso2709.parse(bad)
    with pytest.raises(RecordError, match="9999"):
        iso2709.write(None, [control("001", "x" * 10_000)])


@pytest.mark.parametrize("text", ["Łódź café", "привет", "שלום", "H₂O²α", "مرحبا", "ấ ộ", "plain"])
def test_marc8(text):
    assert marc8.decode(marc8.encode(text)) == text


def test_marc8_never_fails():
    assert marc8.encode("日") == b"&#x65E5;" and marc8.decode(b"\x1b$1!0!\x1b(Ba\xff\x1b") == "�a�\x1b"
    assert iso2709.parse(iso2709.write(None, RECORDS[0], "marc8"))["fields"] == RECORDS[0]


def test_line_formats():
    aleph = "000000001 LDR   L 00000nam^^22\n000000001 001   L a^b\n000000001 24510 L $$aT :$$bs\n\n000000002 001   L z\n"
    assert [len(r["fields"]) for r in lines.parse_aleph(aleph)] == [2, 1] and lines.parse_aleph(aleph)[0]["fields"][0]["value"] == "a b"
    lif = "HEADR x\nLDR00000nam\n001abc\n24510Implied_bsub_c1_`\n24500second`\n"
    found = lines.parse_microlif(lif)
    assert len(found) == 2 and [s["code"] for s in found[0]["fields"][1]["subfields"]] == ["a", "b", "c"]
    with pytest.raises(RecordError):
        lines.parse_aleph("bad")


def test_envelopes():
    xml = '<oai:record><header/><metadata><m:record><m:leader>abc</m:leader><m:controlfield tag="001">1 &#x41;&amp;&bad;</m:controlfield><m:datafield tag="245" ind1="1"><m:subfield code="a"/></m:datafield></m:record></metadata></oai:record><record><header status="deleted"/></record>'
    found = marcxml.parse(xml)
    assert len(found) == 1 and found[0]["fields"] == [control("001", "1 A&&bad;"), data("245", "1", " ", ("a", ""))]
    with pytest.raises(RecordError, match="tag"):
        marcxml.parse("<record><controlfield>x</controlfield></record>")
    one = {"fields": [{"001": "a"}]}
    for text in (json.dumps(one), json.dumps([one]), json.dumps(one) + "\n" + json.dumps(one), json.dumps({"parsedRecord": {"content": one}}), json.dumps({"sourceRecords": [{"parsedRecord": {"content": one}}]})):
        assert marcjson.parse(text)[0]["fields"] == [control("001", "a")]
    for text in ("", "{}", '{"fields":[{"245":"x"}]}', '{"fields":[{"001":"a","003":"b"}]}'):
        with pytest.raises(RecordError):
            marcjson.parse(text)


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([("00000nam a2200000 a 4500", r) for r in RECORDS], f"leader string, fields {FIELDS_DDL}")


def plain(rows):
    return [r.asDict(recursive=True)["fields"] for r in rows]


@pytest.mark.parametrize("fmt", ["marcxml", "mrk", "marcjson"])
def test_write_and_read_text_formats(spark, frame, tmp_path, fmt):
    kept = frame.filter("fields[0].value != 'r1'") if fmt == "mrk" else frame  # a breaker line has no line break
    writers.write_records(kept, f"{tmp_path}/out", fmt, single_file=True)
    found = readers.read_records(spark, f"{tmp_path}/out/part-*", fmt).orderBy("record_no").collect()
    assert plain(found) == (RECORDS[1:] if fmt == "mrk" else RECORDS) and found[-1].control_number == "r3"
    for p in tmp_path.glob("out/part-*"):
        (tmp_path / "zipped.gz").write_bytes(gzip.compress(p.read_bytes()))
    assert readers.read_records(spark, f"{tmp_path}/zipped.gz", fmt, tags="245").count() == len(found)


def test_write_and_read_iso2709(spark, frame, tmp_path):
    writers.write_records(frame, f"{tmp_path}/out", "marc", single_file=True)
    got = readers.read_marc(spark, f"{tmp_path}/out/part-*").orderBy("record_no").collect()
    assert plain(got) == RECORDS and [r.record_no for r in got] == [1, 2, 3]
    some = readers.read_marc(spark, f"{tmp_path}/out/part-*", tags="650").orderBy("record_no").collect()
    assert [len(r.fields) for r in some] == [1, 0, 0] and some[1].control_number == "r2"
    assert [r.subfield_no for r in readers.read_marc_subfields(spark, f"{tmp_path}/out/part-*", tags="245").orderBy("record_no", "subfield_no").collect()] == [1, 2, 3, 1, 1]


def test_many_blocks_keep_ordinals(spark, tmp_path):
    raw = b"".join(iso2709.write(None, [control("001", f"n{i}"), data("245", "0", "0", ("a", "line\nbreak " * (i % 9)))]) for i in range(1, 3001))
    (tmp_path / "big.mrc").write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        frame = readers.read_marc(spark, f"{tmp_path}/big.mrc")
        got = frame.collect()
        assert frame.rdd.getNumPartitions() > 1 and len(got) == 3000 and all(r.control_number == f"n{r.record_no}" for r in got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bad_records(spark, tmp_path):
    good = iso2709.write(None, RECORDS[0])
    (tmp_path / "x.mrc").write_bytes(good + good[:27] + b"abcd" + good[31:] + b"\r\n" + good + good[:40])
    raw = readers.read_marc_raw(spark, f"{tmp_path}/x.mrc").orderBy("record_no").collect()
    assert [r.error for r in raw] == [None, "non-numeric directory entry for tag 001", None, "no directory terminator"] and raw[0].raw == good
    assert [r.record_no for r in readers.read_marc(spark, f"{tmp_path}/x.mrc", ignore_errors=True).orderBy("record_no").collect()] == [1, 3]
    with pytest.raises(Exception, match="record 2: non-numeric"):
        readers.read_marc(spark, f"{tmp_path}/x.mrc").collect()


def test_reports_on_files(spark, frame, tmp_path):
    writers.write_records(frame, f"{tmp_path}/out", "marc", single_file=True)
    found = {r.tag: (r["count"], r.records_with, r.pct_records) for r in reports.report_tags(readers.read_marc(spark, f"{tmp_path}/out/part-*")).collect()}
    assert found == {"001": (3, 3, 100.0), "008": (1, 1, 33.3), "245": (3, 3, 100.0), "500": (1, 1, 33.3), "650": (1, 1, 33.3)}


def test_sql_functions(spark, frame):
    names = catalog.register_all(spark)
    assert len(names) == len(set(names)) == len(catalog.describe()) > 150
    frame.createOrReplaceTempView("r")
    row = spark.sql("SELECT marc_subfield(fields, '245', 'a') t, marc_isbn13('0306406152') i, size(marc_headings(fields)) h, marc_isbd(leader, fields) d, marc_oai_url('b', set_ => 's t') u, marc_naco(marc_subfield(fields, '650', 'a')) n, marc_dublin_core(leader, fields).type y, marc_rda_check(leader, fields)[0] c, task_rda_upgrade(leader, fields).leader l FROM r WHERE marc_control_field(fields, '001') = 'r1'").first()
    assert tuple(row) == ("Łódź & <co> :", "9780306406157", 1, "Łódź & <co> :  / $5\n~", "b?verb=ListRecords&metadataPrefix=marc21&set=s%20t", "UNI", "text", "desc_aacr2", "00000nam a2200000 i 4500")


@pytest.mark.parametrize(
    "made, same, python",
    [
        ("task_vendor_clean(fields, 'O''x')", "marc_stamp(marc_remove_subfield(marc_remove_fields(fields, '9..'), '856', '9'), 'O''x')", 0),
        ("array_contains(marc_rda_check(leader, fields), 'aacr2_abbreviations')", "NOT marc_rda_expand(fields) <=> fields", 0),
        ("task_rda_upgrade(leader, fields).fields", "marc_set_subfield(marc_rda_expand(marc_generate_33x(leader, marc_remove_subfield(fields, '245', 'h'))), '040', 'e', 'rda')", 1),
    ],
)
def test_workflow_functions_leave_the_jvm_for_33x_only(spark, frame, made, same, python):
    """The same as of the functions that they are made of, without a row going to Python for edits."""
    catalog.register_all(spark)
    frame.createOrReplaceTempView("r")
    found = spark.sql(f"SELECT {made} AS x FROM r")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == python
    assert found.collect() == spark.sql(f"SELECT {same} AS x FROM r").collect()


def test_crosswalk_catalogue(spark):
    assert crosswalk_files.crosswalks(spark).count() == 27
    assert crosswalk_files.command("marc=>mods", "in'x.xml", "o") == "xsltproc --output 'o' 'marcxml-to-mods.xsl' 'in'\\''x.xml'"
    assert crosswalk_files.command("no", "a", "b") is None


class _Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        page = 2 if "resumptionToken" in self.path else 1
        token = "<resumptionToken cursor=\"0\">next page/1</resumptionToken>" if page == 1 else "<resumptionToken/>"
        body = f"<OAI><ListRecords>{marcxml.write(None, RECORDS[page - 1])}</ListRecords>{token}</OAI>".encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_services(spark):
    server = HTTPServer(("127.0.0.1", 0), _Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/oai"
    try:
        assert services.read_oai(spark, base).count() == 1
        assert {r.control_number for r in services.read_oai(spark, base, pages=None).collect()} == {"r1", "r2"}
        assert tuple(services.oai_token(spark, base).first()) == ("next page/1", None, 0, None)
        assert services.read_system(spark, "koha", base, "7").first().control_number == "r1"
        assert services.read_sru(spark, base, 'title="x y"').count() == 1
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="confirm"):
        services.put_record(base, "<bib/>", {})


class _Library(BaseRequestHandler):
    def handle(self):
        left = b""
        while data_ := self.request.recv(65536):
            left += data_
            while (item := z3950.read(left)) is not None:
                left = left[item[4] :]
                self.request.sendall(self.answer(item[1], item[3]))

    def answer(self, kind, body):
        c = z3950.context
        if kind == 20:
            return c(21, c(12, plain=b"\xff"))
        if kind == 22:
            return c(23, c(23, plain=z3950.integer(len(RECORDS))), c(22, plain=b"\xff"))
        start, count = (int.from_bytes(z3950.child(body, n), "big") for n in (30, 29))
        entries = []
        for fields in RECORDS[start - 1 : start - 1 + count]:
            external = z3950.tlv(0, 8, z3950.tlv(0, 6, z3950.oid(z3950.USMARC)) + c(1, plain=iso2709.write(None, fields)), True)
            entries.append(z3950.tlv(0, 16, c(1, c(1, external)), True))
        return c(25, c(24, plain=z3950.integer(len(entries))), c(28, *entries))


def test_z3950(spark, monkeypatch):
    server = ThreadingTCPServer(("127.0.0.1", 0), _Library)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = z3950.read_z3950(spark, "127.0.0.1", server.server_address[1], "db", '@attr 1=4 "river boats"', 2).collect()
    finally:
        server.shutdown()
    assert [(r.record_no, r.hits, r.control_number) for r in got] == [(1, 3, "r1"), (2, 3, "r2")]
    assert z3950.parse_query("bare words") == ([(1, 1016)], "bare words")
    with pytest.raises(ValueError):
        z3950.parse_query("@and a b")


def test_streaming(spark, frame, tmp_path):
    writers.write_records(frame, f"{tmp_path}/land/a", "marc", single_file=True)
    writers.write_records(frame.limit(1), f"{tmp_path}/land/b", "marc", single_file=True)
    stream = ingest.first_of_key(ingest.stream_records(spark, f"{tmp_path}/land"))
    run = stream.select("control_number").writeStream.format("memory").queryName("landed").option("checkpointLocation", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.control_number for r in spark.table("landed").collect()) == ["r1", "r2", "r3"]


@pytest.mark.parametrize("fmt", ["marc", "marcxml", "marcjson"])
def test_data_sources(spark, frame, tmp_path, fmt):
    from stackwise.sources.datasource import register_sources

    register_sources(spark)
    frame.coalesce(1).write.format(fmt).mode("append").save(f"{tmp_path}/out")
    got = spark.read.format(fmt).load(f"{tmp_path}/out").orderBy("record_no").collect()
    assert plain(got) == RECORDS and got[0].control_number == "r1"
    frame.limit(1).coalesce(1).write.format(fmt).mode("overwrite").save(f"{tmp_path}/out")
    assert spark.read.format(fmt).option("tags", "245").load(f"{tmp_path}/out").first().fields[0].tag == "245"


def test_sql_tables(spark, frame, tmp_path):
    from stackwise.sources.sql_tables import register_tables

    catalog.register_all(spark)
    register_tables(spark)
    writers.write_records(frame, f"{tmp_path}/out", "marc", single_file=True)
    writers.write_records(frame, f"{tmp_path}/xml", "marcxml", single_file=True)
    path, xml = f"{tmp_path}/out/part-*", f"{tmp_path}/xml/part-*"
    ask = lambda sql: [tuple(r) for r in spark.sql(sql).collect()]
    assert ask(f"SELECT control_number FROM read_marc('{path}', tags => '245') ORDER BY record_no") == [("r1",), ("r2",), ("r3",)]
    assert ask(f"SELECT * FROM marc_report_tags('{path}')")[2] == ("245", 3, 3, 100.0)
    assert ask(f"SELECT * FROM marc_report_subfields('{path}', '245')") == [("a", 3, 3), ("b", 1, 1), ("c", 1, 1)]
    assert ask(f"SELECT records, files, total_fields, marc8_records FROM marc_summary('{path}')") == [(3, 1, 8, 0)]
    assert ask(f"SELECT count(*) FROM read_marc_subfields('{path}')") == ask(f"SELECT count(*) FROM read_marcxml('{xml}')") == [(10,)]
    assert ask(f"SELECT error FROM read_marc_raw('{path}')") == [(None,)] * 3 and ask("SELECT count(*) FROM marc_xslt_functions()") == [(27,)]
    nested = spark.sql(f"SELECT fields FROM marc_readnestedxml('{xml}') ORDER BY record_no").collect()
    assert plain(nested)[:2] == RECORDS[:2]
    assert ask(f"SELECT issue FROM task_rda_profile('{path}') LIMIT 1") == [("desc_aacr2",)]
    assert ask(f"SELECT heading FROM marc_reconcile_headings('{path}', 'viaf')") == [("Ünï",)]
    assert ask(f"SELECT violation FROM marc_report_errors('{path}')") == [("data field with no subfields",)]


@pytest.mark.parametrize("fmt", ["marc", "marcxml", "mrk", "marcjson"])
def test_pieces_of_one_file(tmp_path, fmt):
    from stackwise.sources import pieces

    fields = lambda n: [control("001", f"r{n}"), data("245", "1", "0", ("a", f"Ünï </record> <record> }} {{ {'long ' * (n % 9)}"))]
    write = {"marc": iso2709.write, "marcxml": marcxml.write, "mrk": lambda *r: breaker.write(*r) + "\n", "marcjson": lambda *r: marcjson.write(*r) + "\n"}[fmt]
    each = [write("00000nam a2200000 a 4500", fields(n)) for n in range(40)]
    whole = b"".join(x if isinstance(x, bytes) else x.encode() for x in each)
    texts = [whole, marcxml.HEADER.encode() + b"<!-- </record> <record> -->" + whole] if fmt == "marcxml" else [whole]
    for k, text in enumerate(texts):
        (tmp_path / f"{fmt}{k}").write_bytes(text)
        want = [r for _, r in pieces.records(fmt, f"{tmp_path}/{fmt}{k}", 0, 0, 1, 0)]
        assert len(want) == 40
        for size in (50, 300, 2000):
            found = list(pieces.pieces(fmt, f"{tmp_path}/{fmt}{k}", size))
            counts = [pieces.count(fmt, *p) for p in found]
            assert len(found) > 1 and any(c[1] for c in counts) == (k == 1)
            if not k:
                got = [list(pieces.records(fmt, *p, sum(c[0] for c in counts[:i]))) for i, p in enumerate(found)]
                assert [len(g) for g in got] == [c[0] for c in counts]
                assert [r for g in got for r in g] == list(enumerate(want, 1))


def test_one_file_by_many_tasks(spark, tmp_path):
    from stackwise.plans.projection import bib
    from stackwise.sources.sql_tables import register_tables

    catalog.register_all(spark)
    register_tables(spark)
    records = bib(spark, "/root/testdata/sf0.01", in_order=True)
    for fmt, name in (("marc", "read_marc"), ("mrk", "marc_readnestedbreaker")):
        writers.write_records(records, f"{tmp_path}/{fmt}", fmt, single_file=True)
        found = spark.sql(f"SELECT * FROM {name}('{tmp_path}/{fmt}/part-*')")
        assert found.rdd.getNumPartitions() > 1
        assert found.filter("concat('b', lpad(CAST(record_no - 1 AS STRING), 8, '0')) = control_number").count() == records.count()
