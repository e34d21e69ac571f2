"""The codecs and keys as JVM expressions against their Python."""

import pytest
from pyspark.sql import functions as F

from stackwise.codecs import breaker, iso2709, marcjson, marcxml
from stackwise.functions import expr as E
from stackwise.functions import records as R
from stackwise.functions import text as T
from stackwise.functions import udfs
from stackwise.sources import pieces, sql_tables, writers
from stackwise.types import FIELDS_DDL, control, data

EMPTY = {"tag": None, "ind1": None, "ind2": None, "value": None, "subfields": None}
PLAIN = [
    ("00000nam a2200000 a 4500", [control("001", "x1"), control("008", " " * 35 + "eng d"), data("020", " ", " ", ("a", "0306406152")), data("245", "1", "0", ("a", "Title :"), ("b", "rest")), data("260", " ", " ", ("c", "c1999."))]),
    ("00000nam a2200000 i 4500", [control("003", "y"), data("500", " ", " "), data("260", " ", " ", ("c", "none")), data("264", " ", "1", ("c", "2001")), data("600", " ", " ", ("a", "s"))]),
    ("00000nam a22000003i 4500", [control("001", "x3"), data("245", "1", "0", ("c", "no title")), data("700", "1", " ", ("a", "B"))]),
]
ODD = [
    ("x", [control("001", 'a$b\\c"<&>'), data("245", " ", "", ("a", "Ü$é"), ("b", None))]),
    (None, [data("245", "1", " ", ("a", "tab\there")), data("336"), data("337"), data("338")]),
    ("", [data("500", " ", " "), EMPTY]),
    ("00000nam a2200000 a 4500", [EMPTY, None, control("0012", "v"), data("245", None, None, (None, "n"), ("a", ""))]),
    (None, []),
]
WRITE = {
    "marc": iso2709.write,
    "mrk": lambda leader, fields: (breaker.write(leader, fields).removesuffix("\n") + "\n\n").encode(),
    "marcjson": lambda leader, fields: (marcjson.write(leader, fields) + "\n").encode(),
    "marcxml": lambda leader, fields: (marcxml.write(leader, fields).removesuffix("\n") + "\n").encode(),
}


def frame(spark, rows):
    made = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"n INT, leader STRING, fields {FIELDS_DDL}")
    return made.repartition(1).sortWithinPartitions("n")


@pytest.mark.parametrize("fmt", sorted(WRITE))
def test_written_as_the_codecs_write(spark, tmp_path, fmt):
    rows = PLAIN + ODD
    writers.write_records(frame(spark, rows), f"{tmp_path}/o", fmt, single_file=True)
    got = b"".join(f.read_bytes() for f in (tmp_path / "o").glob("part-*"))
    want = b"".join(WRITE[fmt](leader, fields) for leader, fields in rows)
    assert got == ((marcxml.HEADER.encode() + want + marcxml.FOOTER.encode()) if fmt == "marcxml" else want)


@pytest.mark.parametrize("fmt", ["marc", "mrk"])
@pytest.mark.parametrize("rows", [PLAIN, PLAIN + ODD[:1]])
def test_read_as_the_codecs_read(spark, tmp_path, fmt, rows):
    path = tmp_path / "records"
    path.write_bytes(b"".join(WRITE[fmt](leader, fields) for leader, fields in rows))
    assert (pieces.plain(fmt, path.read_bytes()) is not None) == (rows is PLAIN)
    want = [(n, r["leader"], r["fields"]) for n, r in pieces.records(fmt, str(path), 0, 0, 1, 0)]
    sql = f"SELECT * FROM {'read_marc' if fmt == 'marc' else 'marc_readnestedbreaker'}('{path}')"
    sql_tables.register_for(spark, sql)
    got = spark.sql(sql).orderBy("record_no").collect()
    assert [(r.record_no, r.leader, [f.asDict(True) for f in r.fields]) for r in got] == want
    assert [r.control_number for r in got] == [next((f["value"] for f in fields if f["tag"] == "001"), None) for _, _, fields in want]


def test_what_is_not_plain():
    whole = b"".join(iso2709.write(*r) for r in PLAIN)
    first = whole.find(b"\x1e")
    for odd in (whole[:-1], b" " + whole, whole.replace(b"Title", b"T\xc3\xa9tle"), whole[:27] + b"9" + whole[28:], whole[: first - 1] + b"x" + whole[first:], whole[:9] + b" " + whole[10:]):
        assert pieces.plain("marc", odd) is None
    for text in (b"x\n=LDR  a\n", b"=LDR  a\n=2\n", b"=LDR  a\r\n", "=LDR  é\n".encode()):
        assert pieces.plain("mrk", text) is None


def test_keys_and_ranks(spark):
    rows = PLAIN + [(leader, [f for f in fields if f is not None]) for leader, fields in ODD] + [("x", None)]
    rank = F.expr(E.rank("leader", "fields")).alias("rank")
    found = frame(spark, rows).select("n", rank, udfs.call_once("marc_matchkey_of", *E.match_key_parts("fields")).alias("mk"), udfs.call("marc_naco", E.nearest_title("fields")).alias("tk"), udfs.call("marc_nearest_key", "fields").alias("wanted"))
    for r in found.orderBy("n").collect():
        leader, fields = rows[r.n]
        assert (r.rank and r.rank.asDict()) == R.rank(leader, fields)
        assert r.mk == T.match_key(fields)
        assert r.tk == r.wanted


def test_only_what_is_called_is_registered(spark):
    names = sql_tables.register_for(spark, "SELECT * FROM task_dedupe_exact('x')")
    assert names.index("read_marc") < names.index("task_dedupe_exact") and len(names) < 12


def test_regular_xml_is_read_as_any_other():
    whole = marcxml.HEADER + "".join(marcxml.write(leader, fields) for leader, fields in PLAIN + ODD) + marcxml.FOOTER
    assert marcxml._regular(whole) == marcxml._any(whole) != []
    for odd in (whole.replace("<leader>", "<!-- a --><leader>", 1), whole.replace('ind1=" " ', ""), whole.replace("</collection>", "<record></record></collection>"), whole.replace('code="a"', "code='a'", 1)):
        assert marcxml._regular(odd) is None
    assert marcxml._regular("") == marcxml._any("") == []


TRICKY = [
    ("00000nam a2200000 a 4500", [control("001", "a\"b{}[]"), data('2"5', '"', " ", ("a", '}]}},{"x":"y'), ("\"", "q:"), ("b", "")), data("500", " ", " ")]),
    ('00000n"m a2200000 a 4500', [control("008", ""), data("245", "1", "0", ("a", "back\\slash"))]),
]


@pytest.mark.parametrize("fmt", ["marc", "mrk", "marcjson"])
def test_a_plain_piece_goes_to_the_jvm_whole(spark, tmp_path, fmt):
    rows = PLAIN + (TRICKY if fmt != "marcjson" else [])
    path = tmp_path / "records"
    path.write_bytes(b"".join(WRITE[fmt](leader, fields) for leader, fields in rows))
    sent = list(pieces.Read().eval(fmt, str(path), 0, path.stat().st_size, 1, 0, "auto", None, False))
    assert len(sent) == 1 and sent[0][4] is not None
    sql = f"SELECT record_no, file, field_no, tag, code, value FROM {dict(marc='read_marc_subfields', mrk='read_marc_breaker', marcjson='read_marcjson')[fmt]}('{path}')"
    sql_tables.register_for(spark, sql)
    want = [(n, k, f["tag"], c, v) for n, r in pieces.records(fmt, str(path), 0, 0, 1, 0) for k, f in enumerate(r["fields"], 1) for c, v in ([(None, f["value"])] if f["subfields"] is None else [(s["code"], s["value"]) for s in f["subfields"]])]
    assert [(r.record_no, r.field_no, r.tag, r.code, r.value) for r in spark.sql(sql).collect()] == want


@pytest.mark.parametrize("line", ['{"leader":"x","fields":[{"245":"no control field"}]}', '{"leader":"x","fields":[{"001":"\\u00e9"}]}', '{"leader":"x","fields":[{"245":{"ind1":"1","subfields":[]}}]}'])
def test_other_json_is_read_by_python(line):
    assert pieces.as_json("marcjson", line.encode()) is None


def test_pieces_of_a_batch_are_small():
    """Spark hands a hundred at a time to Python."""
    assert 100 * pieces.PIECE <= 16 << 20


@pytest.mark.parametrize("fmt", ["marc", "marcjson"])
def test_plain_files_are_written_without_python(spark, tmp_path, monkeypatch, fmt):
    monkeypatch.setattr(writers.udfs, "call", lambda *_: pytest.fail("Python was called"))
    writers.write_records(frame(spark, PLAIN), f"{tmp_path}/o", fmt, single_file=True)
    got = b"".join(f.read_bytes() for f in (tmp_path / "o").glob("part-*"))
    assert got == b"".join(WRITE[fmt](leader, fields) for leader, fields in PLAIN)


def test_a_file_of_both_paths_is_listed_once(tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_bytes(WRITE["marc"](*PLAIN[0]))
    found = list(pieces.Both().eval("marc", f"{tmp_path}/[ab]", f"{tmp_path}/[bc]"))
    assert [(p[0].rsplit("/", 1)[1], *p[4:]) for p in found] == [("a", True, False), ("b", True, True), ("c", False, True)]


def test_matches_of_two_paths(spark, tmp_path):
    for name in ("q", "t"):
        (tmp_path / name).write_bytes(b"".join(WRITE["marc"](*r) for r in PLAIN))
    sql = f"SELECT split_part(file_q, '/', -1), record_no_q, split_part(file_t, '/', -1), record_no_t, similarity FROM marc_nearest_matches_k('{tmp_path}/q', '{tmp_path}/[qt]', 2)"
    sql_tables.register_for(spark, sql)
    assert [tuple(r) for r in spark.sql(sql).collect()] == [("q", 1, "q", 1, 1.0), ("q", 1, "t", 1, 1.0)]
