"""Expression edits against the record edits, on random records."""

import random

import pytest
from pyspark.sql import functions as F

from stackwise.functions import crosswalks as X
from stackwise.functions import edits as D
from stackwise.functions import marcspec as S
from stackwise.functions import records as R
from stackwise.types import FIELDS_DDL, control, data


def some_records(n=60):
    rng = random.Random(6)
    found = [[], [None, data("245")], [{"tag": None, "ind1": None, "ind2": "", "value": None, "subfields": [None, {"code": None, "value": None}]}]]
    for _ in range(n):
        fields = []
        for _ in range(rng.randint(1, 6)):
            tag = rng.choice(["001", "005", "245", "246", "650", "651", "863", "853"])
            parts = [(rng.choice("ab08$"), rng.choice(["x", "a1b22", "1.2", "", "(q)", "É$"])) for _ in range(rng.randint(0, 4))]
            fields.append(control(tag, rng.choice(["x1", "a$2"])) if tag < "010" else data(tag, rng.choice(" 1"), rng.choice(" 0"), *parts))
        found.append(fields)
    return found


NEW = data("246", "3", " ", ("a", "new"))
CASES = {
    "clean": (lambda e: D.clean(e), lambda f: R.clean_fields(f)),
    "remove_fields": (lambda e: D.remove_fields(e, "24."), lambda f: R.remove_fields(f, "24.")),
    "remove_subfield": (lambda e: D.remove_subfield(e, "...", "a"), lambda f: R.remove_subfield(f, "...", "a")),
    "set_subfield": (lambda e: D.set_subfield(e, "65.", "b", "'z'"), lambda f: R.set_subfield(f, "65.", "b", "z")),
    "set_indicators": (lambda e: D.set_indicators(e, "6..", "9"), lambda f: R.set_indicators(f, "6..", "9", None)),
    "rename_subfield": (lambda e: D.rename_subfield(e, "245", "a", "$"), lambda f: R.rename_subfield(f, "245", "a", "$")),
    "replace_values": (lambda e: D.replace_values(e, "...", None, "([0-9])", "<$1|$&|$$>"), lambda f: R.replace_values(f, "...", None, "([0-9])", "<$1|$&|$$>")),
    "replace_in_code": (lambda e: D.replace_values(e, "2..", "a", "x|É", "\\"), lambda f: R.replace_values(f, "2..", "a", "x|É", "\\")),
    "sort_fields": (lambda e: D.sort_fields(e), lambda f: R.sort_fields(f)),
    "move_field": (lambda e: D.move_field(e, "65.", "900"), lambda f: R.move_field(f, "65.", "900")),
    "add_field": (lambda e: D.add_field(e, "new"), lambda f: R.add_field(f, NEW)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_as_record_edits(spark, name):
    expression, plain = CASES[name]
    records = some_records()
    frame = spark.createDataFrame([(i, r, NEW) for i, r in enumerate(records)], f"i int, fields {FIELDS_DDL}, new {FIELDS_DDL[6:-1]}")
    got = frame.select("i", F.expr(expression("fields")).alias("f")).orderBy("i").collect()
    for r in got:
        want = plain(records[r.i])
        assert r.asDict(recursive=True)["f"] == want, (records[r.i], want)
    assert frame.filter("i < 0").select(F.expr(expression("fields"))).collect() == []
    nulls = spark.sql(f"SELECT CAST(NULL AS {FIELDS_DDL}) AS fields, CAST(NULL AS {FIELDS_DDL[6:-1]}) AS new").select(F.expr(expression("fields")).alias("f"))
    assert nulls.first().f is None


def test_specs(spark):
    records = some_records()
    frame = spark.createDataFrame([(i, "00000nam a22é", r) for i, r in enumerate(records)], f"i int, leader string, fields {FIELDS_DDL}")
    texts = ["001", "00./0-1", "001/1", "001/#", "001/#-1", "005/1-#", "245", "24.$a", "245[0]$a[#]$b[0-1]", "65.[#]$a", "65.[#-1]$8[1-#]", "650^1", "650[5]$a", "LDR", "LDR/5-7", "LDR/#", "001$a"]
    row = frame.select("i", *[F.expr(D.spec("leader", "fields", t)).alias(f"c{k}") for k, t in enumerate(texts)]).collect()
    for r in row:
        for k, t in enumerate(texts):
            assert r[f"c{k}"] == S.evaluate(S.parse(t), "00000nam a22é", records[r.i]), (t, records[r.i])


def test_rda_words(spark):
    fields = [data("300", " ", " ", ("a", "xii, 20 p. : col. ill., facsims. (v.1) top.p. p.a"), ("b", "ports.")), data("250", " ", " ", ("a", "2nd ed."), ("b", "ed."))]
    got = spark.createDataFrame([(fields,)], f"fields {FIELDS_DDL}").select(F.expr(D.rda_expand("fields")).alias("f")).first()
    assert got.asDict(recursive=True)["f"] == R.rda_expand(fields)


def test_holdings(spark):
    records = [r for r in some_records(200) if any(f and f["tag"] == "863" for f in r)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(records)], f"i int, fields {FIELDS_DDL}")
    paired = frame.select("i", F.explode(F.expr(D.holdings_pairs("fields"))).alias("p")).select("i", "p", F.expr(D.expand_863("p.caption_field", "p.value_field")).alias("text")).collect()
    want = [(i, p["link"], p["caption_field"] is not None, X.expand_863(p["caption_field"], p["value_field"])) for i, r in enumerate(records) for p in X.holdings_pairs(r)]
    assert sorted((r.i, str(r.p.link), r.p.caption_field is not None, r.text) for r in paired) == sorted((i, str(a), b, c) for i, a, b, c in want)


def test_errors_when_the_plan_is_built(spark):
    for bad in (lambda: D.remove_fields("f", "2"), lambda: D.set_subfield("f", "245", "ab", "'x'"), lambda: D.replace_values("f", "245", None, "(", ""), lambda: D.move_field("f", "245", "2.5")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="boundary"):
        spark.createDataFrame([([control("001", "x")],)], f"fields {FIELDS_DDL}").select(F.expr(D.move_field("fields", "001", "245"))).collect()
