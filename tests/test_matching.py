"""Unblocked matching against all pairs by hand."""

import random

import pytest
from pyspark.sql import functions as F

from stackwise.functions.text import jaro_winkler
from stackwise.operators import matching
from stackwise.plans import catalogue, tables  # noqa: F401  (registers the queries of the table functions)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def keyed(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    titles = [rng.choice([None, rng.choice(words), rng.choice(words) + " " + rng.choice(words)]) for _ in range(150)]
    rows = [("f", i, t, t and t.upper(), t and t.upper(), rng.choice([None, *"abcdefgh"])) for i, t in enumerate(titles)]
    return rows, spark.createDataFrame(rows, "file string, record_no long, title string, naco string, tkey string, matchkey string").repartition(3)


@pytest.mark.parametrize("threshold", [0.3, 0.72, 0.93])
def test_dedupe_compares_all(keyed, monkeypatch, threshold):
    rows, frame = keyed
    monkeypatch.setattr(matching, "_keyed", lambda records: records)
    got = sorted((r.record_no_a, r.record_no_b, r.similarity, r.same_matchkey) for r in matching.dedupe_candidates(frame, threshold).collect())
    want = []
    for x in rows:
        for y in rows[x[1] + 1 :]:
            sim, same = jaro_winkler(x[3], y[3]), x[5] is not None and x[5] == y[5]
            if same or (sim is not None and sim >= threshold):
                want.append((x[1], y[1], sim, same))
    assert got == want


def test_nearest_of_all(keyed, monkeypatch):
    rows, frame = keyed
    monkeypatch.setattr(matching, "_keyed", lambda records: records)
    got = sorted((r.record_no_q, -r.similarity, r.record_no_t) for r in matching.nearest_matches(frame, frame, k=4).collect())
    want = [(x[1], *p) for x in rows if x[4] for p in sorted((-jaro_winkler(x[4], y[4]), y[1]) for y in rows if y[4])[:4]]
    assert got == want


def test_records_without_a_match(keyed, monkeypatch):
    rows, frame = keyed
    monkeypatch.setattr(matching, "_keyed", lambda records: records)
    some, few = frame.filter("record_no < 40"), frame.filter("record_no >= 140")
    inner, left, anti = ({(r.record_no_q, r.asDict().get("record_no_t")) for r in matching.nearest_matches(some, few, 0.95, how=h).collect()} for h in ("inner", "left", "anti"))
    assert inner and anti and left == inner | {(q, None) for q, _ in anti}
    assert {q for q, _ in left} == set(range(40)) and not {q for q, _ in inner} & {q for q, _ in anti}


def test_no_block_in_the_registered_result(spark):
    """Records with one 245$a and different 245$b are candidates."""
    assert catalogue.QUERIES["dedupe_candidates"](spark, SF).filter("similarity = 1").count() == 2202


@pytest.mark.parametrize("order", [(), matching.FUZZY_ORDER])
def test_blocks_give_each_pair_once_in_order(keyed, spark, monkeypatch, order):
    """Of several files and blocks; pairs are made after the last exchange, so none is shuffled."""
    rows, frame = keyed
    monkeypatch.setattr(matching, "_keyed", lambda records: records)
    monkeypatch.setattr(matching, "FIRST", 8)
    monkeypatch.setattr(matching, "SECOND", 32)
    monkeypatch.setattr(matching, "COPIES", matching.COPIES.replace("1024", "4"))
    frame = frame.withColumn("file", F.expr("concat('f', record_no % 3)"))
    found = matching.dedupe_candidates(frame, 0.8, order=order)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") and plan.index("posexplode(record_nos_b") < plan.index("Exchange")
    got = [tuple(r) for r in found.collect()]
    want = []
    for x in rows:
        for y in rows:
            a, b = (f"f{x[1] % 3}", x[1]), (f"f{y[1] % 3}", y[1])
            sim, same = jaro_winkler(x[3], y[3]), x[5] is not None and x[5] == y[5]
            if a < b and (same or (sim is not None and sim >= 0.8)):
                want.append((*a, *b, x[2], y[2], sim, same))
    want.sort(key=lambda r: ((not r[7], 1 if r[6] is None else -r[6]) if order else ()) + r[:4])
    assert got == want


@pytest.mark.parametrize("name", ["sql_dedupe_candidates", "sql_task_dedupe_fuzzy"])
def test_table_functions_shuffle_no_pairs(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("posexplode(record_nos_b") and plan.index("posexplode(record_nos_b") < plan.index("Exchange")
