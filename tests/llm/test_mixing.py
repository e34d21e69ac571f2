import random

import duckdb
import pytest

from stackwise.llm import mixing, queries, spans


def rows(kind):
    rng = random.Random(kind)
    word = lambda: rng.choice(["a", "bé", "c-d"])
    text = lambda n: rng.choice([" ", "\n\t", " \r"]).join(word() for _ in range(n))
    sources = {"even": ["s1", "s2", "s10", None], "capped": ["big"] * 30 + ["tiny", "Zed", "éclair"], "one": ["only"]}[kind]
    found = [(i, text(rng.choice([0, 1, 5, 50, 400])), rng.choice(sources)) for i in range(400)]
    return found + [(900, None, "s1"), (901, "", None), (None, text(9), "s2"), (None, text(30), "s2"), found[3], found[3], (5, "   ", "blank")]


@pytest.mark.parametrize("limit", [8_000_000, 0])
@pytest.mark.parametrize("kind", ["even", "capped", "one"])
def test_against_sql(spark, tmp_path, monkeypatch, kind, limit):
    monkeypatch.setattr(spans, "BROADCAST_CHARS", limit)
    data = rows(kind)
    spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, source string, size string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op9_mix_sources"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_mix_sources"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    sources = {}
    for r in mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect():
        assert 0 <= r.taken <= 2 * r.size
        own = sources.setdefault(r.source, [0, r.target, r.source_size])
        own[0] += r.taken
    for taken, target, size in sources.values():
        assert abs(taken - target) < 4 and target <= 2 * size
    total = sum(x[2] for x in sources.values())
    assert abs(sum(x[1] for x in sources.values()) - 1.5 * total) < 1e-6 * total


def test_a_larger_share_takes_a_superset(spark):
    frame = spark.createDataFrame(rows("even")[:400], "doc_id long, text string, source string")
    low, high = ({r.doc_id: r.taken for r in mixing.mix(frame, share=s).collect()} for s in (0.3, 0.6))
    assert all(high[d] >= n for d, n in low.items()) and sum(high.values()) > sum(low.values())


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
