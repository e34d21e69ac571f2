import hashlib
import random
from collections import Counter

from pyspark.sql import types as T

from stackwise.llm.substrings import COVER, PERIOD, remove_repeats

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])


def brute(texts, width=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    found = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        found.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return found


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4))) if rng.random() < 0.97 else "x" * rng.randint(9, 700)
    passage = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 120, 35)]
    texts = [None, "", "  \n", "one", " ".join(passage[1])]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += [word() for _ in range(rng.randint(0, 60))] + (rng.choice(passage) if rng.random() < 0.5 else [])
        texts.append(rng.choice([" ", "\n", "\t \r"]).join(parts))
    texts += texts[20:40] + [" ".join(["same"] * 80), " ".join(["lone", "pair"] * 17 + ["end"]), "\x1cno space " * 40, " ".join(word() for _ in range(30_000))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, texts[7], "clash"), (None, texts[9], None)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = Counter((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows]), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert sum(r.n_removed for r in got) > 5000


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_digest(spark, tmp_path):
    from stackwise.llm.queries import QUERIES

    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op4_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got[1].kept_sha256 == hashlib.sha256(b"a b").hexdigest() and got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[1].n_words, got[1].n_removed, got[2].n_words) == (2, 0, 0)


def test_cleanup(spark):
    from stackwise.llm.common import bucketed, cleanup, materialise

    table, plain = bucketed(spark.range(9), "id"), materialise(spark.range(3))
    assert table.count() == 9 and plain.count() == 3
    cleanup(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stackwise_")]
