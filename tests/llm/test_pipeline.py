import random
import re

import corpus_pipeline as C
from test_decontaminate import brute_tiles
from test_native_scans import brute_pii
from test_neardup import edited, near_groups

from stackwise.llm import language, pii

PARTS = {"aa": "the of and ing tion er st ou", "bb": "der die und keit ung sch ver be"}


def words(rng, lang, n):
    return ["".join(rng.choice(PARTS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(23)
    items = [(k, " ".join(words(rng, "aa", rng.randint(12, 30)))) for k in range(6)]
    rows = [(0, None, "aa", "s", 0), (1, "", None, "s", 0), (2, "12 34 !!", "aa", "s", 8)]
    for i in range(3, 300):
        lang = rng.choice(["aa", "bb"])
        own = words(rng, lang, rng.randint(20, 200))
        if i % 10 == 0:
            at = rng.randrange(len(own))
            own[at:at] = rng.choice(items)[1].split()
        if i % 7 == 0:
            own.insert(3, f"u{i}@mail{i}.org")
        text = " ".join(own)
        if i % 6 == 0 and i > 20:
            text = rng.choice(rows[5:])[1]
            if i % 12 == 0:
                text = edited(rng, text, 1)
        rows.append((i, text, lang if i % 4 else None, f"s{i % 3}" if i % 11 else None, len(text)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {0: {r[0]: r for r in rows}}
    stage = docs
    for k, (_, f) in enumerate(C.STAGES[:4], 1):
        stage = spark.createDataFrame(f(spark, stage, str(tmp_path)).collect(), schema)
        assert stage.columns == docs.columns
        kept[k] = {r.doc_id: tuple(r) for r in stage.collect()}
        assert len(kept[k]) == stage.count()

    model = language.train(docs)
    labels, scores = language.predict(model, [r[1] or "" for r in rows])
    assert kept[1] == {r[0]: r for r, label, s in zip(rows, labels, scores, strict=True) if label != "und" and s >= C.MIN_LANGUAGE_SCORE}
    assert set(kept[0]) - set(kept[1]) == {0, 1, 2}

    ids = sorted(kept[1])
    groups = near_groups([(i, kept[1][i][1]) for i in ids])
    assert set(groups) <= set(kept[2]) and len(set(kept[2]) - set(groups)) <= 1 and len(kept[2]) < len(kept[1]) - 20
    assert all(r == kept[1][i] for i, r in kept[2].items())

    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    leaks = {i for i, r in kept[2].items() if any(sum(brute_tiles(tokens(t), tokens(r[1]), 5)) >= 0.8 * len(tokens(t)) for _, t in items)}
    assert kept[3] == {i: r for i, r in kept[2].items() if i not in leaks} and len(leaks) > 10

    assert set(kept[4]) == set(kept[3])
    for i, r in kept[4].items():
        spans = brute_pii(kept[3][i][1])
        assert not brute_pii(r[1]) and r[1].count("<EMAIL>") == len(spans) and r[4] == len(r[1]) and r[2:4] == kept[3][i][2:4]
        if not spans:
            assert r[1] == kept[3][i][1]
    assert any(pii.MARKS[0] in r[1] for r in kept[4].values())

    mixed = {r.doc_id: r for r in C.run(spark, str(tmp_path)).collect()}
    assert set(mixed) <= set(kept[4]) and all(mixed[i].text == kept[4][i][1] for i in mixed)
    by_source = {}
    for i, r in kept[4].items():
        own = by_source.setdefault(r[3], [0, 0])
        own[0] += len(r[1].split())
        own[1] += mixed[i].taken if i in mixed else 0
    total = sum(size for size, _ in by_source.values())
    assert abs(sum(taken for _, taken in by_source.values()) - 1.5 * total) <= len(by_source)
    assert all(taken <= 2 * size for size, taken in by_source.values())


def test_clashing_and_dotted_columns(spark, tmp_path):
    """Columns named as operators name theirs come through every stage; those of the mix are replaced."""
    rng = random.Random(31)
    rows = [(i, " ".join(words(rng, "aa", 30)) + f" u{i}@mail.org", "aa", "s", i, float(i), "b", "t", "k", i, True, "r", "u", "w") for i in range(40)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "base", "__text", "__key", "a.b", "key", "row", "c3", "size"]
    spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, "long string string string long double string string string long boolean string string string".split(), strict=True))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some item of the benchmark here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, str(tmp_path))
    assert got.columns == [*names[:-1], "size", "source_size", "target", "taken"]
    found = got.collect()
    assert len(found) > 20
    for r in found:
        own = dict(zip(names, rows[r.doc_id], strict=True))
        assert all(r[n] == own[n] for n in names if n not in ("text", "n_chars", "size")) and "<EMAIL>" in r.text


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_foreign_texts_are_rejected(spark):
    rng = random.Random(29)
    rows = [(i, " ".join(words(rng, lang, 30)), lang) for i in range(200) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(1000, "Съешь же ещё этих мягких французских булок", None), (1001, "qxz zzkw vvq xkcd wqz jjq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in C.identify_language(spark, docs, "").collect()} == set(range(200))
