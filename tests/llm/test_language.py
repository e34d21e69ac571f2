import random
import re

import numpy as np
import pytest

from stackwise.llm import language as L

SEEDS = {"aa": "the of and ing tion er", "bb": "der die und keit ung sch", "cc": "être que é eaux ouan ch"}


def text(rng, lang, n):
    parts = SEEDS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    found = []
    for i in range(900):
        lang = rng.choice(list(SEEDS))
        found.append((i, text(rng, lang, rng.choice([3, 20, 200])), lang if i % 9 else None))
    return found + [(2000, None, "aa"), (2001, "", "aa"), (2002, "123 .,!", "bb"), (2003, "ALL CAPS THE OF", None), (None, text(rng, "bb", 50), "bb"), (5, found[5][1], found[5][2])]


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(4)
    model = L.train(docs)
    got = L.identify(docs.withColumn("held_out", L.held_out()), model).collect()
    assert len(got) == len(rows)
    tested = [r for r in got if r.held_out and r.lang and r.doc_id < 2000]
    assert len(tested) > 100 and sum(r.lang_pred == r.lang for r in tested) > 0.97 * len(tested)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (2000, 2001, 2002)) and by[2003].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    again = L.identify(docs.withColumn("held_out", L.held_out()).repartition(2), L.train(docs)).collect()
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 5)) for r in again) == sorted((str(r.doc_id), r.lang_pred, round(r.score, 5)) for r in got)


def test_held_out_rows_are_not_learned(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", L.held_out())
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(F.col("held_out"), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in L.train(other).labels


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert L.train(docs) is None and L.identify(docs, None).first().lang_pred == "und"
    assert L.identify(docs.limit(0), None).collect() == []


def plain_grams(t):
    t = re.sub(r"[\W\d_]+", " ", t.lower())
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def plain_predictions(sample, labels, marks, texts):
    """Nyström features and ridge regression straight from their definitions, on sets of n-grams."""
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0
    own, new = [plain_grams(t) for t in sample], [plain_grams(t) for t in texts]
    k_mm = np.array([[kernel(own[i], own[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = lambda rows: np.hstack([np.array([[kernel(r, own[j]) for j in marks] for r in rows]) @ root, np.ones((len(rows), 1))])
    x, names = features(own), sorted(set(labels))
    y = np.array([[1.0 if label == n else -1.0 for n in names] for label in labels])
    ridge = L.RIDGE * len(sample) * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    found = features(new) @ np.linalg.solve(x.T @ x + ridge, x.T @ y)
    return names, found


def test_predictions_against_a_plain_nystroem_kernel(monkeypatch):
    monkeypatch.setattr(L, "LANDMARKS", 24)
    monkeypatch.setattr(L, "CELLS", 5000)  # many small matrices
    rng = random.Random(3)
    labels = [x for x in SEEDS for _ in range(30)]
    sample = [text(rng, x, rng.choice([5, 30])) for x in labels]
    model = L.fit(sample, labels)
    order = [i for k in range(30) for i in (k, 30 + k, 60 + k)]
    texts = sample[::7] + [text(rng, x, n) for x in SEEDS for n in (1, 4, 60)] + [text(rng, "aa", 9) + " " + text(rng, "cc", 9), "Ünknown Wörds 12 日本語", "x", text(rng, "bb", 20_000)]
    names, values = plain_predictions(sample, labels, sorted(order[:24]), texts)
    found, scores = L.predict(model, texts)
    assert found == [names[k] for k in values.argmax(axis=1)]
    assert np.abs(scores - np.clip((values.max(axis=1) + 1) / 2, 0, 1)).max() < 1e-4


def test_tied_labels_and_tables():
    model = L.fit(["same words here"] * 4, ["b", "a", "b", "a"])
    assert L.predict(model, ["same words here", "words"])[0] == ["a", "a"]
    codes = np.unique(np.random.default_rng(2).integers(1, 1 << 40, 5000).astype(np.uint64))
    table = L.Grams(codes[::2])
    found = table.find(codes)
    assert (found[::2] == np.arange(len(codes[::2]))).all() and (found[1::2] == table.n).all()


def test_labels_with_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_CHARS", 500)
    seen = []
    monkeypatch.setattr(L, "fit", lambda texts, labels: seen.extend(zip(labels, texts, strict=True)))
    rng = random.Random(6)
    rows = [(i, text(rng, "aa", 400), "aa") for i in range(20)] + [(i, text(rng, "bb", 20), "bb") for i in range(20, 60)] + [(99, text(rng, "bb", 400), "bb")]
    L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {label for label, _ in seen} == {"aa", "bb"} and all(len(t) <= 500 for _, t in seen)
    assert all(len(t) == 500 and any(t in r[1] for r in rows) for label, t in seen if label == "aa")


def test_unseen_languages_are_not_covered():
    """Scores of k labels are 1/k or more whatever the text is; coverage is not."""
    rng = random.Random(4)
    sample = [text(rng, x, 20) for x in SEEDS for _ in range(80)]
    model = L.fit(sample, [x for x in SEEDS for _ in range(80)])
    foreign = ["Съешь же ещё этих мягких булок", "日本語の文章です", "qxz zzkw vvq xkcd wqz jjq pqzx"]
    assert (L.predict(model, foreign)[1] >= 1 / len(SEEDS) - 1e-3).all()
    assert (L.coverage(model, foreign) < model.floor).all()
    assert (L.coverage(model, [text(rng, x, 20) for x in SEEDS for _ in range(50)]) >= model.floor).all()
