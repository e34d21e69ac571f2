import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stackwise.llm import pii, queries, secrets, spans

rng = random.Random(17)


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def brute_pii(t):
    found = []
    for kind, name, pattern in ((0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), (1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), (2, "card", r"[0-9]([\x20-]?[0-9])+"), (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                found.append((m.start(), kind, m.end(), name))
    return sorted(found)


def brute_secrets(t):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)


def digest(found):
    return hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in found).encode()).hexdigest()


def noise(alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def card():
    while True:
        s = noise("0123456789", rng.choice([14, 16, 19]))
        if luhn(s):
            return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


PIII = [None, "", "a.b%c@x-y.com.z@q.org", "@a.b", "a@b", "a@b.c@d.e.f %g@h.i", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.256 007.0.00000255.1", "+1 (555) 010-9999.", "+12-3", "12345678901234567890", "é😀 a@b.cc 日本 1.1.1.1", "x" * 3000, "1-" * 3000 + "1", "+1" * 500, "a@" * 2000]
PIII += [noise("aé.@%+- 0123456789()\n", rng.randint(1, 150)) for _ in range(300)]
PIII += [" ".join(rng.choice([card(), "u%d@ex.org" % rng.randint(1, 9), "+49 (30) 12345-67%d" % rng.randint(0, 9), "10.0.%d.1" % rng.randint(0, 300), "wörd", "the"]) for _ in range(rng.randint(1, 30))) for _ in range(100)]
SECRETS = [None, "", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "PassWord:short", "paſſword=12345678", "apikey='abcdefgh' api_key==x", "AKIA" + "A" * 12, "AKIA" + "A" * 11, "xAKIAAKIAAKIA1234", "f" * 31, "g" + "f" * 32 + "é", "token" * 3000, "token" + " " * 3000, "0" * 5000]
SECRETS += [noise(["token", "secret", "=", ":", " ", '"', "a", "AKIA", "Z", "9", "f0", "é", "\n"], rng.randint(1, 120)) for _ in range(400)]


@pytest.mark.parametrize("brute, op, texts, added", [(brute_pii, "op2_pii", PIII, {"term", "removed_term", "name_term", "acronym_term"}), (brute_secrets, "op3_secret_scans", SECRETS, {"live"})])
def test_base_spans_against_brute_force(spark, tmp_path, brute, op, texts, added):
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, "x", "y") for i, t in enumerate(texts)] + [(None, texts[-1], None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, base string, __key string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[op](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    kinds = {"op2_pii": ["email", "ip", "card", "phone"], "op3_secret_scans": ["assign", "access", "hex"]}[op]
    for r in got:
        want = brute(texts[r.doc_id if r.doc_id is not None else -1] or "")
        assert r.base_sha256 == digest(want), (r, want)
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[3] == k for x in want) for k in kinds]
        listed = [x.rsplit(":", 2) for x in r.spans.split(",")] if r.spans else []
        assert Counter((int(s), int(e), k) for k, s, e in listed if k not in added) == Counter((s, e, n) for s, _, e, n in want)
        assert [int(x[1]) for x in listed] == sorted(int(x[1]) for x in listed)


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_disclosing_terms(spark, monkeypatch, limit):
    monkeypatch.setattr(spans, "BROADCAST_CHARS", limit)
    filler = ["the cat sat on the mat with the hat", "and other words of the day"]
    texts = [f"{filler[i % 2]} number {i}" for i in range(40)]
    texts += [f"please write to Wolfgang at w.z@example.org about the {'abcdefghij'[i]}{'abcdefghij'[i]}{'klmnopqrst'[i]}" for i in range(8)]
    texts += ["Wolfgang is about", "to Wolfgang at", None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, terms int").repartition(3)
    got = {r.doc_id: r for r in pii.sanitise(docs, disclose=0.6).collect()}

    n, entity = len(texts), 8
    near = Counter(w for t in texts[40:48] for w in set(re.findall(r"[^\W\d_]{3,}", t.lower().replace("w.z@example.org", ""))))
    freq = Counter(w for t in texts if t for w in set(re.findall(r"[^\W\d_]{3,}", t.lower())))
    ratio = {w: math.log2(c * n / (entity * freq[w])) / math.log2(n / entity) for w, c in near.items() if c >= 3}
    want = {w for w, x in ratio.items() if x >= 0.6}
    assert {x["value"] for i in range(40, 48) for x in got[i].terms} == want == {"please", "write", "wolfgang", "about"}
    r = got[40]
    assert [(x.kind, texts[40][x.start : x.stop]) for x in r.terms] == [(5, "please"), (5, "write"), (6, "Wolfgang"), (4, "about")]
    assert r.sanitised == "  to <NAME> at <EMAIL> <TERM> the aak"
    assert got[48].sanitised == "Wolfgang is about" and got[50].sanitised is None and got[51].sanitised == ""


def test_entities_of_one_document_disclose(spark):
    texts = [f"the cat sat on the mat with the hat number {i}" for i in range(60)] + ["the letter of Wolfgang at w.z@example.org"]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(x.kind, x.value) for x in got[60].terms] == [(5, "letter"), (5, "wolfgang")]
    assert got[60].sanitised == "the  of  at <EMAIL>" and not any(got[i].terms for i in range(60))


def test_disclosing_terms_in_the_whole_text(spark):
    """Terms far from the entity are rated, and every occurrence of a disclosing one is marked."""
    filler = "the cat sat on the mat with the hat and the dog"
    texts = [f"{filler} number {i}" for i in range(60)]
    texts += [f"{'é' * i} Wolfgang at w.z@example.org {filler} {filler} {filler} Amadeus {filler} wolfgang" for i in range(3)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in (60, 61, 62):
        assert [texts[i][x.start : x.stop] for x in got[i].terms if x.value in ("wolfgang", "amadeus")] == ["Wolfgang", "Amadeus", "wolfgang"]
        assert "amadeus" not in got[i].sanitised.lower() and "wolfgang" not in got[i].sanitised.lower() and filler in got[i].sanitised
    assert not any(got[i].terms for i in range(60))


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_ownership(spark, monkeypatch, limit):
    monkeypatch.setattr(spans, "BROADCAST_CHARS", limit)
    shared, own, loose = "token=EXAMPLEKEY123", "secret: hunter2hunter2", "see aB3dE5gH7jK9mN1pQ3sT5vW7 there"
    rows = [(i, f"s{i}", f"x {shared}") for i in range(4)] + [(i, "s9", f"{own} {shared}") for i in range(10, 13)] + [(20, None, loose), (None, None, loose), (21, "s1", "nothing"), (22, None, None)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)).collect()}
    assert [len(got[i].live) for i in (0, 10, 20, None, 21, 22)] == [0, 1, 1, 1, 0, 0]
    assert got[10].n_example == 1 and own[got[10].live[0].start : got[10].live[0].stop] == "hunter2hunter2"
    assert got[20].redacted == "see <SECRET> there" and got[22].redacted is None and got[0].redacted == "x <SECRET>"


def test_examples_by_repositories(spark):
    """What ten repositories of one owner hold is copied; what nine hold looks live."""
    rows = [(i, "s1", "token=EXAMPLEKEY123") for i in range(10)] + [(i, "s1", "token=EXAMPLEKEY456") for i in range(20, 29)] + [(28, "s1", "token=EXAMPLEKEY456")]
    got = {r.doc_id: (len(r.live), r.n_example) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {got[i] for i in range(10)} == {(0, 1)} and {got[i] for i in range(20, 29)} == {(1, 0)}


def test_against_sql(spark, tmp_path):
    """Spans of disclosing terms and live credentials against DuckDB, on a small corpus."""
    duckdb = pytest.importorskip("duckdb")
    names, words = ["Anna Berg", "ÖMER Ünal", "Zoë"], "der die wer Wald see Fluß MARC and ou naïve".split()
    rows = []
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(12)
            text.insert(rng.randrange(len(text) + 1), f"{names[k % 3]} u{k}@ex{k}.org" if k % 2 else f"+49 30 1234567{k}abc {names[k % 3]}")
        if rng.random() < 0.3:
            text.insert(0, rng.choice(['token="aB3dE5gH7jK9mN1pQ3sT5vW7"', "aB3dE5gH7jK9mN1pQ3sT5vW7", f"secret: {noise('abc123', 9)}", "0123456789abcdef" * 3]))
        rows.append((i if i % 13 else None, " ".join(text) if i % 17 else None, f"s{i % 4}" if i % 5 else None))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for op in ("op2_pii", "op3_secret_scans"):
        want = base.execute(queries.ORACLE_SQL[op])
        columns = [d[0] for d in want.description]
        got = queries.QUERIES[op](spark, str(tmp_path)).select(*columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
        assert any("term:" in r.spans or "live:" in r.spans for r in got)


def test_no_python_in_the_plans(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cc", "s"), (2, "b token=12345678", "t")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for op in ("op2_pii", "op3_secret_scans", "op9_mix_sources"):
        plan = queries.QUERIES[op](spark, str(tmp_path))._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pii.sanitise(empty).collect() == [] and secrets.scan(empty).collect() == []


def test_many_matches_in_one_text(spark):
    text = "a@b.cc " * 3000
    got = spark.createDataFrame([(text,)], "text string").select(F.size(pii.base_spans(F.col("text")))).first()[0]
    assert got == 3000
