import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stackwise.llm.tokens import WordCounter, token_counts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(2)
    alphabet = "aAbeEtTnoOrsS  \n\t'.,!<|>0189ÉéßΣσİſḰñ日本中​   \x1c\x85😀½٣Ⅷ_-ǅﬁ"
    found = [None, "", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext", "ΑΣ ΑΣΑ", "it's WE'RE 'll", "a" * 5000, "é" * 3000, "x y" * 3000]
    found += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    words = ["the", "Internationalization", "straße", "reading", "of", "ththnd", "ouonré"]
    return found + [" ".join(rng.choice(words) + rng.choice(words) for _ in range(60)) for _ in range(200)]


def test_against_the_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(5, "same", 1)] * 2
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), VOCABULARY, limit=50).collect()
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows}
    wrong = [(rows[r.doc_id][1], r.n_tokens, want[r.doc_id]) for r in got if r.doc_id != 5 and r.n_tokens != want[r.doc_id]]
    assert not wrong, (len(wrong), wrong[:5])
    assert len(got) == len(rows) and all(r.over_limit == (r.n_tokens > 50) for r in got)
    assert {r.n_bytes for r in got if r.doc_id == 2} == {1}


def test_table_forgets_when_full(monkeypatch):
    import json

    monkeypatch.setattr("stackwise.llm.tokens.CACHE_WORDS", 3)
    counter = WordCounter(json.load(open(VOCABULARY)))
    assert [counter.count("one two three four five one") for _ in range(2)] == [6, 6] and len(counter) <= 3


def test_empty_and_unsupported(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []
    with pytest.raises((ValueError, KeyError)):
        WordCounter({"model": {"type": "WordPiece"}})
