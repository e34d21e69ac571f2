import random
import re

from stackwise.llm import decontaminate as D


def brute_tiles(item, doc, least):
    """Greedy string tiling straight from its definition."""
    used_i, used_d, tiles = set(), set(), []
    while True:
        best, length = [], least
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and i + k not in used_i and j + k not in used_d:
                    k += 1
                if k > length:
                    best, length = [(i, j)], k
                elif k == length:
                    best.append((i, j))
        if not best:
            return tiles
        for i, j in best:
            if used_i.isdisjoint(range(i, i + length)) and used_d.isdisjoint(range(j, j + length)):
                used_i.update(range(i, i + length))
                used_d.update(range(j, j + length))
                tiles.append(length)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: rng.choice(["Ab", "cé", "d", "e", "f1", "G"]) + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "short one"), (3, "a repeated id of seven tokens here")]
    docs = [(0, None), (1, ""), (2, "... !!"), (None, items[4][1].upper())]
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = (rng.choice(items)[1] or "x").split()
            cut = sorted(rng.sample(range(len(words) + 1), min(len(words), 2)))
            pieces = [words[: cut[0]], words[cut[0] : cut[-1]], words[cut[-1] :]]
            rng.shuffle(pieces)
            parts += [word() for _ in range(rng.randint(0, 9))] + [w for p in pieces for w in p]
        docs.append((d + 10, ", ".join(parts)))
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = []
    for d, t in docs:
        for i, s in items:
            tiles = brute_tiles(tokens(s), tokens(t), D.MIN_TILE)
            if tiles and sum(tiles) >= D.THRESHOLD * len(tokens(s)):
                want.append((d, i, sum(tiles), len(tiles)))
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, matches string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (2_000_000, 150):  # one block, several blocks
        monkeypatch.setattr(D, "BLOCK_TOKENS", most)
        got = D.leaks(frame, bench).collect()
        assert sorted(((r.doc_id, r.item_id, r.n_matched, r.n_tiles) for r in got), key=str) == sorted(want, key=str)
    assert any(w[3] > 1 for w in want) and len(want) > 30
    clean = D.decontaminate(frame, bench)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_common_seeds_are_taken_in_parts(monkeypatch):
    """A line that all items and texts have: hits come in parts of the items, none is lost."""
    line = "the same line stands here"
    texts = [f"{line} own{k} a{k} b{k} c{k} d{k}" for k in range(64)]
    block = D._Block.of(list(range(64)), texts, 5)
    words = D._tokens(D.pa.array([f"{line} {line}"] * 20))
    h = D.rolling(words.hashes(1), 5)
    pairs = lambda: sorted((own.items[own.item[s]], int(own.place[s]), int(a)) for own, at, seed in block.hits(h) for a, s in zip(at, seed, strict=True))
    whole = pairs()
    assert len(list(block.hits(h))) == 1 and len(whole) >= 64 * 40
    monkeypatch.setattr(D, "MOST_HITS", 200)
    assert len(list(block.hits(h))) >= 16 and pairs() == whole


def test_long_texts_and_several_groups_of_blocks(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(20))) for i in range(12)]
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(30_000))
    rows = [(1, text), (2, f"{text} {items[7][1]} {text}"), (2, f"{text} {items[7][1]} {text}"), (3, items[11][1])]
    monkeypatch.setattr(D, "BLOCK_TOKENS", 30)  # a block for each item or so, more than a worker holds
    got = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_matched) for r in got) == [(2, 7, 20), (2, 7, 20), (3, 11, 20)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, bench).count() == 0 and D.decontaminate(docs, bench).count() == 1
    assert D.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
