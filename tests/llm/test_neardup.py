import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from stackwise.llm import neardup

SCHEMA = "doc_id long, text string, fingerprint string, n_links int, `extra col` string"


def brute_print(text):
    words = bytes(text or "", "utf8").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def texts(n=160):
    rng = random.Random(5)
    word = lambda: rng.choice(["Aé", "bEta", "gam", "δ", "x", "zeta9", "Σ"]) + str(rng.randint(0, 50))
    found = [None, "", " \n", "a", "A  b", "a b", "a B c"]
    for _ in range(n):
        if rng.random() < 0.5 and len(found) > 10:
            words = (rng.choice(found) or "q").split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = word()
            found.append(rng.choice([" ", "\n"]).join(words))
        else:
            found.append(" ".join(word() for _ in range(rng.choice([2, 3, 40, 300, 1000]))))
    return found


def test_fingerprints_and_components(spark):
    rows = [(i * 3 + 1, t, "clash", 5, None) for i, t in enumerate(texts())]
    rows += [rows[9], (None, rows[12][1], None, None, "z"), (None, "alone in the world of nulls", None, None, None)]
    got = sorted(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), key=str)
    prints = [brute_print(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], brute_components([r[0] for r in rows], prints), strict=True), key=str)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == want
    assert len({w[2] for w in want}) < len(want) - 20
    assert got[0].asDict().keys() >= {"extra col", "n_links"} and got[0].n_links is not None


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("spread, cell", [(64, 512), (14, 512), (14, 40)])
def test_search_finds_every_close_pair_in_large_cells(monkeypatch, spread, cell):
    monkeypatch.setattr(neardup, "CELL", cell)
    rng = np.random.default_rng(1)
    f = np.unique(rng.integers(0, 1 << min(spread, 63), 3000, dtype=np.uint64))
    close = f[:600] ^ (np.uint64(1) << rng.integers(0, 63, 600).astype(np.uint64))
    f = np.unique(np.concatenate([f, close]))
    want = {(int(min(f[i], x)), int(max(f[i], x))) for i in range(len(f)) for x in f[i + 1 :][np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3]}
    got = {(int(min(f[x], f[y])), int(max(f[x], f[y]))) for a, b in neardup._split(f, neardup._ALL) for x, y in zip(a, b, strict=True)}
    assert got == want


def test_links_of_dealt_fingerprints(spark):
    """Trees out of the cells have the components of all pairs; a dense ball leaves as a tree."""
    rng = np.random.default_rng(7)
    f = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    close = f[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    ball = f[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    f = np.unique(np.concatenate([f, close, ball]))
    rows = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fingerprint long").repartition(3)
    edges = neardup.links(rows).collect()
    assert all(r.b < r.a for r in edges) and len(edges) < 4 * len(f)
    found = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    values = [int(x) for x in f.view(np.int64)]
    want = brute_components(values, [int(x) for x in f])
    assert [found.get(v, v) for v in values] == want


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(77, 76), (-5, 76)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(1, 50)) and got[76] == got[77] == -5


def test_keep_one(spark):
    rows = [(3, "a b c d e f"), (2, "A  b c d e f"), (9, "other words stand here alone"), (None, None), (None, "")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1 for r in got)) == [-1, 2, 9]
    assert neardup.keep_one(spark.createDataFrame([], "doc_id long, text string, `a.b` int, row string")).columns == ["doc_id", "text", "a.b", "row"]


def shingles(text):
    words = bytes(text or "", "utf8").lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(rows, similarity=0.8):
    """The smallest id of each row's component of pairs by Jaccard, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [rows[find(i)][0] for i in range(len(rows))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("cell, partners", [(2048, 4), (60, 1)])
def test_keep_one_of_similar_texts(spark, monkeypatch, cell, partners):
    """Against all pairs: nothing is dropped that has no group, and nearly all groups are found.
    One group holds a third of the rows; small bounds force cells in pieces and several rounds."""
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "PARTNERS", partners)
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = ["", None, "one", "one two", fresh(8000)]
    texts += [fresh(rng.choice([30, 150, 400])) for _ in range(150)]
    base = fresh(200)
    texts += [edited(rng, base, rng.randint(0, 3)) for _ in range(150)]
    for _ in range(120):
        own = rng.choice(texts[5:155])
        texts.append(edited(rng, own, rng.randint(1, max(1, len(own.split()) // 60))))
    texts += [texts[5].upper(), texts[6].replace(" ", "\n"), edited(rng, texts[4], 100)]
    rows = list(enumerate(texts))
    want = near_groups(rows)
    got = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    kept = set(want)
    gone = set(range(len(rows))) - kept
    assert kept <= got and len(gone) > 200
    assert len(gone - got) >= 0.95 * len(gone)


def candidates(f, radius, partners, most):
    """Pairs and nodes of cells cut short, of fingerprints dealt out in one task; their numbers of rows."""
    n = np.arange(len(f))
    words = [pa.array(f[:, k].view(np.int64)) for k in range(neardup.WORDS)]
    held = pa.RecordBatch.from_arrays([pa.array(n), pa.array(n), *words], names=["node", "root", *(f"w{k}" for k in range(neardup.WORDS))])
    found = [r for out in neardup._candidates(radius, partners, most)(neardup._deal_blocks(iter([held]))) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    return {r for r in found if r[1] is not None}, {r[0] for r in found if r[1] is None}, len(found)


def flipped(rng, f, bits):
    g = f.copy()
    for b in rng.choice(512, bits, replace=False):
        g[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return g


@pytest.mark.parametrize("most", [2048, 50])
def test_large_cells_are_searched_whole(monkeypatch, most):
    """All pairs within the radius that share a block are candidates, once, however small ``CELL`` is:
    one cell holds all fingerprints, which hardly share a second block."""
    monkeypatch.setattr(neardup, "TILE", 1000)
    rng = np.random.default_rng(3)
    f = rng.integers(0, 1 << 63, (300, neardup.WORDS), dtype=np.uint64)
    for i in range(150, 300):
        f[i] = flipped(rng, f[i - 150], 80)
    f[:, 0] &= ~np.uint64((1 << 14) - 1)
    apart = np.bitwise_count(f[:, None] ^ f[None]).astype(int).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(apart <= 90), strict=True) if i < j}
    pairs, cut, n = candidates(f, 90, None, most)
    assert pairs == want and len(want) > 140 and not cut and n == len(pairs)


@pytest.mark.parametrize("most", [2048, 50])
def test_copies_of_one_text_are_first_compared_with_it(most):
    """Copies farther from each other than from their text: each has the text among its first partners,
    all are told to be cut short, and first candidates grow with the copies only."""
    rng = np.random.default_rng(4)
    text = rng.integers(0, 1 << 63, neardup.WORDS, dtype=np.uint64)
    sizes = []
    for n in (400, 800):
        f = np.array([*(flipped(rng, text, 46) for _ in range(n)), text])
        pairs, cut, rows = candidates(f, 90, 4, most)
        assert len({a for a, b in pairs if b == n}) > 0.95 * n and len(cut) > 0.95 * n
        sizes.append(len(pairs))
    assert sizes[1] < 2.3 * sizes[0]
