import hashlib
import random

import numpy as np
import pytest

from stackwise.llm import phrases as P


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeilnorst é") for _ in range(rng.randint(2, 9))) for _ in range(n))


def mixed(x):
    mask = (1 << 64) - 1
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & mask
    return x ^ (x >> 32)


def plain_bins(text):
    """The fingerprint's bins straight from the definition, one symbol at a time: parsing by
    deterministic coin tossing, names of phrases, min-hash of the names of two levels."""
    mask = (1 << 64) - 1

    def collapsed(symbols):
        found = []
        for x in symbols:
            if found and found[-1][0] == x:
                found[-1][1] += 1
            else:
                found.append([x, 1])
        return found

    def toss(left, right):
        low = ((left ^ right) & -(left ^ right)).bit_length() - 1
        return 2 * low + (right >> low & 1)

    s = [x | min(n, 2047) << 21 for x, n in collapsed(map(ord, text))]
    bins = [0xFFFF] * P.BINS
    for level in range(1, max(P.LEVELS) + 1):
        if not s:
            break
        label = [s[0] & 1] + [toss(a, b) for a, b in zip(s, s[1:], strict=False)]
        for _ in range(3):
            label = [label[0] & 1] + [toss(a, b) if a != b else b & 1 for a, b in zip(label, label[1:], strict=False)]
        opens = [0] + [k for k in range(1, len(s) - 1) if label[k - 1] < label[k] > label[k + 1]]
        names = []
        for a, b in zip(opens, [*opens[1:], len(s)], strict=True):
            total = b - a
            for k in range(a, b):
                power = pow(0x9E3779B97F4A7C15, (k - a & 63) + 1, 1 << 64)
                total += (mixed(s[k]) if level == 1 else s[k]) * power
            names.append(mixed(total & mask))
        if level in P.LEVELS:
            for x in names:
                bins[x % P.BINS] = min(bins[x % P.BINS], min(x >> 48, 0xFFFE))
        s = [mixed((x + n) & mask) if n > 1 else x for x, n in collapsed(names)]
    return bins


def test_parsing_against_a_plain_version():
    rng = random.Random(14)
    texts = ["", "a", "ab", "aaa", "aba" * 30, "日本語😀" * 20, "x" * 3000, words(rng, 3000)] + [words(rng, rng.randint(1, 120)) for _ in range(60)]
    rows = P.fingerprint_texts(texts)
    plain = [plain_bins(t) for t in texts]
    assert rows.tolist() == plain
    for k in range(len(texts) - 1):
        filled = [(x, y) for x, y in zip(plain[k], plain[k + 1], strict=True) if (x, y) != (0xFFFF, 0xFFFF)]
        want = sum(x == y for x, y in filled) / len(filled) if filled else 1.0
        assert abs(P.likeness(rows[k : k + 1], rows[k + 1 : k + 2])[0] - want) < 1e-12


@pytest.mark.parametrize("ids", ["plain", "ties", "nulls"])
def test_edits_and_digests(spark, ids):
    rng = random.Random(4)
    texts = [None, "", "a", "ab", "日本語テキスト😀" * 9] + [words(rng, rng.randint(1, 200)) for _ in range(120)]
    key = {"plain": lambda i: i * 7, "ties": lambda i: i // 3 if i > 3 else i * 1000, "nulls": lambda i: None}[ids]
    rows = [(key(i), t, "x") for i, t in enumerate(texts)]
    got = P.spliced(spark.createDataFrame(rows, "doc_id long, text string, range string").repartition(5)).collect()
    assert len(got) == len(rows)
    # Descending ids, nulls last; equal ones by hash of text, then text.
    hashes = spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").selectExpr("t", "xxhash64(t) AS h").collect()
    h = {r.t: r.h for r in hashes}
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following, cut = order[(k + 1) % len(order)][1], len(t) // 3
        new = t[: len(t) - cut] + following[:cut]
        a, b, c = (np.array([plain_bins(x)], dtype=np.uint16) for x in (t, new, following))
        near = [round(float(P.likeness(a, x)[0]), 9) for x in (b, c)]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a[0].astype(">u2").tobytes().hex(), b[0].astype(">u2").tobytes().hex(), *near))
    found = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))
    if ids != "plain":
        return
    long = [r for r in got if r.n_chars > 600]
    assert 0.35 < np.mean([r.near_edited for r in long]) < 0.7 and np.mean([r.near_next for r in long]) < 0.1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_single_row_follows_itself(spark):
    r = P.spliced(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


def test_empty(spark):
    assert P.spliced(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = P.fingerprint(spark.createDataFrame([(1, None, 2)], "doc_id long, text string, fingerprint int")).first()
    assert got.fingerprint == "ffff" * 64


def test_interior_is_cut_alike_at_any_offset():
    rng = random.Random(8)
    core = words(rng, 400)
    texts = [words(rng, k) + core[k:] for k in range(0, 40, 3)] + [core]
    rows = P.fingerprint_texts(texts)
    alone = np.vstack([P.fingerprint_texts([t]) for t in texts])
    assert (rows == alone).all()
    assert P.likeness(rows, np.vstack([rows[-1]] * len(rows))).min() > 0.7


def test_runs_and_periods_terminate():
    texts = ["a" * 10_000, "ab" * 5000, "abc" * 3000, "\n" * 17, "aab" * 999]
    rows = P.fingerprint_texts(texts)
    assert len({r.tobytes() for r in rows}) == len(texts)
