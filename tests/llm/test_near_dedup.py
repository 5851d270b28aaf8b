"""The pipeline's near-dedup against brute force on shingle sets."""

import math
import random
import re

import numpy as np
import pytest

from tessera.llm import near_dedup, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        best[r] = min(best.get(r, (True, 0)), (d is None, d or 0))
    return sorted(best.values())


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(800)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one  two"), (905, "One three")]
    i = 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 300))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((i, rng.choice([" ", "\n"]).join(words)))
            i += 7
    rng.shuffle(rows)
    return [*rows, rows[5], (None, "only here but without any id at all"), (None, rows[9][1])]


@pytest.mark.parametrize("block", [1024, 6])
def test_one_of_each_group_stays(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    d = spark.createDataFrame([(i, t, "clash", 1, "k", "x") for i, t in rows], "doc_id long, text string, node string, fp int, _key string, _text string")
    kept = near_dedup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert {(r.node, r.fp, r._key, r._text) for r in kept.collect()} == {("clash", 1, "k", "x")}
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == brute_kept(rows)
    if block == 1024:
        assert near_dedup.drop_near_duplicates(d.limit(0)).count() == 0


def test_linked_lanes_and_distances():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps[1::2] = fps[::2] ^ rng.integers(0, 1 << 9, 75, dtype=np.uint64)
    p = simhash.planes(fps)
    a, d = simhash.linked(p, 1, 6, np.ones(149, dtype=bool))
    want = {i: (int(fps[i]) ^ int(fps[i + 1])).bit_count() for i in range(149)}
    assert dict(zip(a.tolist(), d.tolist(), strict=True)) == {i: x for i, x in want.items() if x <= 6}


def templated(pairs, singles=0, shared=9, seed=5):
    """Texts that share a template (similarity 0.7), in pairs of similarity 0.84."""
    rng = random.Random(seed)
    word = iter(rng.sample([f"u{i}" for i in range(100 * (pairs + singles))], 40 * (pairs + singles)))
    base = [f"t{i}" for i in range(88)]
    texts = []
    for _ in range(pairs):
        same = [next(word) for _ in range(shared)]
        texts += [[*base, *same, *(next(word) for _ in range(18 - shared))] for _ in range(2)]
    texts += [[*base, *(next(word) for _ in range(18))] for _ in range(singles)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_pairs_of_a_template_are_all_found(spark):
    rows = templated(200, 50)
    want = brute_kept(rows)
    assert len(want) == 250
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((False, r.doc_id) for r in near_dedup.drop_near_duplicates(d).collect())
    assert got == want


def test_pairs_in_two_parts_of_a_block_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rows = templated(150, 20, seed=6)
    want = brute_kept(rows)
    assert len(want) == 170
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((False, r.doc_id) for r in near_dedup.drop_near_duplicates(d).collect())
    assert got == want


def test_radius_loses_no_more_than_the_keys():
    """Pairs of similarity 0.8, from every split of few shingles: the binomial tail beyond RADIUS."""

    def differs(both, x, y):
        p = 0.0
        for c in range(both + 1):
            a = sum(math.comb(x, k) for k in range(x + 1) if 2 * (c + k) > both + x) / 2**x
            b = sum(math.comb(y, k) for k in range(y + 1) if 2 * (c + k) > both + y) / 2**y
            p += math.comb(both, c) / 2**both * (a * (1 - b) + (1 - a) * b)
        return p

    p = max(differs(n, x, y) for n in range(1, 60) for x in range(15) for y in range(x, 15) if n >= 0.8 * (n + x + y))
    beyond = sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(near_dedup.RADIUS + 1, 65))
    assert p == 0.1875 and beyond < 0.36**near_dedup.KEYS


@pytest.mark.parametrize("block", [6, 64, 1024])
def test_common_text_loses_no_pair(spark, monkeypatch, block):
    """Pairs over a common text of nearly the threshold: equal to brute force at any block size."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(21)
    base = [f"c{i}" for i in range(160)]
    rows = []
    for k in range(120):
        own = [f"p{k}x{i}" for i in range(36)]
        for j in range(2):
            words = [*base, *own]
            words[rng.randrange(165, 190)] = f"d{k}y{j}"
            rows.append((len(rows), " ".join(words)))
    assert len(brute_kept(rows)) == 120
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((False, r.doc_id) for r in near_dedup.drop_near_duplicates(d).collect()) == brute_kept(rows)


def test_similar_sets_share_a_rare_shingle():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, near_dedup.COUNTS)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        both = rng.integers(-(1 << 31), 1 << 31, n, dtype=np.int64).astype(np.int32)
        extra = [rng.integers(-(1 << 31), 1 << 31, int(rng.integers(0, n // 4 + 1)), dtype=np.int64).astype(np.int32) for _ in range(2)]
        a, b = (np.unique(np.concatenate([both, e])) for e in extra)
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        owner, values = near_dedup.rare_first(np.array([len(a), len(b)]), np.concatenate([a, b]), counts, 0.8)
        assert set(values[owner == 0]) & set(values[owner == 1])


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(40000))
    rows = [(1, long), (2, long + " end"), (3, " ".join(f"v{i}" for i in range(30000))), (4, None)]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
