"""Substring dedup and SimHash near-dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import common, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, pos int, h long"


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    seps = [" ", "  ", "\n", "\t ", " \x0b"]
    shared = [[rng.choice(vocab) for _ in range(k)] for k in (49, 50, 51, 90, 200)]
    texts = [None, "", " \n", "one"]
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = rng.choice(shared)
        texts.append("".join(w + rng.choice(seps) for w in words))
    texts += [texts[10], texts[12] + " x", "a " * 300, "a " * 120]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[9], (None, texts[10]), (rows[11][0], texts[13])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, "clash", 1, 2) for d, t in rows], SCHEMA)


def brute_substring(rows, window):
    first = {}
    for d, t in rows:
        words = WORD.findall(t or "")
        for i in range(len(words) - window + 1):
            if d is not None:
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 8])
def test_substring_matches_brute_force(spark, window):
    rows = corpus()
    got = substring.dedup_substrings(frame(spark, rows), window).collect()
    assert sorted(map(tuple, got), key=str) == brute_substring(rows, window)


def test_substring_empty_table(spark):
    assert substring.dedup_substrings(frame(spark, [])).count() == 0


@pytest.mark.parametrize("period", sorted(substring.COVERS))
def test_covers_reach_every_difference(period):
    d = substring.COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def brute_fingerprint(text, k=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, radius=2):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(items):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, fp, low.get(find(i))) for i, (d, fp) in enumerate(items)]


def test_near_duplicates_match_brute_force(spark):
    rows = corpus(2, 60)
    base = "the quick brown fox jumps over the lazy dog " * 30
    rows += [(200 + i, base + " " + "tail" * (i % 3) + f" e{i}") for i in range(30)]
    want = brute_components([(d, brute_fingerprint(t)) for d, t in rows])
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r[0], int(r[1], 16), r[2]) for r in got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_rows_without_ids_link_but_name_nothing(spark):
    """Linked rows that all lack an id have no component id; with one id known it is theirs."""
    near = "the quick brown fox jumps over the lazy dog " * 30
    rows = [(None, near), (None, near + "tail"), (None, "something else altogether here"), (None, None), (1 << 62, "x y z")]
    rows += [((1 << 62) + 9, "x y z"), (None, "x y z")]
    want = brute_components([(d, brute_fingerprint(t)) for d, t in rows])
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r[0], int(r[1], 16), r[2]) for r in got), key=str) == sorted(want, key=str)


def test_dense_buckets_are_cut_and_lose_no_link(spark):
    rng = random.Random(3)
    fps = set()
    for centre in (0, rng.getrandbits(64)):
        fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(250)}
    fps |= {rng.getrandbits(64) for _ in range(100)}
    items = list(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(simhash._signed(f), i) for i, f in items], "fp long, node long")
    for bucket in (8, 1024):
        roots = {r.node: r.root for r in simhash.components(simhash.stars(nodes, bucket=bucket)).collect()}
        assert [(i, f, roots.get(i, i)) for i, f in items] == brute_components(items)


def test_bit_sliced_distances():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, size=200, dtype=np.uint64)
    fps[1::2] = fps[::2] ^ (np.uint64(1) << rng.integers(0, 64, size=100, dtype=np.uint64))
    p = simhash.planes(fps)
    every = np.full(p.shape[1], 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for radius in (0, 1, 2, 7):
        for shift in (1, 63, 64, 70):
            got = np.unpackbits(simhash.within(p, shift, radius, every).view(np.uint8), bitorder="little")
            want = [(int(a) ^ int(b)).bit_count() <= radius for a, b in zip(fps, fps[shift:], strict=False)]
            assert got[: len(want)].astype(bool).tolist() == want


def test_words_are_cut_at_rows():
    import pyarrow as pa

    texts = ["ab", "cd ef", "", " g", None, "h\x1ci j"]
    offsets, raw = common.string_buffers(pa.array(texts))
    w = common.Words(offsets, raw)
    assert np.diff(w.first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert len(set(w.hashes().tolist())) == len(w)
