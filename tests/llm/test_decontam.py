"""Benchmark decontamination against brute force over all windows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import common, decontam

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(words):
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, least=0.8):
    out = []
    for d, t in rows:
        words = words_of(t)
        for i, text in items:
            item = words_of(text)
            if not item:
                continue
            best = max(((decontam.similarity_of(bag(words[s : s + len(item)]), bag(item)), -s) for s in range(len(words) - len(item) + 1)), default=(0, 0))
            if best[0] >= least:
                out.append((d, i, -best[1], round(best[0], 9)))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(500)] + ["é", "x,"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(15, 60)))) for i in range(20)]
    items += [(50, "one two"), (51, "tiny"), (52, ""), (53, None), (54, "a b a b a b a b a b a b"), (3, items[3][1])]
    rows = [(0, None), (1, ""), (2, "tiny"), (3, "say one two three")]
    for d in range(4, 120):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            item = items[rng.randrange(20)][1].split()
            if d % 2:  # an edge or an inner word is changed
                item[rng.choice([0, -1, len(item) // 2])] = "changed"
            if d % 5 == 0:
                item = item[2:]
            words[len(words) // 2 : len(words) // 2] = [w.lower() for w in item]
        rows.append((d, " \n".join(words)))
    rows += [(200, "a b " * 30), (None, rows[6][1]), rows[9], (201, " ".join(t for _, t in items if t))]
    return rows, items


def test_matches_equal_brute_force(spark):
    rows, items = corpus()
    d = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, [x for k, x in enumerate(items) if x not in items[:k]])
    for block in (decontam.BLOCK, 2000):  # one block of items, and several
        got = sorted(((r.doc_id, r.item_id, r.start, round(r.similarity, 9)) for r in decontam.contaminated(d, b, block=block).collect()), key=str)
        assert got == want
    kept = decontam.decontaminate(d, b)
    bad = {str(x[0]) for x in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(a) for a, _ in rows if str(a) not in bad)
    assert kept.columns == d.columns
    assert decontam.contaminated(d.limit(0), b).count() == 0
    assert decontam.contaminated(d, b.limit(0)).count() == 0


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    index = decontam.HammingIndex(prints, 7)
    for _ in range(100):
        q = int(prints[rng.integers(300)])
        for b in rng.integers(0, 64, rng.integers(0, 10)):
            q ^= 1 << int(b)
        want = [k for k, p in enumerate(prints) if (int(p) ^ q).bit_count() <= 7]
        assert sorted(index.near(q, set(range(300)))) == want


def test_window_simhash_is_the_majority_of_bits():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    mixed = common.mix(h * np.uint64(0x9E3779B97F4A7C15))
    got = decontam.simhashes(h, 9)
    for i in range(len(got)):
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in mixed[i : i + 9]) > 9)
        assert int(got[i]) == want
    assert pa is not None


def test_document_shorter_than_the_item(spark):
    item = [f"w{i}" for i in range(40)]
    texts = {1: item[:-1], 2: item[1:], 3: item[:33], 4: item[:32], 5: item[:4], 6: [*item[:20], "other", *item[21:39]]}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item)), (8, "x " * 8 + "y"), (9, "one two three")], "item_id long, text string")
    want = {i: round(decontam.similarity_of(bag(t), bag(item)), 9) for i, t in texts.items()}
    got = {r.doc_id: (r.item_id, r.start, round(r.similarity, 9)) for r in decontam.contaminated(d, b).collect()}
    assert got == {i: (7, 0, s) for i, s in want.items() if s >= 0.8} and {1, 2, 3} == set(got)
    assert sorted(r.doc_id for r in decontam.decontaminate(d, b).collect()) == [4, 5, 6]


def test_blocks_yield_the_candidates(spark, monkeypatch):
    """Every window's fingerprint asks the blocks of its size; without them nothing is found."""
    rows, items = corpus(3)
    asked = []
    plain = decontam.HammingIndex.candidates

    def counted(self, queries):
        q, k = plain(self, queries)
        asked.append((len(queries), len(self.prints), len(k)))
        return q, k

    monkeypatch.setattr(decontam.HammingIndex, "candidates", counted)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows], pa.string())})
    unique = [x for k, x in enumerate(items) if x not in items[:k]]
    searched = decontam.Items([i for i, _ in unique], [t or "" for _, t in unique], 0.8)
    found = {(rows[r][0], searched.ids[k], at) for r, k, at, _ in decontam._matches(batch, searched)}
    assert found == {x[:3] for x in brute(rows, unique)}
    assert sum(n for n, *_ in asked) >= len(found) and all(k <= n * members for n, members, k in asked)
    monkeypatch.setattr(decontam.HammingIndex, "candidates", lambda self, q: (np.zeros(0, int), np.zeros(0, int)))
    assert not list(decontam._matches(batch, searched))


def test_radius_leaves_out_next_to_nothing():
    """Recall of the radius on pairs of windows at a similarity of just 0.8, by size."""
    rng = np.random.default_rng(8)
    for width, changed in ((9, 1), (18, 2), (45, 5), (180, 20)):
        radius = decontam.radius_for(width, 0.8, False)
        assert 20 < radius < 30
        same = rng.integers(0, 1 << 63, (4000, width - changed), dtype=np.uint64)
        prints = [
            np.array([int(decontam.simhashes(np.concatenate([row, own]), width)[0]) for row, own in zip(same, rng.integers(0, 1 << 63, (4000, changed), dtype=np.uint64), strict=True)], dtype=np.uint64)
            for _ in range(2)
        ]
        assert (np.bitwise_count(prints[0] ^ prints[1]) <= radius).all()


def test_long_text_of_repeats(spark):
    """A long text made of one item's words over and over is searched in bounded pieces."""
    item = "alpha beta gamma delta epsilon zeta eta theta"
    d = spark.createDataFrame([(1, f"{item} " * 4000), (2, "other words " * 20000)], "doc_id long, text string")
    b = spark.createDataFrame([(5, f"{item} {item}")], "item_id long, text string")
    assert [(r.doc_id, r.start, r.similarity) for r in decontam.contaminated(d, b).collect()] == [(1, 0, 1.0)]
