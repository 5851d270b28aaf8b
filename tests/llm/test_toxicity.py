"""Toxicity: held-out accuracy, misspellings, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    syllables = ["an", "er", "tion", "the", "in", "on", "re", "ha", "nd", "st", "és", "lo"]
    bad = ["disgusting", "worthless", "pathetic"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((i, " ".join(words), "en", "s", 1, "clash"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = corpus()
    docs += [(1000, docs[0][1].replace("disgusting", "disgustting").replace("worthless", "worthles").replace("pathetic", "pathetik"), None, None, None, None)]
    docs += [(None, None, None, None, None, None), (1001, "", None, None, None, None), docs[3]]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(d, lab).collect()
    assert len(rows) == len(docs)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert next(r for r in rows if r.doc_id == 1000).score > 0.5
    empty = [r.score for r in rows if r.doc_id in (None, 1001)]
    assert empty[0] == empty[1] and 0 <= empty[0] < 0.5
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns
    assert kept.count() == sum(r.score < 0.5 for r in rows)


def test_fold_zero_is_never_learned(spark):
    docs, labels = corpus(120)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    a, b = (toxicity.fit(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(99, 1, 0), (98, 1, 1)]])
def test_few_labels(spark, labels):
    d = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    rows = toxicity.score(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    # no evidence of any text: the share of class 1 below one half, and nothing is dropped
    assert all(r.predicted == 0 for r in rows)
    assert toxicity.drop_toxic(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 2
    assert toxicity.score(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def brute_features(text):
    out = []
    for word in (text or "").lower().split():
        marked = f" {word} "
        for n in toxicity.GRAMS:
            out += [marked[i : i + n] for i in range(len(marked) - n + 1)]
        out.append("word:" + word)
    return out


def test_features_are_the_marked_character_runs():
    texts = ["Ab cde\nfghij", "", "é", "  x  "]
    c = toxicity.Characters(texts)
    counts = np.zeros(c.n + 1, dtype=int)
    for at, _ in c.features():
        np.add.at(counts, at + 1, 1)
    total = np.cumsum(counts)
    got = [int(total[hi] - total[lo]) for lo, hi in zip(c.bounds[:-1] - 1, c.bounds[1:] - 1, strict=True)]
    assert got == [len(brute_features(t)) for t in texts]
    table = np.arange(1 << toxicity.BITS, dtype=np.float32) / 1e6
    alone = [toxicity.score_texts([t], table, 0.1)[0] for t in texts]
    assert np.allclose(alone, toxicity.score_texts(texts, table, 0.1))


def brute_score(text, table, bias):
    """Every feature hashed on its own, in whole numbers."""
    m64 = (1 << 64) - 1
    code = lambda ch: (1 + (32 if ch in " \t\n\x0b\x0c\r" else ord(ch))) * 0x9E3779B97F4A7C15 & m64

    def rolled(run):
        h = 0
        for ch in run:
            h = (h * 0xD6E8FEB86659FD93 + code(ch)) & m64
        return h

    def bucket(h):
        return ((h ^ h >> 32) * 0xBF58476D1CE4E5B9 & m64) >> 64 - toxicity.BITS

    found = []
    for word in (text or "").lower().split():
        marked = f" {word} "
        for n in toxicity.GRAMS:
            found += [bucket(rolled(marked[i : i + n]) + n & m64) for i in range(len(marked) - n + 1)]
        h, power = 0, 1
        for ch in word:
            h, power = (h + code(ch) * power) & m64, power * 0xD6E8FEB86659FD93 & m64
        found.append(bucket(h))
    mean = sum(float(table[b]) for b in found) / max(len(found), 1)
    return 1 / (1 + np.exp(-(toxicity.SCALE * mean + bias)))


def test_scores_equal_brute_force(spark):
    docs, labels = corpus(150)
    docs = [x[:2] for x in docs] + [(900, "é Été ÖL\tx " * 40), (901, ""), (902, "w " * 30000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table, bias = toxicity.fit(d, lab)
    got = {r.doc_id: r.score for r in toxicity.score(d, lab).collect()}
    for i, t in docs[::9] + docs[-3:]:
        assert abs(got[i] - brute_score(t, table, bias)) < 1e-6


def test_repeated_ids_train_the_same_way(spark):
    docs, labels = corpus(60)
    rows = [x[:2] for x in docs] + [(i, "another text " + t) for i, t, *_ in docs[:30]]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = (toxicity.fit(spark.createDataFrame(x, "doc_id long, text string"), lab) for x in (rows, rows[::-1]))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_training_is_not_the_drivers(spark, monkeypatch):
    docs, labels = corpus(60)
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "train", None)  # the driver's; workers have their own
    table, _ = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert table.any()
