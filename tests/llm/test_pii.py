"""PII: base spans against the plain patterns, the tagger's parts, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "é", "@", ".", "b-c", " ", "+", "1", "23", "4111 1111 1111 1111", "10.0.0.1", "+1 (212) 555-0100", "x@y.z", "-", "(", ")", "\n", "256", "٣", "000"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.mark.parametrize("text", ["9" * 30000, "a" * 30000, "1." * 20000, "+1" + " " * 30000, "@" * 20000, "a.b@" * 8000])
def test_long_runs_are_linear(text):
    pii.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    model = pii.Tagger.fresh()
    sym = rng.integers(0, 128, (12, 5)).astype(np.uint8)
    tags = np.zeros((12, 5), np.uint8)
    tags[3], tags[4:7], tags[8, 2], tags[9, 2] = 1, 2, 5, 6
    _, grads = model.loss_and_gradients(sym, tags)
    for p, g in zip(model.params, grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        old, sides = p[at], []
        for d in (0.01, -0.01):
            p[at] = old + d
            sides.append(model.loss_and_gradients(sym, tags)[0])
        p[at] = old
        assert abs((sides[0] - sides[1]) / 0.02 - g[at]) < 0.01 * max(1, abs(g[at]))


def test_decoding_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    model = pii.Tagger.fresh()
    model.params[7] = rng.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
    em = rng.normal(0, 2, (4, pii.TAGS, 6)).astype(np.float32)
    em[:, 0, 3] += 30  # surely O
    length = np.array([4, 4, 3, 4, 2, 1])
    got = model.decode(em, length)
    ok = pii._allowed()
    for col, n in enumerate(length):
        best = max(
            (sum(em[t, k, col] for t, k in enumerate(path)) + sum(model.params[7][a, b] for a, b in zip(path, path[1:], strict=False)), path)
            for path in product(range(pii.TAGS), repeat=int(n))
            if all(ok[a, b] for a, b in zip(path, path[1:], strict=False))
        )
        assert tuple(got[:n, col]) == best[1]


def corpus(n=300):
    rng = random.Random(9)
    words = ["and", "the", "of", "été", "station", "onder"]
    docs = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        digits = "".join(rng.choice("0123456789") for _ in range(4))
        for x in (f"user{i}@mail{i % 9}.example.com", f"{i % 250}.17.{i % 90}.8", f"+1 ({digits[:3]}) 555-{digits}", "4111 1111 1111 1111"):
            if rng.random() < 0.5:
                text.insert(rng.randrange(len(text)), x)
        docs.append((i, " ".join(text), "en", 1, "clash"))
    return [*docs, (None, None, None, None, None), (5, "", None, 0, None), docs[0]]


def test_query_and_redaction(spark):
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long, spans string")
    rows = pii.find(d).collect()
    assert len(rows) == len(docs)
    want = sorted((i, hashlib.sha256(pii.spell(plain_spans(t or "")).encode()).hexdigest()) for i, t, *_ in docs if i is not None)
    assert sorted((r.doc_id, r.base_sha256) for r in rows if r.doc_id is not None) == want
    texts = {i: t for i, t, *_ in docs}
    for r in rows:
        if r.doc_id != 5:
            every = set(filter(None, r.spans.split(",")))
            assert set(filter(None, pii.spell(plain_spans(texts[r.doc_id] or "")).split(","))) <= every
    clean = pii.redact(d)
    assert clean.schema == d.schema
    for r in clean.collect():
        assert not plain_spans(r.text or "")
        assert r.text is None or r.lang is None or "[" not in r.text or r.n_chars == len(r.text)
    assert pii.find(d.limit(0)).count() == 0


def test_tagger_learns_and_windows_agree():
    docs = [(t, plain_spans(t)) for _, t, *_ in corpus(200) if t]
    model = pii.train(docs, steps=250)
    hit = miss = 0
    long_text = " and of ".join(t for t, _ in docs[:60])
    for text in [t for t, _ in docs[100:160]] + [long_text]:
        found = set(pii.tag_spans(model.tag([pii.symbols(text)])[0]))
        want = set(plain_spans(text))
        hit += len(found & want)
        miss += len(want - found)
    assert hit > 0.85 * (hit + miss)
    one = model.tag([pii.symbols(long_text)])[0]
    two = model.tag([pii.symbols("short"), pii.symbols(long_text), pii.symbols("")])[1]
    assert (one == two).mean() > 0.999


@pytest.mark.parametrize("seed", range(4))
def test_windows_without_digits_change_nothing(seed):
    """An untrained tagger marks long runs everywhere; the merged spans must not differ."""
    rng = random.Random(seed)
    model = pii.Tagger.fresh(seed)
    model.params[6][1:] += 0.6
    words = ["and", "the", "station", "x@y", "10.0.0.1", "555 0100 123456789", "été"]
    weights = [30, 30, 30, 1, 1, 1, 30]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(0, 900))) for _ in range(25)] + ["", "a" * 5000, "7" * 3000, "a" * 2000 + "5" * 20 + "a" * 2000]
    coded = [pii.symbols(t) for t in texts]
    for t, some, every in zip(texts, model.tag(coded), model.tag(coded, every=True), strict=True):
        base = pii.base_spans(t)
        assert pii.merge(t, base, pii.tag_spans(some)) == pii.merge(t, base, pii.tag_spans(every))
    assert any(t.any() for t in model.tag(coded))


def test_training_rows_are_bounded_and_alone(spark):
    """Repeated ids and rows do not widen the sample, and fit ships its own code."""
    rows = [(1, f"mail a{i}@b.example now " * 30) for i in range(40)] + [(2, "no data " * 20)] * 30
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.fit(d, sample=5, excerpts=3) is not None
    assert pii.fit(d.limit(0)) is None


def test_training_is_not_the_drivers(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"mail a{i}@b.example now " * 30) for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr(pii, "train", None)  # the driver's; workers have their own
    assert pii.fit(d).params
