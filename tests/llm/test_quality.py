"""Quality rules: statistics against brute force, robust estimates, odd rows."""

import random
import re
from collections import Counter

import numpy as np

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 5)}
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, n < 10 or 100 * repeat > 20 * n


def corpus():
    rng = random.Random(3)
    vocab = ["a", "bb", "é", "naïve", "#", "x|y", "😀", "word", "the", "of", "c<d>", "\x1c"] + [f"w{i}" for i in range(40)]
    texts = [None, "", " \n\t", "one", "a b c d e", "same line\nsame line\n\nsame line", "z " * 400, "\n".join(["a b c d e f"] * 9)]
    for _ in range(120):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 15))]
        texts.append(rng.choice(["\n", "\r\n", "\n\n"]).join(lines + rng.sample(lines, rng.randrange(0, len(lines)))))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s", None])) for i, t in enumerate(texts)]
    return [*rows, (None, "a b", None, None), rows[20]]


def test_statistics_match_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, lang string, source string, g string, x0 double")
    got = quality.judge(d).collect()
    assert sorted(((r.doc_id, *tuple(r)[1:7]) for r in got), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(d.limit(0)).count() == 0


def test_outliers_are_rejected_and_the_rest_kept(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 400))]
        if i % 5 == 0:  # a fifth of the group is junk, which plain moments would absorb
            words = [w + "***%%" for w in words]
        rows.append((i, " ".join(words), "en", "s"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.judge(d).collect() if not r.kept} == set(range(0, 300, 5))


def test_estimate_ignores_a_cluster_of_outliers(spark):
    rng = np.random.default_rng(2)
    true = np.array([1.0, 2, 3, 4, 5])
    points = rng.normal(0, 1, (800, 5)) * [1, 2, 1, 3, 1] + true
    points[:160] += 40
    rows = spark.createDataFrame([("g", *map(float, p)) for p in points], "g string, " + ", ".join(f"{x} double" for x in quality.X))
    found = quality.mcd(rows).first()
    assert np.allclose([found[f"m{i}"] for i in range(5)], true, atol=0.5)
    assert np.allclose([found[f"l{i}_{i}"] for i in range(5)], [1.1, 2, 1, 3, 1], rtol=0.25)


def test_chi_square():
    assert abs(quality._chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def quantile(values, share, step):
    b = np.sort(np.ceil(np.asarray(values) / step))
    return b[int(np.searchsorted(np.arange(1, len(b) + 1), share * len(b)))] * step


def brute_mcd(points, settled=1e-3, steps=12):
    """Concentration steps over named groups of points in plain numpy: means and scatters."""
    floor = np.diag([f * f for _, f in quality.FEATURES.values()])
    factor = quality.KEEP / quality._chi2_cdf(quality._chi2_quantile(quality.KEEP, quality.D), quality.D + 2)

    def distance(x, m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    now = {}
    for g, x in points.items():
        mid = np.array([quantile(c, 0.5, 1 / 256) for c in x.T])
        spread = np.array([quantile(abs(c - m), 0.5, 1 / 256) for c, m in zip(x.T, mid, strict=True)])
        now[g, 0] = mid, np.diag((1.4826 * spread) ** 2) + floor
        now[g, 1] = x.mean(axis=0), np.cov(x.T, bias=True) + floor
    for _ in range(steps):
        before, now = now, {}
        for (g, k), (m, c) in before.items():
            far = np.log1p(distance(points[g], m, c))
            near = points[g][far <= quantile(far, quality.KEEP, 1 / 128)]
            now[g, k] = near.mean(axis=0), np.cov(near.T, bias=True) * factor + floor
        if max(abs(np.linalg.slogdet(now[k][1])[1] - np.linalg.slogdet(before[k][1])[1]) for k in now) < settled:
            break
    return {g: min((now[g, 0], now[g, 1]), key=lambda e: np.linalg.slogdet(e[1])[1]) for g in points}


def test_verdicts_equal_plain_numpy(spark):
    """Every verdict comes from an estimate: of the group, its language, or the whole table."""
    rng = random.Random(11)
    rows = []
    for lang, source, n in (("en", "s", 70), ("en", "t", 9), ("fr", None, 45), ("fr", "", 45), ("de", "s", 4), (None, "s", 40), ("", "s", 40)):
        for _ in range(n):
            words = ["".join(rng.choice("abcdefgh#") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(70, 300) if rng.random() < 0.97 else 4)]
            if rng.random() < 0.1:
                words = [w + "<|>" * 3 for w in words]
            lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
            rows.append((len(rows), "\n".join(lines + lines[:1] * rng.randrange(2)), lang, source))
    judged = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    x = {}
    for i, text, *_ in rows:
        n, chars, symbols, dup, repeat, failed = brute(text)
        if not failed:
            x[i] = np.array([np.log1p(n), np.log(chars / max(n, 1) + 1), np.sqrt(symbols / max(chars, 1)), np.log1p(dup), np.sqrt(repeat / max(n, 1))])
    own = {i: (lang, source) for i, _, lang, source in rows}
    size, by_lang = Counter(own[i] for i in x), Counter(own[i][0] for i in x)
    group = {i: o if size[o] >= 30 else ("lang", o[0]) if by_lang[o[0]] >= 30 else "all" for i, o in own.items()}
    assert len(set(group.values())) == 7 and group[71] == ("lang", "en")
    members = {g: [i for i in x if g in (own[i], ("lang", own[i][0]), "all")] for g in set(group.values())}
    estimates = brute_mcd({g: np.array([x[i] for i in ids]) for g, ids in members.items()})
    limit = quality._chi2_quantile(1 - quality.TAIL, quality.D)
    for i, r in judged.items():
        if i not in x:
            assert not r.kept
            continue
        m, c = estimates[group[i]]
        d2 = float((x[i] - m) @ np.linalg.inv(c) @ (x[i] - m))
        assert abs(r.distance - d2) < 1e-6 * max(1, d2)
        assert r.kept == (d2 <= limit)
    assert 0 < sum(not r.kept for i, r in judged.items() if i in x) < len(x) / 4


def test_estimate_is_near_the_best_subset(spark):
    """The exact minimum over all subsets of three quarters of a small sample."""
    from itertools import combinations

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (14, 5))
    x[:3] += 25
    rows = spark.createDataFrame([("g", *map(float, p)) for p in x], "g string, " + ", ".join(f"{n} double" for n in quality.X))
    found = quality.mcd(rows, least=10).first()
    factor = quality.KEEP / quality._chi2_cdf(quality._chi2_quantile(quality.KEEP, 5), 7)
    floor = np.diag([f * f for _, f in quality.FEATURES.values()])
    best = min(np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) * factor + floor)[1] for s in combinations(range(14), 11))
    assert abs(found.log_det - best) < 1e-6


def test_very_long_text(spark):
    text = " ".join(f"w{i % 3000}" for i in range(30000))
    d = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    assert tuple(quality.judge(d).first())[:7] == (1, *brute(text))
