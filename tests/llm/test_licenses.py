"""License scan: base columns against brute force, added labels, odd rows."""

import random
import re

from tessera.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def corpus():
    rng = random.Random(6)
    vocab = ["MIT", "License", "license,", "Apache", "General", "Public", "GNU", "x", "é", "mıt", "mİt", "publiK", "the", "0"]
    texts = [None, "", "  ", "MIT", "MIT License", "(mit)-LICENSE", "mit license mit license"]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += ["word " * 5000 + "apache license", "mit license " * 800]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (None, "general public license"), rows[9], (4, "other")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, words string, row long")


def test_base_columns_match_brute_force(spark):
    rows = corpus()
    got = licenses.scan(frame(spark, rows)).collect()
    assert sorted((tuple(r[:6]) for r in got), key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or r.n_base == 0)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_notices_add_labels(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, filler + "\nLicensed under CC BY-NC 4.0."),
        (2, "Redistribution and use in source or binary forms, with or without any modification, are permitted provided that the following conditions are met:"),
        (3, filler),
        (4, "licensed and sold under the counter"),
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["cc-by-nc", "bsd", "", ""]
    assert got[1].score == 1.0 and 0.8 <= got[2].score <= 1 and got[3].score == 0 and got[1].n_base == 0


def brute_notices(text):
    """Labels of the notices found with at least 0.8 of their words, and the largest share."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spans = []
    for notice, label in licenses.NOTICES.items():
        t = notice.split()
        votes = {}
        for i in range(len(words) - 1):
            for p in range(len(t) - 1):
                if words[i : i + 2] == t[p : p + 2]:
                    votes.setdefault(i - p, set()).add(p)
        run = []
        for d in [*sorted(votes), None]:
            if run and (d is None or d - run[-1] > 2):
                ps = set().union(*(votes[x] for x in run))
                share = len(ps | {p + 1 for p in ps}) / len(t)
                if share >= 0.8:
                    spans.append((label, min(x + min(votes[x]) for x in run), max(x + max(votes[x]) + 2 for x in run), len(t), share))
                run = []
            run.append(d)
    kept = [s for s in spans if not any(t[1] < s[2] and s[1] < t[2] and (t[4], t[3]) > (s[4], s[3]) for t in spans)]
    return {s[0] for s in kept}, max((s[4] for s in kept), default=0.0)


def test_added_labels_and_score_match_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            notice = rng.choice([*licenses.NOTICES, *licenses.PHRASES]).split()
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(notice))
                notice[k : k + 1] = rng.choice([[], ["other"], [notice[k], "extra"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((i, " ".join(words)))
    rows += [(500, "all rights reserved " * 3000), (501, None)]
    for r in licenses.scan(frame(spark, rows)).collect():
        n, places, *_, base = brute(dict(rows)[r.doc_id])
        labels, score = brute_notices(dict(rows)[r.doc_id])
        assert r.labels == ",".join(sorted(labels | set(filter(None, base.split(",")))))
        assert abs(r.score - (1.0 if places else score)) < 1e-12


def test_no_templates(spark):
    got = licenses.scan(frame(spark, [(1, "mit license")]), {}, {"one": "short"}).first()
    assert tuple(got) == (1, 2, 0, None, None, "", "", 0.0)
