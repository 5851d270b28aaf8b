"""URL filter against brute force, with nested rules and odd urls."""

import random
import re

from tessera.llm import urlfilter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute(pages, rules):
    out = []
    for i, url in pages:
        host, path = split(url)
        fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None, key=lambda x: x[:3])
        out.append((i, host, path, best[2] if best else None, best[3] if best else "allow"))
    return sorted(out, key=str)


def pages():
    rng = random.Random(5)
    labels = ["com", "net", "example", "www", "a", "b-c", "a/b", "COM", "é", "x.com:80"]
    urls = [None, "", "x", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://a?b://c/", "http://notcom/", "a\n://com/\n/x", "http://.com/", "http://com./"]
    for _ in range(600):
        host = ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
        path = "".join(rng.choice(["/", "/en/", "/es/", "/fr/", "e", "n/", "?q", "#f", "/a", "/a/b/"]) for _ in range(rng.randrange(0, 4)))
        urls.append(f"https://{host}{path}")
    rows = list(enumerate(urls))
    return [*rows, (None, "http://x.net/es/"), rows[7], *[(1000 + i, "http://www.example.com/en/hot") for i in range(400)]]


def check(spark, rules):
    rows = pages()
    d = spark.createDataFrame([(i, u, "clash", 1) for i, u in rows], "page_id long, url string, host string, row long")
    r = None if rules is None else spark.createDataFrame(rules, "host string, path string, action string")
    got = sorted((tuple(x) for x in urlfilter.judge(d.repartition(7), r).collect()), key=str)
    assert got == brute(rows, urlfilter.RULES if rules is None else rules)


def test_stated_rules(spark):
    check(spark, None)


def test_many_nested_rules(spark):
    rng = random.Random(8)
    rules = {}
    for _ in range(60):
        host = ".".join(rng.choice(["com", "net", "example", "www", "a", "b-c"]) for _ in range(rng.randrange(1, 4)))
        rules[host, rng.choice(["", "/", "/en/", "/a", "/a/b/", "/e"])] = rng.choice(["allow", "block"])
    check(spark, [(h, p, a) for (h, p), a in rules.items()])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    assert urlfilter.judge(d.limit(0)).count() == 0
    none = spark.createDataFrame([], "host string, path string, action string")
    assert [tuple(r) for r in urlfilter.judge(d, none).collect()] == [(1, "com", "/", None, "allow")]
