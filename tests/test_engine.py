"""The engine's operators on small literals: the reference data model's own edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import aggregates, joins, linalg, ordering, predicates, ranges, text, windows
from tessera.sources import detect, files, sinks
from tessera.streaming import changelog

SALES = [(i + 1, a, q) for i, (a, q) in enumerate(zip([50, 150, 200, 75, 300, 25, 500, 100, 450, 80], [2, 3, 1, 4, 2, 1, 5, 3, 2, 1], strict=True))]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "id long, amount long, quantity long").cache()


def write_text(folder, name, content):
    (folder / name).write_text(content, encoding="utf-8")


def test_three_formats_and_catalog(spark, sales, tmp_path):
    write_text(tmp_path, "sales.csv", "id,amount,quantity\n" + "".join(f"{a},{b},{c}\n" for a, b, c in SALES))
    write_text(tmp_path, "sales2.ndjson", "".join(f'{{"id": {a}, "amount": {b}, "quantity": {c}}}\n' for a, b, c in SALES))
    write_text(tmp_path, "array.json", "[" + ",".join(f'{{"id": {a}, "amount": {b}}}' for a, b, _ in SALES) + "]")
    write_text(tmp_path, "tabs.dat", "id\tamount\t\n1\t2\tx\n")
    write_text(tmp_path, "only_header.csv", "a,b\n")
    sales.coalesce(1).write.parquet(str(tmp_path / "sales3.parquet"))
    catalog = detect.Catalog(spark, str(tmp_path))
    assert catalog.refresh() == ["array", "only_header", "sales", "sales2", "sales3", "tabs"]
    for t in ("sales", "SALES2", "sales3"):
        r = catalog.sql(f"select count(*) n, count_if(amount > 100) m, sum(amount) s, sum(case when amount > 100 then amount end) x from {t}").first()
        assert (r.n, r.m, r.s, r.x) == (10, 5, 1930, 1600)
    assert catalog.sql("select count(*) n from sales where amount > :least", least=100).first().n == 5
    assert catalog.table("array").count() == 10 and catalog.table("only_header").count() == 0
    assert catalog.table("tabs").columns == ["id", "amount", "_col_2"]
    assert catalog.pin("sales").count() == 10
    write_text(tmp_path, "sales.csv", "id,amount,quantity\n1,7,1\n")
    catalog.refresh()
    assert catalog.table("sales").first().amount == 7


def test_detection_and_sniffing():
    assert detect.detect_format("x", b"PAR1...") == "parquet"
    assert detect.detect_format("x.csv", b"  {\"a\":1}") == "json"
    assert detect.detect_format("x.jsonl", b"") == "json" and detect.detect_format("x", b"a,b") == "csv"
    assert detect.sniff_delimiter("a,b\tc") == "," and detect.sniff_delimiter("a|b|c,d") == "|"
    assert detect.column_names("id,,amount,\r\n", ",") == ["id", "_col_1", "amount", "_col_3"]


def test_nan_and_null_predicates(spark):
    d = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None), (4, 40.0), (5, float("nan"))], "i int, v double")
    ids = lambda t: sorted(r.i for r in d.where(t).collect())
    v = F.col("v")
    assert ids(predicates.compare(v, ">", 15.0, True)) == [2, 4]
    assert ids(predicates.compare(v, "!=", 10.0, True)) == [2, 4, 5]
    assert [r.m for r in d.orderBy("i").select(predicates.mask(predicates.compare(v, ">", 15.0, True)).alias("m")).collect()] == [False, True, False, True, False]


def test_global_ranks_and_sums(spark):
    rows = [(i, (i * 7 + 13) % 100) for i in range(500)]
    d = spark.createDataFrame(rows, "id long, k long").repartition(5)
    want = {i: n for n, (k, i) in enumerate(sorted((k, i) for i, k in rows))}
    assert {r.id: r.row for r in ranges.row_index(d, "k", ["id"], ranges=7).collect()} == want
    sums, total = {}, 0
    for i, k in rows:
        sums[i], total = total, total + k
    assert {r.id: r.prefix for r in ranges.prefix_sum(d, "id", [], "k", ranges=7).collect()} == sums
    assert ranges.row_index(d.limit(0), "k", ["id"]).count() == 0
    hot = ranges.ranged(d.withColumn("k", F.lit(1)), ["k", "id"], 6).groupBy("_b").count().collect()
    assert len(hot) == 6 and max(r["count"] for r in hot) < 200
    assert {r["id"]: r["rank"] for r in ordering.argsort(d, "k", "id").collect()} == want


def test_asof_lookup(spark):
    look = spark.createDataFrame([(k * 10.0, float(k)) for k in range(1, 30)], "k double, v double")
    ask = spark.createDataFrame([(x, x * 1.7) for x in range(200)], "i int, x double")
    # a null lookup key answers nothing, a null search finds nothing, a hot search key is dealt out
    gaps = spark.createDataFrame([(None, 99.0), (2.0, 7.0)], "k double, v double")
    for n in (1, 3):
        found = ranges.asof_lookup(spark.createDataFrame([(1, 0.5), (2, None), *[(i, 3.0) for i in range(3, 60)]], "i int, x double"), "x", gaps, "k", "v", ranges=n).collect()
        assert {r.i: r.found for r in found} == {1: -1.0, 2: -1.0, **{i: 7.0 for i in range(3, 60)}}
    for n in (1, 4, 64):
        for r in ranges.asof_lookup(ask, "x", look, "k", "v", ranges=n).collect():
            assert r.found == (min(29.0, r.x // 10) if r.x >= 10 else -1.0)
    assert {r.found for r in ranges.asof_lookup(ask, "x", look.limit(0), "k", "v").collect()} == {-1.0}


def test_joins_and_lookup(spark):
    build = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "k long, seq long, v string")
    probe = spark.createDataFrame([(1,), (1,), (3,)], "k long")
    assert sorted((r.k, r.v) for r in joins.join_deduplicated(probe, build, "k", "seq").collect()) == [(1, "b"), (1, "b")]
    store = spark.createDataFrame([(1, 5)], "k long, v long")
    assert sorted(r.v for r in joins.kv_lookup(probe, store, "k", "v").collect()) == [5, 5, joins.MISSING]


def test_windows(spark):
    d = spark.createDataFrame([(1, i, float(i), 0.0 if i < 2 else 1.0) for i in range(5)], "k int, i int, p double, v double")
    assert [r.moving_avg for r in windows.moving_average(d, "k", ["i"], "p", 2).orderBy("i").collect()] == [0, 0.5, 1.5, 2.5, 3.5]
    assert [r.vwap for r in windows.vwap(d, "k", ["i"], "p", "v", 2).orderBy("i").collect()] == [0, 0, 2, 2.5, 3.5]


def test_aggregates(spark, sales):
    t = {r.column_name: r for r in aggregates.describe_table(sales).collect()}
    assert (t["amount"].n_rows, t["quantity"].distinct_count, t["amount"].max_value, t["id"].null_count) == (10, 5, "500", 0)
    assert {r.bin: r.n for r in aggregates.histogram_mod(sales, "amount", 100).collect()} == {50: 3, 0: 4, 75: 1, 25: 1, 80: 1}
    empty = sales.where("id < 0").agg(F.sum("amount").alias("s"), F.min("amount").alias("m"), F.count("*").alias("n")).first()
    assert (empty.s, empty.m, empty.n) == (None, None, 0)
    starts = aggregates.group_boundaries(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "p int, i int, k string"), "k", ["i"], ["p"])
    assert [r.is_start for r in starts.orderBy("i").collect()] == [1, 0, 1]


def test_float_total_order(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, math.nan, -0.0, 0.0, -math.inf, -1.0, math.inf)], "x double")
    got = [r.x for r in d.orderBy(*ordering.total_order(F.col("x"))).collect()]
    assert [str(x) for x in got] == ["-inf", "-1.0", "-0.0", "0.0", "1.0", "inf", "nan"]


def murmur(h):
    h ^= h >> 16
    h = h * 0x85EBCA6B & 0xFFFFFFFF
    h ^= h >> 13
    h = h * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def test_scalars(spark):
    xs = [0, 1, 12345, 2**31, 2**32 - 1]
    d = spark.createDataFrame([(x,) for x in xs], "x long")
    assert [r.h for r in d.select(scalars.murmur_finalize(F.col("x")).alias("h")).collect()] == [murmur(x) for x in xs]
    p = spark.createDataFrame([("/a/b/Main.rs",)], "p string")
    assert tuple(p.select(scalars.file_name(F.col("p")), scalars.extension(F.col("p")), scalars.depth(F.col("p")), scalars.fuzzy_match(F.col("p"), "mrs")).first()) == ("Main.rs", "rs", 3, True)
    assert [scalars.show_float(x) for x in (3.0, 2.5, 1 / 3)] == ["3", "2.5", "0.333333"]
    assert scalars.show_bytes(2048) == "2.0 KB" and scalars.show_rows(1500) == "1.5K" and scalars.show_time(0.5) == "500.0 ms"


def test_search(spark):
    d = spark.createDataFrame([(1, "aaaa\nbab aa\r\nend"), (2, None), (3, r"x.*\E y")], "i int, t string")
    n = lambda p, **k: [r.n for r in d.orderBy("i").select(text.count_matches(F.col("t"), p, **k).alias("n")).collect()]
    assert n("aa") == [4, None, 0] and n("aa", overlapping=False) == [3, None, 0] and n("") == [0, 0, 0]
    assert n("AA") == [0, None, 0] and n("AA", ignore_case=True) == [4, None, 0] and n(r".*\E") == [0, None, 1]
    assert [tuple(r)[1:] for r in text.positions(d, "i", "t", "aa").orderBy("offset").collect()] == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 4, 9)]
    hit = text.grep(d, "i", "t", "bab", 2).first()
    assert (hit.line_number, hit.line_content, hit.context_before, hit.context_after) == (2, "bab aa", ["aaaa"], ["end"])
    paths = spark.createDataFrame([("/src/main.rs",), ("/main/lib.rs",), ("/target/x",)], "p string")
    assert [(r.p, r.score) for r in text.search_names(paths, "p", "Main").collect()] == [("/src/main.rs", 100 / 12 + 5)]
    assert text.search_names(paths, "p", "main.rs").first().score == 100 / 12 + 10 + 5
    more = paths.unionByName(spark.createDataFrame([("/src2/a",), ("/src",), ("/src/keep/b",)], "p string"))
    left = text.exclude_paths(more, "p", ["/src"], ["target"], ["/src/main.rs", "/src/keep"])
    assert sorted(r.p for r in left.collect()) == ["/main/lib.rs", "/src/main.rs", "/src2/a"]
    words = spark.createDataFrame([(1, "/a/b", "the then\nbathe the_ é the"), (2, "/a", "athe the"), (3, "/a", None)], "i int, p string, t string")
    assert [tuple(r) for r in text.rank_matches(words, "i", "t", "p", "the").collect()] == [
        (2, 1, 5, True, 0.98), (1, 1, 0, True, 0.96), (1, 2, 13, True, 0.96), (2, 1, 1, False, 0.48), (1, 1, 4, False, 0.46), (1, 2, 2, False, 0.46), (1, 2, 6, False, 0.46)
    ]
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2, 3], [2, 3, 4, 5]))
    assert tuple(text.verify_matches(a, b, ["k"]).first()) == (2, 1, 2)
    ranked = text.bm25(spark.createDataFrame([(1, "cat dog"), (2, "cat cat"), (3, "fish")], "i int, t string"), "i", {"t": 1.0}, ["cat"])
    assert [r.i for r in ranked.orderBy(F.desc("score")).collect()] == [2, 1]


def test_matrix_products(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "i int, k int, v double")
    b = spark.createDataFrame([(0, 0, 4.0), (1, 0, 5.0)], "k int, j int, v double")
    assert {(r.i, r.j): r.v for r in linalg.gemm(a, b).collect()} == {(0, 0): 14.0, (1, 0): 12.0}
    assert linalg.gemv(spark.createDataFrame([(7, [1.0, 2.0])], "i int, m array<double>"), "i", "m", [3.0, 4.0]).first().y == 11.0


def test_sinks_and_files(spark, sales, tmp_path):
    two = sales.orderBy("id").limit(2).select("id", (F.col("amount") / 4).alias("a,b"))
    assert list(sinks.lines(two, "csv")) == ['id,"a,b"', "1,12.5", "2,37.5"]
    assert list(sinks.lines(two, "jsonl"))[0] == '{"id": 1, "a,b": 12.5}'
    assert list(sinks.lines(two, "json"))[0] == "[" and list(sinks.lines(two.limit(0), "json")) == ["[", "]"]
    assert list(sinks.lines(two, "table"))[-1] == "(2 rows)"
    sinks.save(two, str(tmp_path / "out.csv"), "csv")
    assert (tmp_path / "out.csv").read_text().count("\n") == 3
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one,two\nthree")
    (tmp_path / "d" / "b.dat").write_bytes(b"x\x00y")
    (tmp_path / "d" / "c.png").write_bytes(b"png")
    assert [r.path.rsplit("/", 1)[1] for r in files.text_files(files.walk(spark, str(tmp_path / "d"))).collect()] == ["a.txt"]
    assert tuple(files.csv_structure(spark.read.text(str(tmp_path / "d" / "a.txt"))).first()) == (2, 1, 12)


def test_change_log(spark, tmp_path):
    log = [("created", "a", None, 1), ("created", "b", None, 2), ("renamed", "a", "c", 3), ("deleted", "b", None, 4), ("modified", "d", None, 5)]
    d = spark.createDataFrame(log, "kind string, path string, new_path string, seq long")
    flat = changelog.split_renames(d)
    state = changelog.latest_state(flat, "path", "seq", "kind = 'deleted'")
    assert sorted(r.path for r in state.collect()) == ["c", "d"]
    table = changelog.StateTable(spark, str(tmp_path / "state"), "path", "seq", "kind = 'deleted'")
    source = tmp_path / "source"
    for n, part in enumerate((flat.where("seq < 3"), flat.where("seq >= 3"))):
        part.coalesce(1).write.mode("append").parquet(str(source))
        changelog.run_stream(spark.readStream.schema(flat.schema).parquet(str(source)), lambda b, i, n=n: table.merge(b, n), str(tmp_path / "ck"))
    assert sorted(r.path for r in table.current().collect()) == ["c", "d"]
    found = spark.createDataFrame([("c", 1), ("x", 1)], "path string, v int")
    old = spark.createDataFrame([("c", 2), ("d", 1)], "path string, v int")
    assert {r.path: r.action for r in changelog.rescan_diff(old, found, "path", "v").collect()} == {"c": "update", "d": "delete", "x": "insert"}
    assert changelog.latest_generation(spark.createDataFrame([(1, "a"), (2, "b")], "g int, x string"), "g").count() == 1
    assert changelog.needs_compaction(state, "false").first().compact is False
    waves = []
    changelog.progressive_search(found, found, lambda name, df: waves.append((name, df.count())))
    assert waves == [("names", 2), ("contents", 2), ("complete", 0)]


def test_cli(spark, sales, tmp_path, capsys):
    from tessera.cli import main

    write_text(tmp_path, "sales.csv", "id,amount\n1,50\n2,150\n")
    assert main([str(tmp_path), "-e", "select count(*) n from sales", "--format", "csv"], spark) == 0
    assert capsys.readouterr().out == "n\n2\n"
    assert main([str(tmp_path), "-e", ".tables", "--format", "csv"], spark) == 0
    assert main([str(tmp_path), "-e", ".describe sales", "--format", "jsonl"], spark) == 0
    assert main([str(tmp_path), "-e", "select nothing from nowhere"], spark) == 1
    assert "error" in capsys.readouterr().err
    assert main([str(tmp_path), "-e", "select * from sales", "-o", str(tmp_path / "o.json"), "--format", "json"], spark) == 0


def test_cli_commands(spark, tmp_path, capsys):
    from tessera.cli import Shell, main, statements

    write_text(tmp_path, "sales.csv", "id,amount\n1,50\n2,150\n")
    assert list(statements(".timer on\nselect ';' a;\nselect 1\n; .x")) == [".timer on", "select ';' a", "select 1", ".x"]
    shell = Shell(detect.Catalog(spark, str(tmp_path)))
    run = lambda text: list(shell.run(text))
    assert run(".format csv") == ["format csv"] and run("select sum(amount) s from sales") == ["s", "200"]
    assert run(f".save {tmp_path}/out.csv") and (tmp_path / "out.csv").read_text() == "s\n200\n"
    assert run(".timer on") == ["timer on"] and run(".timer") == ["timer off"] and run(".profile off") == ["profile off"]
    assert "select sum(amount)" in run(".history")[0] and "rows" in run(".benchmark")[0] and "plain scan" in run(".comparison")[0]
    write_text(tmp_path, "sales.csv", "id,amount\n1,7\n")
    assert run(".refresh")[0].endswith("tables") and run("select sum(amount) s from sales") == ["s", "7"]
    assert ".benchmark" in run(".help")[0] and run(".clear") == [] and run(".quit") == [] and shell.ended
    for bad in (".format xml", ".save", ".timer maybe", ".nothing"):
        with pytest.raises(ValueError):
            run(bad)
    capsys.readouterr()
    assert main([str(tmp_path), "--cold", "-e", ".format jsonl\nselect 1 a; select 2 b; .quit\nselect 3"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["format jsonl", '{"a": 1}', '{"b": 2}']


def test_state_table_goes_on_after_a_restart(spark, tmp_path):
    rows = lambda *keys: spark.createDataFrame([(k, k, "created") for k in keys], "path long, seq long, kind string")
    new = lambda: changelog.StateTable(spark, str(tmp_path / "s"), "path", "seq", "kind = 'deleted'")
    assert new().version == -1
    new().merge(rows(1, 2), 0)
    new().merge(rows(3), 0)
    new().merge(rows(3), 0)
    assert sorted(r.path for r in new().current().collect()) == [1, 2, 3]
    assert len([x for x in (tmp_path / "s").iterdir() if x.name.startswith("v")]) == 2
    gone = spark.createDataFrame([(1, 9, "deleted")], "path long, seq long, kind string")
    table = new()
    table.merge(gone)
    table.compact(0.5)
    assert spark.read.parquet(f"{tmp_path}/s/v{table.version}").count() == 3
    table.compact(0.2)
    assert spark.read.parquet(f"{tmp_path}/s/v{table.version}").count() == 2


def test_change_events_and_policies(spark, tmp_path):
    d = spark.createDataFrame([("must_rescan", "/a"), ("must_rescan", "/a/b"), ("must_rescan", "/ab"), ("history_done", None), ("created", "/c")], "kind string, path string")
    assert sorted(r.path for r in changelog.rescan_roots(d).collect()) == ["/a", "/ab"]
    policy = changelog.FlushPolicy()
    assert [policy.due(*x) for x in ((999, 29.9), (1000, 0), (0, 30))] == [False, True, True] and policy.trigger() == {"processingTime": "30 seconds"}
    assert [changelog.resume(*x) for x in ((0, 5), (6, 5), (5, 5))] == ["none", "regression", "valid"]
    with changelog.cancellable(spark, "one") as cancel:
        assert spark.range(5).count() == 5
        cancel()
    assert spark.range(5).count() == 5
    (tmp_path / "in").mkdir()
    for i in range(3):
        write_text(tmp_path / "in", f"f{i}.txt", f"x fn y\n{'fn ' * i}")
    found = []
    changelog.search_stream(spark, str(tmp_path / "in"), "fn", lambda batch, n: found.extend(batch.collect()), str(tmp_path / "ck"), files=1)
    assert sorted((r.path[-6:], r.line, r.column) for r in found) == [("f0.txt", 1, 2), ("f1.txt", 1, 2), ("f1.txt", 2, 0), ("f2.txt", 1, 2), ("f2.txt", 2, 0), ("f2.txt", 2, 3)]


def test_unsigned_order_and_comparisons(spark):
    values = [0, 1, 500, (1 << 63) - 1, 1 << 63, (1 << 63) + 7, (1 << 64) - 1]
    d = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, str(v)) for v in values[::-1]], "x long, name string")
    assert [r.name for r in d.orderBy(*ordering.unsigned_order(F.col("x"))).collect()] == [str(v) for v in values]
    import operator

    for op, test in {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}.items():
        for v in values:
            got = {int(r.name) for r in d.where(predicates.compare_unsigned(F.col("x"), op, v)).collect()}
            assert got == {x for x in values if test(x, v)}, (op, v)


def test_ignore_files(spark, tmp_path):
    root = tmp_path / "r"
    for f in ("a.log", "keep.log", "src/b.log", "src/build/x.o", "build/y.o", "src/main.rs", "docs/a/b/c.md", "docs/c.md", "sub/only.txt", "sub/deep/only.txt", "x#y", "sub/deep/z.tmp"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("text")
    (root / ".gitignore").write_text("# comment\n*.log\n!keep.log\nbuild/\ndocs/**/c.md\n")
    (root / "sub" / ".gitignore").write_text("/only.txt\n*.t[a-m]p\n")
    left = files.drop_ignored(spark, files.walk(spark, str(root)).select("path"), str(root))
    assert sorted(r.path.split("/r/")[1] for r in left.collect()) == ["keep.log", "src/main.rs", "sub/deep/only.txt", "x#y"]


def test_snapshots_and_knowledge(spark, sales, tmp_path):
    from tessera.operators.knowledge import KnowledgeBase
    from tessera.sources import shared

    shared.save_snapshot(sales, f"{tmp_path}/snap")
    assert shared.load_snapshot(spark, f"{tmp_path}/snap").count() == 10
    sales.limit(1).write.mode("append").parquet(f"{tmp_path}/snap/rows")
    with pytest.raises(ValueError):
        shared.load_snapshot(spark, f"{tmp_path}/snap")
    kb = KnowledgeBase(spark, f"{tmp_path}/kb")
    kb.insert("skills", name="silicon", layer=0, title="Silicon")
    first = kb.add("silicon", "Caches", "lines are long", source_type="blog_post", confidence="verified", source_url="http://x")
    kb.add("silicon", "Caches", "lines are long", source_url="http://x")
    kb.add("silicon", "Tiles", "a paper", source_type="academic_paper", source_url="http://reddit.com/r")
    kb.add("silicon", "Speed", "measured", source_type="benchmark")
    with pytest.raises(ValueError):
        kb.add("nothing", "x", "y")
    kb.cite(first, "A. Uthor", "T", "V", 2024)
    run = kb.log_start("silicon", "Caches")
    kb.log_end(run, 3, 2, "done")
    assert [(r.status, r.findings_added) for r in kb.investigations().collect()] == [("completed", 2)]
    assert [r.topic for r in kb.skill("silicon").collect()] == ["Caches", "Caches", "Speed", "Tiles"]
    assert kb.topic("cache").count() == 2
    finding, cites = kb.detail(first)
    assert (finding.first().skill, cites.first().title) == ("silicon", "T")
    counts, rows = kb.missing_urls()
    assert [(r.source_type, r.n) for r in counts.collect()] == [("benchmark", 1)] and rows.first().claim == "measured"
    assert {r.check_name: r.n for r in kb.verify().collect()} == {
        "inflated_confidence": 1, "unverified_authors": 1, "near_duplicates": 1, "encyclopedia_as_blog": 0, "forum_miscategorised": 1,
        "no_url": 0, "no_local_path": 1, "stale_investigations": 0, "uncited_papers": 1,
    }
