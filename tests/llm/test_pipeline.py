"""The pipeline: every stage's decisions on planted cases."""

import os
import random
import shutil

import pytest

import corpus_pipeline
from tessera.llm.common import Stash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    path = str(tmp_path_factory.mktemp("sf"))
    syllables = ["an", "er", "tion", "the", "in", "on", "re", "ha", "nd", "st", "lo", "mi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    text = lambda n: [word() for _ in range(n)]
    docs, labels, kind = [], [], {}
    for i in range(240):
        words = text(rng.randrange(60, 160))
        if i % 6 == 0:
            for _ in range(8):
                words[rng.randrange(len(words))] = rng.choice(["disgusting", "worthless", "pathetic"])
            kind[i] = "toxic"
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    clean = [d for d in docs if d[0] not in kind]
    items = [(k, " ".join(text(40))) for k in range(5)]
    for k in range(8):
        source = clean[k][1].split()
        docs.append((1000 + k, " ".join(source), "en", "s", 0))
        source[-1] = "altered"
        docs.append((1100 + k, "\n".join(source), "en", "s", 0))
        kind[1000 + k] = kind[1100 + k] = "copy"
        docs.append((1200 + k, " ".join([*text(30), items[k % 5][1], *text(30)]), "en", "s", 0))
        kind[1200 + k] = "benchmark"
        docs.append((1300 + k, " ".join([*text(40), f"me{k}@mail.example.com and 10.1.{k}.9 or +1 (212) 555-01{k}0", *text(40)]), "en", "s", 0))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    yield path, docs, kind
    shutil.rmtree(path, ignore_errors=True)


def test_stages(spark, folder):
    path, docs, kind = folder
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = Stash(stage(spark, now, path)).df
        assert now.columns == columns
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    everything = {d[0] for d in docs}
    toxic, copies, bad = ({i for i, k in kind.items() if k == x} for x in ("toxic", "copy", "benchmark"))
    gone = everything - set(kept["toxicity"])
    assert gone <= toxic and len(gone) > 0.7 * len(toxic)
    # one of the two empty texts goes as a copy
    assert set(kept["toxicity"]) - set(kept["simhash_near_dedup"]) == copies | {2001}
    assert set(kept["simhash_near_dedup"]) - set(kept["benchmark_decontamination"]) == bad
    assert set(kept["pii"]) == set(kept["benchmark_decontamination"])
    texts = {d[0]: d[1] for d in docs}
    for i, t in kept["pii"].items():
        assert "@" not in (t or "") and "555-" not in (t or "")
        assert i >= 1300 or t == texts[i]
    last = corpus_pipeline.STAGES[-1][1](spark, now, path).collect()
    assert {r.doc_id for r in last} == set(kept["pii"]) and all(r.round_trip and r.n_pieces == len(r.ids) for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()} == set(kept["pii"])


def test_empty_table(spark, folder):
    path, _, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_queries_are_registered(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in found if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in found
