"""Results that hold every row, text and dimension of their tables."""

import math

from tessera.plans import catalogue


def test_kb_export_all_holds_every_text(spark, tmp_path):
    rows = [(i, f"s{i % 2}", f"text {i} " + "long " * 20 + "end") for i in range(230)] + [(900, "s0", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.chunk): r.listing for r in catalogue.QUERIES["kb_export_all"](spark, str(tmp_path)).collect()}
    want = {}
    for i, source, text in rows[:-1]:
        want.setdefault((source, i // 100), []).append(f"{i}: {text}")
    assert {k: v for k, v in got.items() if k[1] < 9} == {k: "\n".join(v) for k, v in want.items()}


def test_attention_all_has_every_dimension(spark, tmp_path):
    rows = [(i, i % 3, [math.sin(i * 7 + d) for d in range(9)]) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got = {(r.q_id, r.d): r.y for r in catalogue.QUERIES["attention_all"](spark, str(tmp_path)).collect()}
    keys = [v for i, v in data if i < 3]
    assert len(got) == 12 * 9
    for i, q in data:
        w = [math.exp(sum(a * b for a, b in zip(q, k, strict=True)) / 3) for k in keys]
        for d in range(9):
            assert abs(got[i, d] - sum(x * k[d] for x, k in zip(w, keys, strict=True)) / sum(w)) < 2e-6
