"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words of one document. A word is removed if a
window that covers it also starts, word for word, in a document with a smaller doc_id.

Method: let D be a difference cover modulo p. For any two starts i, j there is a shift
below p that moves both onto positions in D modulo p. So two equal windows contain equal
*anchors*, runs of ``window - p + 1`` words at such a common shift, and it is enough to
hash anchors at positions in D modulo p (6 of 31 positions here). Anchors found in two
documents are extended: only windows that contain such an anchor are hashed whole, to
96 bits, and compared.

Defined results: a null text has no words; a null doc_id takes part in no comparison and
its document is kept whole; rows that repeat a doc_id are treated one by one, and equal
ids are not smaller; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Perfect difference sets: every residue modulo the period is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def _period(window: int) -> int:
    fit = [p for p in COVERS if p <= 2 * window // 3]
    return max(fit) if fit else 0


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _anchor_rows(window: int):
    period = _period(window)
    on = np.zeros(max(period, 1), dtype=bool)
    on[list(COVERS.get(period, (0,)))] = True
    size = window - max(period, 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = C.string_buffers(batch.column("text"))
            for i, j in C.slices(offsets):
                w = C.Words(offsets[i : j + 1], raw)
                hashed = C.window_hashes(w.hashes(), size)
                at = np.arange(len(hashed))
                row = C.rows_of(w.first, at)
                local = at - w.first[row]
                long_enough = w.first[row + 1] - w.first[row] >= window
                keep = on[local % len(on)] & (at + size <= w.first[row + 1]) & long_enough
                row, local, hashed = row[keep], local[keep], hashed[keep]
                counts = np.bincount(row, minlength=j - i)
                has = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i).filter(pa.array(has)),
                        batch.column("row_hash").slice(i, j - i).filter(pa.array(has)),
                        _lists(local.astype(np.int32), counts[has], pa.int32()),
                        _lists(hashed.view(np.int64), counts[has], pa.int64()),
                    ],
                    names=["doc_id", "row_hash", "pos", "h"],
                )

    return run


def _window_rows(window: int):
    reach = max(_period(window), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = C.string_buffers(batch.column("text"))
            lists = batch.column("pos")
            for i, j in C.slices(offsets):
                w = C.Words(offsets[i : j + 1], raw)
                part = lists.slice(i, j - i)
                anchors = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = np.diff(part.offsets.to_numpy())
                base = np.repeat(w.first[:-1], lengths)
                change = np.zeros(len(w) + 2, dtype=np.int64)
                np.add.at(change, np.maximum(base + anchors - reach + 1, base), 1)
                np.add.at(change, base + anchors + 1, -1)
                near = np.cumsum(change)[: max(0, len(w) - window + 1)] > 0
                at = np.flatnonzero(near)
                row = C.rows_of(w.first, at)
                inside = at + window <= w.first[row + 1]
                at, row = at[inside], row[inside]
                h0 = C.window_hashes(w.hashes(0), window, 0)[at]
                h1 = C.window_hashes(w.hashes(1), window, 1)[at]
                counts = np.bincount(row, minlength=j - i)
                has = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i).filter(pa.array(has)),
                        batch.column("row_hash").slice(i, j - i).filter(pa.array(has)),
                        _lists((at - w.first[row]).astype(np.int32), counts[has], pa.int32()),
                        _lists(h0.view(np.int64), counts[has], pa.int64()),
                        _lists((h1 >> np.uint64(32)).astype(np.uint32).view(np.int32), counts[has], pa.int32()),
                    ],
                    names=["doc_id", "row_hash", "start", "h0", "h1"],
                )

    return run


def _kept_rows(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, starts in zip(batch.column("text").cast(pa.large_binary()), batch.column("start"), strict=True):
                words = (text.as_py() or b"").split()  # bytes: splits at exactly these six characters
                n_words.append(len(words))
                starts = starts.values
                if starts is not None and len(starts):
                    change = np.zeros(len(words) + 1, dtype=np.int32)
                    at = np.unique(starts.to_numpy())
                    change[at] += 1
                    change[at + window] -= 1
                    stays = np.cumsum(change[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(stays)]
                n_removed.append(n_words[-1] - len(words))
                joined = b" ".join(words)
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined)
            out = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
            if with_text:
                out["kept_text"] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Shuffles hashed anchors (about a fifth of the positions), then only windows around
    anchors that two documents share, and the texts by doc_id. Groups of any size are
    pre-aggregated to their smallest and largest doc_id and written; the joins back on a
    hash are then plain shuffled joins, which adaptive execution splits where a hash is
    frequent, and no two of these shuffles need disk at the same time.
    """
    spark = docs.sparkSession
    C.ship(spark)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        C.text_column().alias("text"),
        F.hash(C.text_column()).alias("row_hash"),
    )
    known = base.where("doc_id is not null")

    anchors = C.Stash(known.mapInArrow(_anchor_rows(window), "doc_id long, row_hash int, pos array<int>, h array<long>"))
    each = anchors.df.select("doc_id", "row_hash", F.explode(F.arrays_zip("pos", "h")).alias("x"))
    each = each.select("doc_id", "row_hash", "x.pos", "x.h")
    shared = C.Stash(each.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"))
    C.release(spark)
    near = C.cut(each.join(shared.df, "h").groupBy("doc_id", "row_hash").agg(F.collect_list("pos").alias("pos")))
    anchors.drop()
    shared.drop()
    C.release(spark)

    windows = C.Stash(
        known.join(near.hint("shuffle_hash"), ["doc_id", "row_hash"])
        .select("doc_id", "row_hash", "text", "pos")
        .mapInArrow(_window_rows(window), "doc_id long, row_hash int, start array<int>, h0 array<long>, h1 array<int>")
    )
    C.release(spark)
    each = windows.df.select("doc_id", "row_hash", F.explode(F.arrays_zip("start", "h0", "h1")).alias("x"))
    each = each.select("doc_id", "row_hash", "x.start", "x.h0", "x.h1")
    first = C.Stash(each.groupBy("h0", "h1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"))
    C.release(spark)
    again = each.join(first.df, ["h0", "h1"]).where("doc_id > lo")
    removed = C.cut(again.groupBy("doc_id", "row_hash").agg(F.collect_list("start").alias("start")))
    windows.drop()
    first.drop()
    C.release(spark)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return (
        base.join(removed.hint("shuffle_hash"), ["doc_id", "row_hash"], "left")
        .select("doc_id", "text", "start")
        .mapInArrow(_kept_rows(window, with_text), schema)
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), lowest AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s
), hit AS (
  SELECT DISTINCT doc_id, i FROM win JOIN lowest USING (s) WHERE m < doc_id
), cov AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN cov USING (doc_id, k) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
