"""Toxicity scores: subword-bag embeddings under a linear softmax, trained in numpy.

A text is a bag of hashed features: every lower-cased word, and every run of 3 to 5
characters of ``<word>`` with its end marks. Each feature has an embedding, a document is
the mean of its embeddings, and a two-class softmax reads the mean; embeddings and
softmax are trained jointly by Adam in one worker. Unseen misspellings share most of
their character runs with the words they come from. For scoring, embedding and softmax
fold into one number for each hashed feature (a table of fixed size), so executors add up numbers over
whole texts.

Training reads at most ``per_class`` labelled documents of each class (a documented
bound on the classifier's sample, chosen by a hash of the id); weights restore the
classes' true shares. Every document is scored, over its whole text.

Defined results: a null text scores like an empty one (the intercept alone); a null
doc_id counts as text "" for the fold and is scored; labels with null doc_id or null
toxic are not learned from; of texts that share an id the smallest is learned; without
texts of both classes every score is the share of class 1 among the labels, 0.49 at most,
so that nothing is rejected on no evidence; repeated rows are scored one by one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

GRAMS = (3, 4, 5)
BITS = 18
DIM = 4
#: Features of fewer training documents are not learned: they could only memorise.
LEAST_DOCS = 5
DECAY = 1e-5
STEPS = 400
#: A mean over thousands of features is small; this scale keeps its gradient usable.
SCALE = 30.0
_CODE = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


class Characters:
    """Characters of some texts, lower-cased, in one array, each text between separators."""

    def __init__(self, texts: list[str]):
        low = [(t or "").lower() for t in texts]
        codes = np.frombuffer((" " + "".join(t + " " for t in low)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        #: text r is at bounds[r] to bounds[r + 1] - 1
        self.bounds = np.cumsum([1, *(len(t) + 1 for t in low)])
        gap = (codes == 32) | ((codes >= 9) & (codes <= 13))
        self.n, self.gap = len(codes), gap
        self.code = (np.where(gap, np.uint32(32), codes).astype(np.uint64) + np.uint64(1)) * _CODE
        self.gaps = np.zeros(self.n + 1, dtype=np.int32)
        np.cumsum(gap, out=self.gaps[1:])

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, bucket) of each kind of feature: character runs by length, then words."""
        h = self.code
        for size in range(2, max(GRAMS) + 1):
            if self.n < size:
                break
            h = h[:-1] * _ROLL + self.code[size - 1 :]
            if size in GRAMS:
                n = self.n - size + 1
                at = np.flatnonzero(self.gaps[size - 1 : size - 1 + n] == self.gaps[1 : 1 + n])
                yield at, _bucket(h[at] + np.uint64(size))
        edge = np.diff(self.gap.astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        p, inv = C.powers(int(_ROLL), self.n + 1)
        total = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(self.code * p[: self.n], out=total[1:])
        yield starts, _bucket((total[ends] - total[starts]) * inv[starts])


def score_texts(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 for each text."""
    c = Characters(texts)
    total = np.zeros(c.n + 1)
    count = np.zeros(c.n + 1, dtype=np.int64)
    sums, counts = np.zeros(c.n), np.zeros(c.n, dtype=np.int32)
    for at, bucket in c.features():
        sums[at] += table[bucket]
        counts[at] += 1
    np.cumsum(sums, out=total[1:])
    np.cumsum(counts, out=count[1:])
    # a run that starts at the separator before a text belongs to that text
    lo, hi = c.bounds[:-1] - 1, c.bounds[1:] - 1
    mean = (total[hi] - total[lo]) / np.maximum(count[hi] - count[lo], 1)
    return 1.0 / (1.0 + np.exp(-np.clip(SCALE * mean + bias, -60, 60)))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int | None = None, batch: int = 64, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train embeddings and softmax jointly; returns the folded table and the intercept."""
    rng = np.random.default_rng(seed)
    # about STEPS updates at any size of the sample, and eight passes at least
    epochs = epochs or max(8, -(-STEPS * batch // max(len(texts), 1)))
    bags = []
    for t in texts:
        got = [b for _, b in Characters([t]).features()]
        ids, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.int32), return_counts=True)
        bags.append((ids.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)))
    size = 1 << BITS
    in_docs = np.zeros(size, dtype=np.int64)
    for ids, _ in bags:
        in_docs[ids] += 1
    known = in_docs >= min(LEAST_DOCS, len(texts))
    for k, (ids, share) in enumerate(bags):  # one by one, so that memory holds them once
        bags[k] = ids[known[ids]], share[known[ids]]
    emb = rng.normal(0, 0.1, (DIM, size)).astype(np.float32)
    soft = rng.normal(0, 0.1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, soft, bias)]
    step = 0
    for epoch in range(epochs):
        rate = 0.05 * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            step += 1
            chosen = order[lo : lo + batch]
            ids = np.concatenate([bags[k][0] for k in chosen])
            share = np.concatenate([bags[k][1] for k in chosen])
            doc = np.repeat(np.arange(len(chosen)), [len(bags[k][0]) for k in chosen])
            mean = np.stack([np.bincount(doc, emb[d][ids] * share, len(chosen)) for d in range(DIM)], axis=1) * SCALE
            z = mean @ soft.T + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p *= (weights[chosen] / len(chosen))[:, None]
            into = (p @ soft) * SCALE
            grads = [
                np.stack([np.bincount(ids, into[doc, d] * share, size) for d in range(DIM)]),
                p.T @ mean,
                p.sum(axis=0),
            ]
            grads[0] += DECAY * emb
            for x, g, (m, v) in zip((emb, soft, bias), grads, moments, strict=True):
                g = g.astype(np.float32)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    difference = soft[1] - soft[0]
    return np.where(known, difference @ emb, 0).astype(np.float32), float(bias[1] - bias[0])


def fold(doc_id):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def untrained(totals: dict[int, int]) -> tuple[np.ndarray, float]:
    """Without texts of both classes nothing tells them apart: every text scores the share of
    class 1 among the labels, but below one half, so that none is rejected on no evidence."""
    share = min(max(totals.get(1, 0) / max(sum(totals.values()), 1), 1e-6), 0.49)
    return np.zeros(1 << BITS, dtype=np.float32), float(np.log(share / (1 - share)))


def _learn(rows: pa.Table, totals: dict[int, int]) -> tuple[np.ndarray, float] | None:
    """Train on the sample's doc_id, toxic, text; None without texts of both classes."""
    rows = rows.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    y = rows["toxic"].to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return None
    have = np.maximum(np.bincount(y, minlength=2), 1)
    weight = np.array([totals[0], totals[1]]) / have
    w = weight[y]
    return train(rows["text"].to_pylist(), y, (w / w.mean()).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled rows outside fold 0."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(fold(F.col("doc_id")) != 0)
        .distinct()
    )
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return untrained(totals)
    picked = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_column().alias("text"))
    # at most 2 * per_class ids: a proven bound, so broadcast
    # of texts that share an id the smallest is learned
    once = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return C.on_one_worker(once, partial(_learn, totals=totals)) or untrained(totals)


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for batch in batches:
            column = batch.column("text")
            offsets, _ = C.string_buffers(column)
            out = [score_texts(column.slice(i, j - i).to_pylist(), table, bias) for i, j in C.slices(offsets)]
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(scores)], names=[*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; no shuffle of texts."""
    spark = docs.sparkSession
    C.ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, per_class))  # 2 ** BITS floats: 1 MB
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), C.text_column().alias("text"))
    scored = base.mapInArrow(_score_rows(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all their columns unchanged, whose score is below the threshold."""
    spark = docs.sparkSession
    C.ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for batch in batches:
            column = batch.column("text")
            offsets, _ = C.string_buffers(column)
            out = [score_texts(column.slice(i, j - i).to_pylist(), table, bias) for i, j in C.slices(offsets)]
            if out:
                yield batch.filter(pa.array(np.concatenate(out) < threshold))

    return docs.mapInArrow(run, schema)
