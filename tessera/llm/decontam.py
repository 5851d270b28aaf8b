"""Benchmark decontamination: SimHash of item-sized windows, verified exactly.

Texts are lower-cased (A-Z), cut into words, and into 5-word shingles (fewer words: the
whole sequence). A document holds an item if some window with as many words as the item
has weighted shingle similarity (sum of smaller counts over sum of larger counts) of at
least ``similarity``. A document with fewer words than the item is one window.

Method: every item gets a 64-bit SimHash of its shingles, and so does every item-sized
window of a document, unless too few of its shingles belong to any item of that size for
the similarity to be reached. For each size of items a multi-index of Hamming blocks
(``radius + 1`` parts, of which two fingerprints within the radius share one) yields the
candidate items of a window's fingerprint among all items of the size; those within the
radius are verified by exact weighted-shingle similarity.

The radius follows from the size: a bit of a pair of the least similarity differs with a
probability that is largest for few shingles (``bit_differs``), and the radius leaves out
under one pair in a million (``radius_for``): 29 bits for items of five shingles, 26 for
most others; items that repeat a shingle, whose votes have weights, take 38.

Items are read in blocks of bounded size (``BLOCK`` bytes of text), so a benchmark of any
size is one stated query set against all rows; documents are scanned without a shuffle.

Defined results: null or empty items and items without a word match nothing; a null text
is empty; doc_id may be null or repeated; items that repeat an id are separate rows of
the result where their texts differ; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SHINGLE = 5
#: Share of true pairs that a radius may leave out.
MISS = 1e-6
#: Probability that a bit differs where shingles repeat and votes have weights (at most).
WEIGHTED = 0.3
#: Bytes of benchmark text held by a worker at once.
BLOCK = 16_000_000
#: Windows fingerprinted in one go.
RUN = 4096
#: (window, item) candidates looked at in one go.
PAIRS = 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of one text's word hashes."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return C.window_hashes(words, min(SHINGLE, len(words)))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the bits of each hash, (n, 64)."""
    h = C.mix(hashes * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _pack(total: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of summed votes (n, 64)."""
    return np.packbits(total > 0, axis=1, bitorder="little").view("<u8").ravel()


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles."""
    total = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(_bits(hashes), axis=0, out=total[1:])
    return _pack(total[size:] - total[:-size])


def similarity_of(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    both = sum(min(n, b[s]) for s, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


@lru_cache(maxsize=None)
def bit_differs(width: int, least: float) -> float:
    """Largest probability that a SimHash bit differs between an item of ``width`` shingles and
    a window of as many or fewer, of at least this similarity (shingles' bits are fair coins)."""
    worst = 0.0
    for both in range(math.ceil(least * width - 1e-9), width + 1):
        own = width - both
        for other in range(own + 1):
            if both < least * (both + own + other) - 1e-9:
                break
            p = 0.0
            for c in range(both + 1):
                a, b = (sum(math.comb(n, k) for k in range(n + 1) if 2 * (c + k) > both + n) / 2**n for n in (own, other))
                p += math.comb(both, c) / 2**both * (a * (1 - b) + (1 - a) * b)
            worst = max(worst, p)
    return worst


def angle_differs(least: float) -> float:
    """The limit for many shingles, by the angle of the two sums of votes, rounded up."""
    return math.acos(2 * least / (1 + least)) / math.pi + 0.01


@lru_cache(maxsize=None)
def radius_for(width: int, least: float, weighted: bool) -> int:
    """The radius that leaves out a share of ``MISS`` of the pairs at most."""
    p, beyond, r = WEIGHTED if weighted else max(bit_differs(min(width, 60), least), angle_differs(least)), 1.0, -1
    while beyond > MISS and r < 64:
        r += 1
        beyond -= math.comb(64, r) * p**r * (1 - p) ** (64 - r)
    return r


class HammingIndex:
    """Fingerprints in blocks by each of radius + 1 parts of their bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints.astype(np.uint64), radius
        edges = np.linspace(0, 64, min(radius + 1, 64) + 1).astype(int)
        self.parts = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        #: for each part the members in order of their bits there, and these bits
        self.blocks = []
        for shift, mask in self.parts:
            bits = self.prints >> shift & mask
            order = np.argsort(bits, kind="stable")
            self.blocks.append((order, bits[order]))

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs that share a block, once each."""
        keys = []
        for (shift, mask), (order, bits) in zip(self.parts, self.blocks, strict=True):
            wanted = queries >> shift & mask
            lo, hi = np.searchsorted(bits, wanted), np.searchsorted(bits, wanted, side="right")
            n = hi - lo
            query = np.repeat(np.arange(len(queries)), n)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            keys.append(query * len(self.prints) + order[place])
        key = np.unique(np.concatenate(keys))
        return key // len(self.prints), key % len(self.prints)

    def near(self, fingerprint: int, among: set[int]) -> list[int]:
        """Members of ``among`` within the radius of one fingerprint."""
        found = [k for _, members in self.within(np.array([fingerprint], dtype=np.uint64)) for k in members.tolist()]
        return [k for k in found if k in among]

    def within(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) pairs within the radius, in parts of bounded size."""
        step = max(1, PAIRS // max(len(self.prints) * len(self.parts), 1))
        for lo in range(0, len(queries), step):
            q, k = self.candidates(queries[lo : lo + step])
            ok = np.bitwise_count(queries[lo + q] ^ self.prints[k]) <= self.radius
            yield lo + q[ok], k[ok]


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str], least: float):
        offsets, raw = C.string_buffers(pa.array(texts, pa.large_string()))
        w = C.Words(offsets, _lowered(raw))
        hashes = w.hashes()
        self.ids, self.bags, self.least = [], [], least
        prints, by_size, sizes = [], defaultdict(list), defaultdict(set)
        for k in range(len(texts)):
            words = hashes[w.first[k] : w.first[k + 1]]
            if not len(words):
                continue
            s = _shingles(words)
            for h in s.tolist():
                sizes[h].add(len(words))
            by_size[len(words)].append(len(self.ids))
            self.ids.append(ids[k])
            self.bags.append(Counter(s.tolist()))
            prints.append(simhashes(s, len(s))[0])
        #: sizes in words of the items that have a shingle
        self.sizes = {h: sorted(found) for h, found in sizes.items()}
        # shingles of a short item are its whole text: they are found by their own size
        self.known = {n: np.sort(np.array([h for h, found in self.sizes.items() if any(min(SHINGLE, m) == n for m in found)], dtype=np.uint64)) for n in sorted({min(SHINGLE, m) for m in by_size})}
        #: for each size its items and the index of their fingerprints
        self.index = {}
        for m, members in by_size.items():
            weighted = any(max(self.bags[k].values()) > 1 for k in members)
            index = HammingIndex(np.array([prints[k] for k in members], dtype=np.uint64), radius_for(m - min(SHINGLE, m) + 1, least, weighted))
            self.index[m] = (members, index)

    def search(self, w: C.Words, hashes: np.ndarray, row: int, hits: dict[int, np.ndarray]) -> Iterator[tuple[int, int, float]]:
        """(item, first word of the best window, similarity) in one document."""
        words = hashes[w.first[row] : w.first[row + 1]]
        for n, at in hits.items():
            shingles = C.window_hashes(words, n)
            spots = defaultdict(list)
            for p in at.tolist():
                for m in self.sizes[int(shingles[p])]:
                    if min(SHINGLE, m) == n:
                        spots[m].append(p)
            for m, places in spots.items():
                yield from self._search_size(m, np.array(places), shingles, len(words), n)

    def _search_size(self, m: int, places: np.ndarray, shingles: np.ndarray, n_words: int, n: int) -> Iterator[tuple[int, int, float]]:
        """Items of ``m`` words; ``places`` are the shingles that any of them has."""
        members, index = self.index[m]
        item_width = m - n + 1
        width = min(item_width, n_words - n + 1)  # a shorter document is its one window
        # similarity s of bags of these sizes takes so many common shingles
        need = max(1, math.ceil(self.least * (width + item_width) / (1 + self.least) - 1e-9))
        if len(places) < need:
            return
        lo = np.maximum(places[need - 1 :] - width + 1, 0)
        hi = np.minimum(places[: len(places) - need + 1], len(shingles) - width)
        best: dict[int, tuple[float, int]] = {}
        for a, b in _runs(lo, hi):
            starts, queries = np.arange(a, b), simhashes(shingles[a : b + width - 1], width)
            for q, k in index.within(queries):
                for at, item in zip(starts[q].tolist(), k.tolist(), strict=True):
                    got = similarity_of(Counter(shingles[at : at + width].tolist()), self.bags[members[item]])
                    if got >= self.least and (item not in best or got > best[item][0]):
                        best[item] = (got, at)
        for item, (got, at) in best.items():
            yield members[item], at, got


def _runs(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int]]:
    """The union of the intervals [lo, hi] (both ascending) in pieces of at most RUN starts."""
    a = b = 0
    for x, y in zip(lo.tolist(), (hi + 1).tolist(), strict=True):
        x = max(x, b)
        if x >= y:
            continue
        if x > b or y - a > RUN:
            if b > a:
                yield a, b
            a = x
        b = y
        while b - a > RUN:
            yield a, a + RUN
            a += RUN
    if b > a:
        yield a, b


def _hits(items: Items, w: C.Words, hashes: np.ndarray) -> dict[int, dict[int, np.ndarray]]:
    """For each row the positions (within it) of shingles that some item has."""
    found: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    for n, known in items.known.items():
        if not len(known):
            continue
        s = C.window_hashes(hashes, n)
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s)
        row = C.rows_of(w.first, at)
        inside = at + n <= w.first[row + 1]
        at, row = at[inside], row[inside]
        for r in np.unique(row).tolist():
            found[r][n] = at[row == r] - w.first[r] if len(at) < 1000 else at[np.searchsorted(row, r) : np.searchsorted(row, r, side="right")] - w.first[r]
    return found


def _matches(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, int, int, float]]:
    """(row of the batch, item, start, similarity)."""
    offsets, raw = C.string_buffers(batch.column("text"))
    for i, j in C.slices(offsets):
        part = C.Words(offsets[i : j + 1], raw)
        part.data = _lowered(part.data)
        hashes = part.hashes()
        for row, hits in _hits(items, part, hashes).items():
            for k, start, got in items.search(part, hashes, row, hits):
                yield i + row, k, start, got


def _blocks(benchmark: DataFrame, limit: int, least: float) -> Iterator[Items]:
    """The items in blocks of about ``limit`` bytes; only one block is on the driver at a time."""
    base = benchmark.select("item_id", C.text_column().alias("text")).where("text <> ''").dropDuplicates(["item_id", "text"])
    size = base.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = -(-size // limit)
    for k in range(n):
        part = base if n == 1 else base.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        rows = part.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield Items(rows["item_id"].to_pylist(), rows["text"].to_pylist(), least)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start (first word of the best window), similarity: one row for each
    document row and item found in it."""
    spark = docs.sparkSession
    C.ship(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_column().alias("text"))
    schema = "doc_id long, item_id long, start long, similarity double"
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, block, similarity):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_matches(batch, shared.value))
                rows = pa.array([f[0] for f in found], pa.int64())
                ids = [shared.value.ids[f[1]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), pa.array(ids, pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64())],
                    names=["doc_id", "item_id", "start", "similarity"],
                )

        out = out.unionByName(base.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """The documents, all columns unchanged, that hold no item."""
    spark = docs.sparkSession
    C.ship(spark)
    schema = docs.schema
    for items in _blocks(benchmark, block, similarity):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, dtype=bool)
                for row, *_ in _matches(batch, shared.value):
                    stays[row] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, schema)
    return docs
