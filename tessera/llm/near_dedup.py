"""Near-dedup of documents by SimHash, verified on 5-word shingles.

Two texts are near copies if the Jaccard similarity of their sets of word shingles is at
least ``similarity``; groups are the transitive closure, and one document of each stays,
the one with the smallest doc_id.

Texts with one set of shingles are one node. Each node has a 64-bit SimHash of its
shingles and ``KEYS`` block keys, each of two min-hashes of the shingles: a pair of
similarity 0.8 shares no key with probability 0.36 ** 12, under one in 100,000. Within a
block the bit-sliced comparison of ``simhash`` finds the pairs within ``RADIUS`` bits. A bit
of a pair of similarity 0.8 differs with probability 0.1875 at most, for 4 of 5 shingles
(0.1514 for long texts); more than 27 of 64 do with probability under 3.9e-6, less than the
keys lose, so very short texts need no path of their own. In a first
round every node keeps its nearest neighbour on either side and its first one, and these
links are verified exactly; a block with more than ``BLOCK`` nodes is dealt into salted
parts for it. The second round loses none of the other pairs:

* In a block of at most ``BLOCK`` nodes every pair that is not yet joined is verified on the
  shingles themselves, unless a link found earlier in the block has joined it.
* Nodes of larger blocks meet again by rare shingles. In any order of all shingles, two sets
  of similarity s share one of their first n - ceil(s n) + 1. Shingles are ordered by counts
  of a hash of fixed size (``COUNTS``), so those that a whole block shares come last and
  only texts with rare shingles in common meet. Where a rare shingle is shared by more than
  ``BLOCK`` nodes that are not all joined, each part of them meets itself and every other.

Defined results: a null text is empty, and texts without a word are copies of each other;
a null doc_id comes after all others; of repeated rows one stays; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import simhash as S

KEYS = 12
RADIUS = 27
BLOCK = 1024
#: Buckets of the shingle counts that order rare shingles first: half a MB at any input size.
COUNTS = 1 << 16
#: Shingles of groups that are verified in one go.
VALUES = 1 << 21
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, size=(2 * KEYS, 2), dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted; a shorter text is one shingle."""
    w = C.Words(offsets, raw)
    w.data = _LOWER[w.data]
    hashes = w.hashes()
    count = np.diff(w.first)
    s = C.window_hashes(hashes, size)
    at = np.arange(len(s))
    row = C.rows_of(w.first, at)
    inside = at + size <= w.first[row + 1]
    rows, values = [row[inside]], [s[inside]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            rows.append(short)
            values.append(C.window_hashes(hashes, n)[w.first[short]])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _sketch_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = C.string_buffers(batch.column("text"))
            for i, j in C.slices(offsets):
                row, value = shingle_sets(offsets[i : j + 1], raw, size)
                n = j - i
                node, fp, keys, size_ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, KEYS), np.uint64), np.zeros(n, np.int32)
                has, first = np.unique(row, return_index=True)
                if len(has):
                    node[has] = C.mix(np.add.reduceat(C.mix(value), first)).view(np.int64)
                    ends = np.append(first[1:], len(row))
                    size_[has] = ends - first
                    bits = np.unpackbits(value.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                    fp[has] = np.packbits(2 * ones > (ends - first)[:, None], axis=1, bitorder="little").view("<u8").ravel().view(np.int64)
                    least = [np.minimum.reduceat(C.mix((value ^ a) * b), first) for a, b in _SEEDS]
                    for k in range(KEYS):
                        keys[has, k] = C.mix(least[2 * k] * np.uint64(3) + least[2 * k + 1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * KEYS), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), batch.column("row_hash").slice(i, n), pa.array(node), pa.array(fp), pa.array(size_), lists],
                    names=["doc_id", "row_hash", "node", "fp", "size", "keys"],
                )

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = C.string_buffers(batch.column("text"))
            for i, j in C.slices(offsets):
                row, value = shingle_sets(offsets[i : j + 1], raw, size)
                at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                # 32 bits tell the shingles of two texts apart
                values = pa.array((value >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), values)], names=["node", "shingles"])

    return run


def neighbours(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (later, earlier member) of nearest members on either side and first members."""
    n = len(fps)
    near = [np.full(n, radius + 1), np.full(n, radius + 1)]
    who = [np.full(n, -1), np.full(n, -1)]
    first = np.full(n, -1)
    p = S.planes(fps)
    _, size = np.unique(bucket, return_counts=True)
    for shift in range(1, int(size.max(initial=1))):
        same = bucket[shift:] == bucket[:-shift]
        a, distance = S.linked(p, shift, radius, same)
        b = a + shift
        for k, (x, y) in enumerate(((b, a), (a, b))):
            closer = distance < near[k][x]
            near[k][x[closer]] = distance[closer]
            who[k][x[closer]] = y[closer]
        first[b] = a
    me = np.arange(n)
    later = np.concatenate([me[who[0] >= 0], who[1][who[1] >= 0], me[first >= 0]])
    earlier = np.concatenate([who[0][who[0] >= 0], me[who[1] >= 0], first[first >= 0]])
    pairs = np.unique(np.stack([later, earlier], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _link_rows(radius: int):
    names = ("block", "part", "fp", "node")

    def flush(block, part, fp, node) -> pa.RecordBatch:
        bucket = np.cumsum(np.concatenate(([True], (block[1:] != block[:-1]) | (part[1:] != part[:-1]))))
        x, y = neighbours(bucket, fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[x], node[y])), pa.array(np.minimum(node[x], node[y]))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in names))
            total += batch.num_rows
            if total < S.LANES:
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).max(initial=-1)) + 1
            if last:
                yield flush(*(r[:last] for r in rows))
            held, total = [tuple(r[last:] for r in rows)], total - last
        if total:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], weigh, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, rows of a group being next to each other, of about ``limit`` weight."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        held.append(batch)
        total += weigh(batch)
        if total < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        differs = np.zeros(len(table), dtype=bool)
        for c in keys:
            x = table[c].to_numpy()
            differs |= x != x[-1]
        last = int(np.flatnonzero(differs).max(initial=-1)) + 1
        if last:
            yield table.slice(0, last).combine_chunks().to_batches()[0]
        held = table.slice(last).combine_chunks().to_batches()
        total = sum(weigh(b) for b in held)
    if total:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bounds(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """First row of each group, and the end."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for c in keys:
        x = batch.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9


_GROUP = ("block", "part")


def _open_rows(radius: int, similarity: float):
    """Members that have a pair left to verify; in a group of two parts only pairs across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, _GROUP, lambda b: b.num_rows, S.LANES):
            bounds = _bounds(batch, _GROUP)
            bucket = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            fp, root, size, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "root", "size", "side"))
            alone = (np.minimum.reduceat(side, bounds[:-1]) == np.maximum.reduceat(side, bounds[:-1]))[bucket]
            p, left = S.planes(fp.view(np.uint64)), np.zeros(len(fp), dtype=bool)
            for shift in range(1, int(np.diff(bounds).max())):
                same = (bucket[shift:] == bucket[:-shift]) & (root[shift:] != root[:-shift]) & _alike(size[shift:], size[:-shift], similarity)
                same &= alone[shift:] | (side[shift:] != side[:-shift])
                if same.any():
                    a, _ = S.linked(p, shift, radius, same)
                    left[a] = left[a + shift] = True
            yield batch.select(["t", *_GROUP, "side", "node", "root"]).filter(pa.array(left))

    return run


def verified(t: int, side: np.ndarray, fp: np.ndarray, root: np.ndarray, keys: np.ndarray, at: np.ndarray, values: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join just the members with a path of similar pairs, every pair looked at.

    Pairs that share a key before ``t`` belong to that key's block.
    """
    root, size = np.unique(root, return_inverse=True)[1], np.diff(at)
    _, values = np.unique(values, return_inverse=True)
    marked = np.zeros(int(values.max(initial=-1)) + 1, dtype=bool)
    alone = bool((side == side[0]).all())
    found = []
    for x in range(len(fp) - 1):
        ys = x + 1 + np.flatnonzero(
            (root[x + 1 :] != root[x]) & (alone | (side[x + 1 :] != side[x])) & (np.bitwise_count(fp[x + 1 :] ^ fp[x]) <= radius) & _alike(size[x + 1 :], size[x], similarity)
        )
        ys = ys[~(keys[ys, :t] == keys[x, :t]).any(axis=1)]
        if not len(ys):
            continue
        own = values[at[x] : at[x + 1]]
        marked[own] = True
        ends = np.cumsum(size[ys])
        index = np.arange(ends[-1]) + np.repeat(at[ys] - (ends - size[ys]), size[ys])
        both = np.add.reduceat(marked[values[index]], ends - size[ys], dtype=np.int64)
        marked[own] = False
        for y in ys[both >= similarity * (size[ys] + size[x] - both) - 1e-9].tolist():
            if root[y] != root[x]:
                found.append((x, y))
                root[root == root[y]] = root[x]
    return found


def _verified_rows(radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, _GROUP, lambda b: len(b.column("shingles").flatten()), VALUES):
            t, side, node, root, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "side", "node", "root", "fp"))
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, KEYS)
            sizes = batch.column("shingles").value_lengths().to_numpy(zero_copy_only=False)
            values, at = batch.column("shingles").flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
            bounds = _bounds(batch, _GROUP)
            links = []
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                inner = at[i : j + 1]
                got = verified(int(t[i]), side[i:j], fp[i:j].view(np.uint64), root[i:j], keys[i:j], inner - inner[0], values[inner[0] : inner[-1]], radius, similarity)
                links += [(node[i + x], node[i + y]) for x, y in got]
            u, v = np.array(links, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return run


def near_duplicate_roots(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, row_hash, node; roots: node, root of linked nodes)."""
    spark = docs.sparkSession
    C.ship(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_column().alias("text"), F.xxhash64(C.text_column()).alias("row_hash"))
    rows = C.Stash(base.mapInArrow(_sketch_rows(shingle), "doc_id long, row_hash long, node long, fp long, size int, keys array<long>")).df
    nodes = rows.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"), F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_hash")).alias("rep")).where("node <> 0")
    each = C.Stash(nodes.select("node", "fp", "size", F.posexplode("keys").alias("t", "key")).select("node", "fp", "size", "t", F.xxhash64("t", "key").alias("block"))).df
    blocks = each.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    met = C.cut(each.join(blocks, "block").withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("part", F.pmod(F.xxhash64("node", "block"), "parts")))
    C.release(spark)
    links = (
        met.select("block", "part", "fp", "node").repartition("block", "part").sortWithinPartitions("block", "part", "node").mapInArrow(_link_rows(RADIUS), "u long, v long")
    )
    links = C.cut(links.distinct())
    C.release(spark)

    # exact similarity of the linked nodes' shingle sets
    sets = _sets_of(links.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, base, shingle)
    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    good = C.cut(links.join(left, "u").join(right, "v").where(both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9).select("u", "v"))
    roots = S.components(good)
    C.release(spark)

    # every other pair, where the nodes that have one meet
    rooted = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    small = rooted.where("parts = 1").select("t", "block", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("side"), "node", "root", "fp", "size")
    grouped = small.unionByName(_rare_blocks(rooted.where("parts > 1"), nodes, base, similarity, shingle))
    grouped = grouped.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")
    left_over = C.Stash(grouped.mapInArrow(_open_rows(RADIUS, similarity), "t int, block long, part long, side long, node long, root long")).df
    C.release(spark)
    sets = _sets_of(left_over.select("node").distinct(), nodes, base, shingle).join(nodes.select("node", "fp", "keys"), "node")
    ready = left_over.join(sets, "node").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")
    more = C.cut(ready.mapInArrow(_verified_rows(RADIUS, similarity), "u long, v long"))
    C.release(spark)
    roots = S.components(good.unionByName(more.distinct()))
    C.release(spark)
    return rows, roots


def _bucket(values: np.ndarray) -> np.ndarray:
    return (C.mix(values.astype(np.int64).view(np.uint64)) & np.uint64(COUNTS - 1)).astype(np.int64)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, n: how many shingles of this part fall into each bucket."""
    total = np.zeros(COUNTS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(_bucket(batch.column("shingles").flatten().to_numpy(zero_copy_only=False)), minlength=COUNTS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


def rare_first(sizes: np.ndarray, values: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, shingle): the rarest shingles of each set, of which similar sets share one."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, counts[_bucket(values)], owner))
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    stays = place < first[owner]
    return owner[stays], values[order][stays]


_MEMBER = ("node", "root", "fp", "size")


def _rare_rows(counts, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("shingles").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner, values = rare_first(sizes, batch.column("shingles").flatten().to_numpy(zero_copy_only=False), counts.value, similarity)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(values), *(batch.column(c).take(rows) for c in _MEMBER)], names=["rare", *_MEMBER])

    return run


def _rare_blocks(large: DataFrame, nodes: DataFrame, base: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Blocks by rare shingles of the nodes of large blocks, without those of one root.

    A block of more than ``BLOCK`` nodes is dealt into parts, and each pair of parts is a
    group of its own.
    """
    members = C.cut(large.select(*_MEMBER).distinct())
    sets = C.cut(_sets_of(members.select("node"), nodes, base, shingle).join(members, "node"))
    counts = np.zeros(COUNTS, dtype=np.int64)
    found = sets.mapInArrow(_count_rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # COUNTS rows at most
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    shared = large.sparkSession.sparkContext.broadcast(counts)  # of fixed size
    rare = C.Stash(sets.mapInArrow(_rare_rows(shared, similarity), "rare int, node long, root long, fp long, size int")).df
    open_ = rare.groupBy("rare").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    met = rare.join(open_.select("rare", F.ceil(F.col("n") / BLOCK).alias("parts")), "rare").withColumn("side", F.pmod(F.xxhash64("node", "rare"), "parts"))
    against = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    part = F.least("side", "other") * F.col("parts") + F.greatest("side", "other")
    # t = 0: no earlier block has looked at these pairs
    return against.select(F.lit(0).alias("t"), F.xxhash64(F.lit("rare"), "rare").alias("block"), part.alias("part"), "side", *_MEMBER)


def _sets_of(wanted: DataFrame, nodes: DataFrame, base: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of the wanted nodes."""
    wanted = wanted.join(nodes.select("node", "rep"), "node").select("node", "rep.doc_id", "rep.row_hash")
    known = base.withColumnRenamed("doc_id", "id").withColumnRenamed("row_hash", "hash")
    texts = known.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("row_hash"))).select("node", "text")
    return C.Stash(texts.mapInArrow(_set_rows(shingle), "node long, shingles array<int>").groupBy("node").agg(F.any_value("shingles").alias("shingles"))).df


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The documents, all columns unchanged, with one left of each group."""
    rows, roots = near_duplicate_roots(docs, similarity, shingle)
    grouped = rows.select("doc_id", "row_hash", "node").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    stays = C.cut(grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_hash")).alias("keep")).select(F.col("keep.doc_id").alias("_id"), F.col("keep.row_hash").alias("_hash")))
    C.release(docs.sparkSession)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("key"), F.xxhash64(C.text_column("row.text")).alias("text"))
    kept = marked.join(stays.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["key", "text"]).select("row.*")
